"""The operators' results in plain Python, from the rules alone."""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections import Counter, defaultdict

SPACE = re.compile("[^\\x20\\x09-\\x0D]+")
LICENSE_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return SPACE.findall(text or "")


def exact(rows):
    """(id, text) -> list of (id, keep_id, group_size, sha256); the largest id stays."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256(lower(t).encode()).hexdigest()))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    hit = {j for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(hit))


def licenses(text):
    """(n_words, n_base, first, last, base_labels)"""
    ws = LICENSE_WORD.findall(lower(text))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(ws))
              if ws[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return (len(ws), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def revisits(rows):
    """(id, payload) -> list of (id, bytes, digest, type, refers_to)"""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        new = first.get(t or "") == i
        out.append((i, len(data), b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if new else "revisit", None if new else first[t or ""]))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """(counts by kind, joined base spans)"""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    spans = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    spans += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    count = Counter(k for k, _, _ in spans)
    return tuple(count[k] for k in ("email", "ip", "card", "phone")), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingle_set(text, size=4):
    ws = words(lower(text))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1)))


def near(rows, percent=80):
    """(id, text) -> list of (id, n_shingles, component_id); every pair that shares a shingle is compared."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen, alike = {}, []
    for i, s in enumerate(sets):  # equal sets are compared once
        if s and s in seen:
            parent[find(i)] = find(seen[s])
        elif s:
            seen[s] = i
            alike.append(i)
    index = defaultdict(list)
    for i in alike:
        shared = Counter(j for g in sets[i] for j in index[g])
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in sets[i]:
            index[g].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def targets(sizes, weights=(1, 2, 3), limit=3):
    """source -> size to source -> target, by repeated sharing of the excess."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: limit * sizes[s] for s in over}
