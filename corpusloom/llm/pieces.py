"""Encoding and decoding with a vocabulary of scored pieces (merge type, with bytes for unknown characters).

The merge rule of such a model: characters are symbols; of all neighbouring symbols that make a piece together, those
with the best score are merged, the leftmost of equal ones first, until none is left. Here this result is found by
backtracking, without merging texts:

* an Aho-Corasick automaton of all pieces gives the longest piece that begins at each place;
* a piece may follow the one before it only if both stay as they are when the two alone are merged anew, which shows
  at their border; a sequence of pieces whose neighbours all pass is the one that merging gives, and the only one;
* a piece that may not follow is replaced by the longest piece that begins it. When none is left, the place is marked
  in a bitfield as failed and the piece before it is shortened, so no place is tried twice.

A text is first cut wherever two neighbouring characters stand together in no piece, for no merge crosses such a
place; a character in no piece is cut off on both sides and becomes its UTF-8 bytes. Words found before are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_of
from .recent import Recent, ids_of

SPACE = "▁"       # fixed value: how pieces write a blank
CACHE_WORDS = 200_000   # a worker holds twice as many
BLOCK = 2_000_000        # bytes or ids worked on together
TABLE = 1 << 19          # remembered pairs
TOGETHER = 20_000        # words searched together, of up to LONG characters, until FEW are left
LONG, FEW = 60, 8
NEVER = float("-inf")
LETTER = re.compile(r"[^\W\d_]")

_loaded: dict[tuple[type, str], Surfaces] = {}


class Surfaces:
    """A model file's pieces, and the texts of ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as form

        model = form.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, form.ModelProto.SentencePiece
        if model.trainer_spec.model_type != form.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("the model has to be of the merge type, with bytes for unknown characters")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix \
                or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model has to leave characters as they are and to put a blank in front of a text")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces defined by users, or unused, are not supported")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == model.trainer_spec.eos_piece)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.raw = {i: b for b, i in self.byte.items()}
        self.surface = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.BYTE:
                self.surface.append(bytes([self.raw[i]]))
            else:
                self.surface.append(model.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.spaced = {i for p, i in self.number.items() if p.startswith(SPACE)}
        size = np.array([len(x) for x in self.surface])
        self.bytes_pool, self.bytes_size, self.bytes_first = np.frombuffer(b"".join(self.surface), dtype=np.uint8), size, np.cumsum(size) - size
        self.begins_blank = np.zeros(len(size), dtype=bool)
        self.begins_blank[list(self.spaced)] = True
        self.hard = np.zeros(len(size), dtype=bool)   # bytes that are no character by themselves, and silent pieces
        self.hard[[i for i, b in self.raw.items() if b >= 0x80] + list(self.silent)] = True

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``. Bytes that make no UTF-8 become U+FFFD each; an id outside the vocabulary is an error."""
        if not ids:
            return ""
        if not 0 <= min(ids) <= max(ids) < len(self.surface):
            raise ValueError("an id lies outside the vocabulary")
        surface, silent = self.surface, self.silent
        # the blank put in front of the text belongs to the first piece that is not silent
        first = next((i for i in ids if i not in silent), None)
        blank = int(first in self.spaced)
        raw = b"".join([surface[i] for i in ids])[blank:]
        if not any(i in ids[:-1] for i in silent):  # a silent piece parts the bytes before it from those behind
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids)[blank:]

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """``decode`` of many lists; a null one, or one with a null, gives null."""
        if lists.null_count or lists.flatten().null_count:
            return pa.array([None if x is None or None in x else self.decode(x) for x in lists.to_pylist()], pa.string())
        ids = lists.flatten().to_numpy().astype(np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.surface):
            raise ValueError("an id lies outside the vocabulary")
        begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        head, tail = begin[:-1][begin[1:] > begin[:-1]], begin[1:][begin[1:] > begin[:-1]] - 1
        hard = self.hard[ids]
        hard[tail[self.bytes_size[ids[tail]] == 0]] = False  # an end id parts nothing
        hard = np.concatenate([[0], np.cumsum(hard)])
        one_by_one = hard[begin[1:]] > hard[begin[:-1]]
        size, first = self.bytes_size[ids], self.bytes_first[ids]
        blank = head[self.begins_blank[ids[head]]]
        size[blank] -= 1
        first[blank] += 1
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes_pool[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        out = pa.StringArray.from_buffers(len(lists), pa.py_buffer(ends[begin].astype(np.int32)), pa.py_buffer(raw))
        if one_by_one.any():
            rows = lists.filter(pa.array(one_by_one)).to_pylist()
            out = pc.replace_with_mask(out, pa.array(one_by_one), pa.array(map(self.decode, rows), pa.string()))
        return out

    def _mended(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at:at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.raw:
                run.append(self.raw[i])
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


class Vocabulary(Surfaces):
    """What encoding needs besides, derived from the pieces."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        self.neighbours = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        # pieces that merging itself reaches, with the two parts merged last; and single characters, which it starts from
        self.halves: dict[str, tuple[str, str]] = {}
        for p in self.score:
            if len(p) > 1:
                symbols, last = self.merged(p)
                if symbols == [p]:
                    self.halves[p] = last
        for p, halves in self.halves.items():
            if any(len(h) > 1 and self.score[h] < self.score[p] for h in halves):
                raise ValueError(f"the piece {p!r} has a better score than one of its parts")
        reached = {c for p in self.score for c in p} | set(self.halves)
        self.edges: tuple[dict, dict] = ({}, {})
        self.letters = {p for p in reached if len(p) == 1}
        self.border = next(c for c in map(chr, range(0x110000)) if c not in self.letters)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), None) for p in reached}
        # the same by number, for many words at once
        self.pieces = sorted(reached)
        at = {p: k for k, p in enumerate(self.pieces)}
        self.length = np.array([len(p) for p in self.pieces])
        self.less = np.array([at.get(self.shorter[p], -1) for p in self.pieces])
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for c in self.letters:
            self.single[ord(c)] = at[c]
        self.automaton = ahocorasick.Automaton()
        for p in self.halves:
            self.automaton.add_word(p, (len(p) - 1) << 32 | at[p])
        self.automaton.make_automaton()
        self.checked = np.full(TABLE, -1, dtype=np.int64)   # pairs of pieces, each at a place of its own
        self.fit = np.zeros(TABLE, dtype=bool)
        own = [self._of(p) for p in self.pieces]
        self.ids = {p: np.array(x, dtype="<i4").tobytes() for p, x in zip(self.pieces, own)}
        self.id_pool, self.id_size = np.array(list(chain.from_iterable(own)), dtype="<i4"), np.array([len(x) for x in own])
        self.id_first = np.cumsum(self.id_size) - self.id_size
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(self.letters)))}])")
        self.chunk = self._chunks()
        self.recent = Recent(CACHE_WORDS)

    def _chunks(self) -> re.Pattern:
        """Words as they are looked up, cut only where no piece crosses.

        In front of blanks, around line ends and tabs, and between a letter and a mark behind it, each where
        the pieces allow it. What this leaves together is cut, if at all, by the search itself.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            return re.compile(r"(?s).+")
        alone = "".join(c for c in "\n\t\r" if c not in self.letters)
        marks = "".join(c for c in ".,;:!?#$%&*|<>\"" if not any(x[1] == c and LETTER.match(x[0]) for x in self.neighbours))
        gap = f"[{alone}]+" if alone else "(?!)"
        mark = f"[{re.escape(marks)}]" if marks else "(?!)"
        other = f"[^ {alone}{re.escape(marks)}]"
        body = f"{other}*(?:(?<!{LETTER.pattern}){mark}{other}*)*"
        return re.compile(f" +{body}|{other}{body}|{mark}{body}|{gap}")

    def _of(self, piece: str) -> list[int]:
        at = self.number.get(piece)
        return [at] if at is not None else [self.byte[b] for b in piece.encode()]

    def merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The merge rule itself, for short texts: the symbols left and the two merged last."""
        symbols, score, last = list(text), self.score, ("", "")
        while len(symbols) > 1:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            last = (symbols[where], symbols[where + 1])
            symbols[where:where + 2] = [last[0] + last[1]]
        return symbols, last

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The symbols at one end of ``piece`` while it is merged, each with the score of the merge that takes it up."""
        known = self.edges[side].get(piece)
        if known is None:
            known, part = [(piece, NEVER)], piece
            while len(part) > 1:
                taken, part = self.score[part], self.halves[part][side]
                known.append((part, taken))
            known.reverse()
            self.edges[side][piece] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``: merged anew side by side, nothing is merged across their border.

        Merges come by falling score, so both ends grow in a known order, and what stands at the border may be
        merged only if it is a piece that comes before the next merge on either side (of equal ones the leftmost).
        """
        score, i, j = self.score, 0, 0
        ends, starts = self._edge(left, 1), self._edge(right, 0)
        while True:
            (a, next_a), (b, next_b) = ends[i], starts[j]
            across = score.get(a + b, NEVER)
            if across > next_a and across >= next_b:
                return False
            if next_a >= next_b:
                if next_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _fit_together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs, by number. Pairs are remembered in a table of fixed size; a new one takes its place."""
        key = left * len(self.pieces) + right
        place = (key * 0x9E3779B1 >> 16) % TABLE
        out = self.fit[place]
        new = np.flatnonzero(self.checked[place] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            n, names = len(self.pieces), self.pieces
            found = np.array([self.fits(names[k // n], names[k % n]) for k in keys.tolist()])
            out[new] = found[back]
            self.checked[place[new]] = key[new]
            self.fit[place[new]] = out[new]
        return out

    def _matches(self, text: str, out: np.ndarray) -> None:
        """Put the number of the longest piece that begins at a place of ``text`` there, where it has several characters."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        # of two that begin at a place the longer one ends later, and the later value stays
        out[found[:, 0] - (found[:, 1] >> 32)] = found[:, 1] & 0xFFFFFFFF

    def backtrack(self, text: str) -> list[str]:
        """The pieces of ``text``, whose characters all are letters of pieces."""
        numbers = self.single[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        self._matches(text, numbers)
        longest = [self.pieces[k] for k in numbers.tolist()]
        shorter, stop = self.shorter, len(text)
        failed = bytearray(stop // 8 + 1)
        found: list[str] = []
        at, piece, before = 0, longest[0], None
        while True:
            to = at + len(piece)
            if not failed[to >> 3] >> (to & 7) & 1 and (before is None or self.fits(before, piece)):
                found.append(piece)
                if to == stop:
                    return found
                at, before, piece = to, piece, longest[to]
                continue
            piece = shorter[piece]
            while piece is None:  # nothing may begin here: shorten what stands before
                failed[at >> 3] |= 1 << (at & 7)
                last = found.pop()
                before = found[-1] if found else None
                at -= len(last)
                piece = shorter[last]

    def _backtrack_together(self, longest: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``backtrack`` of many words at once, all a step at a time: the pieces' numbers, each word's from its start on
        (-1 elsewhere), and the words that were not done when only few were left.

        ``longest`` belongs to a text that has the words at ``start``, each with a place behind it that is in no word.
        """
        length, less, stop = self.length, self.less, start + size
        found = np.full(len(longest) + 1, -1)
        failed = np.zeros(len(longest) // 8 + 1, dtype=np.uint8)
        at, piece = start.copy(), longest[start].astype(np.int64)
        top = start.copy()  # where the next piece is put
        live = np.arange(len(start))
        while len(live) > FEW:
            p, to, above = piece[live], at[live] + length[piece[live]], top[live]
            before = np.where(above > start[live], found[above - 1], -1)
            free = (failed[to >> 3] >> (to & 7)) & 1 == 0
            ask = np.flatnonzero(free & (before >= 0))
            free[ask] = self._fit_together(before[ask], p[ask])
            done = live[free]
            found[above[free]] = p[free]
            top[done] += 1
            at[done] = to[free]
            done = done[at[done] < stop[done]]
            piece[done] = longest[at[done]]
            tried = live[~free]
            piece[tried] = less[p[~free]]
            stuck = tried[piece[tried] < 0]
            while len(stuck):  # nothing may begin here: shorten what stands before
                np.bitwise_or.at(failed, at[stuck] >> 3, (1 << (at[stuck] & 7)).astype(np.uint8))
                top[stuck] -= 1
                last = found[top[stuck]]
                found[top[stuck]] = -1
                at[stuck] -= length[last]
                piece[stuck] = less[last]
                stuck = stuck[piece[stuck] < 0]
            live = np.concatenate([done, tried])
        for w in live.tolist():
            found[start[w]:stop[w]] = -1
        return found, live

    def _search(self, word: str) -> bytes:
        """Ids of one word, which may be long or have unknown characters."""
        out = []
        for part in filter(None, self.unknown.split(word)):
            if part[0] in self.letters:
                out += [self.ids[p] for p in self.backtrack(part)]
            else:  # a character by itself
                out.append(np.array([self.byte[b] for b in part.encode()], dtype="<i4").tobytes())
        return b"".join(out)

    def _work(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words, many searched together."""
        for at in range(0, len(words), TOGETHER):
            block = words[at:at + TOGETHER]
            text = (self.border.join(block) + self.border).replace(" ", SPACE)
            longest = self.single[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
            unknown = np.concatenate([[0], np.cumsum(longest < 0)])
            self._matches(text, longest)
            size = np.fromiter(map(len, block), dtype=np.int64, count=len(block))
            start = np.cumsum(size + 1) - size - 1
            alike = np.flatnonzero((size <= LONG) & (unknown[start + size] == unknown[start]))
            found, left = self._backtrack_together(longest, start[alike], size[alike])
            known = found >= 0
            numbers = found[known]
            n = self.id_size[numbers]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = self.id_pool[np.arange(ends[-1]) + np.repeat(self.id_first[numbers] - ends[:-1], n)].tobytes()
            before = np.concatenate([[0], np.cumsum(known)])   # pieces before each place
            a, b = 4 * ends[before[start]], 4 * ends[before[start + size]]
            alone = np.ones(len(block), dtype=bool)
            alone[alike] = False
            alone[alike[left]] = True
            for word, i, j, own in zip(block, a.tolist(), b.tolist(), alone.tolist()):
                yield self._search(word.replace(" ", SPACE)) if own else ids[i:j]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without an end id, and where each text's begin (and the last ends)."""
        lists = [self.chunk.findall(" " + x.replace(SPACE, " ")) if x else [] for x in texts]
        begin = np.cumsum([0, *map(len, lists)])
        return ids_of(pa.array(chain.from_iterable(lists), pa.string()), begin, self.recent, self._work, "<i4")


def loaded(kind: type, path: str):
    """The model at ``path``, read once per Python worker."""
    if (kind, path) not in _loaded:
        _loaded.clear()
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _mapped(rows: DataFrame, column: str, kind: str, out: str, work: Callable) -> DataFrame:
    """``rows`` with the Arrow column ``column`` replaced by ``out`` of type ``kind``, worked on in blocks."""
    kept = [f for f in rows.schema.fields if f.name != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` {kind}"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, column, BLOCK):
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, work(part.column(column))], [*names, out])

    return rows.mapInArrow(run, schema)


def encode_pieces(docs: DataFrame, path: str, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",),
                  end_id: bool = True) -> DataFrame:
    """The columns ``keep`` of every row, in one struct ``row``, and ``ids``, the piece ids of its whole text.

    ``path`` is the model file. With ``end_id`` the ids close with the end id. A null text counts as empty and has no
    pieces. Rows are worked on one by one, without a shuffle: repeated rows, null ids and further columns make no
    difference, and an empty table gives an empty result. A text of any length is encoded whole; a word of n
    characters takes time and memory in proportion to n.
    """
    picked = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    rows = docs.select(picked, text_of(F.col(f"`{text}`") if isinstance(text, str) else text).alias("text"))

    def work(texts: pa.Array) -> pa.Array:
        model = loaded(Vocabulary, path)
        ids, begin = model.encode(texts.to_pylist())
        if end_id:
            ids = np.insert(ids, begin[1:], model.end)
            begin = begin + np.arange(len(begin))
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))

    return _mapped(rows, "text", "array<int>", "ids", work)


def decode_pieces(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the array ``ids`` replaced by ``text``. Null ids, or a null among them, give a null text."""

    return _mapped(rows, ids, "string", "text", lambda lists: loaded(Surfaces, path).decode_lists(lists))
