"""DuckDB SQL for the queries that SQL can express; every table is read whole."""

from __future__ import annotations

from .licenses import GRAM, TEMPLATES
from .quality import BASE, BITS, CURRENT, POLICIES, RULES
from .warc import ALPHABET

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licenses() -> str:
    grams, rows = [], []
    for t, template in enumerate(TEMPLATES):
        words = template.words
        k = min(GRAM, len(words))
        rows.append(f"({t}, {_text(template.label)}, {template.base}, {template.slack}, {template.share}, {len(words)})")
        grams += [f"({t}, {at}, {k}, [{', '.join(map(_text, words[at:at + k]))}])" for at in range(len(words) - k + 1)]
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
tm(t, label, base, slack, share, size) AS (VALUES {', '.join(rows)}),
gr(t, place, k, gram) AS (VALUES {', '.join(grams)}),
po AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d),
dg AS (SELECT doc_id, pos, k, list_slice(w, pos + 1, pos + k) AS gram FROM po, (SELECT DISTINCT k FROM gr) x
       WHERE pos + k <= len(w)),
hit AS (SELECT doc_id, t, pos - place AS diagonal, place, k FROM dg JOIN gr USING (k, gram)),
dia AS (SELECT DISTINCT doc_id, t, diagonal FROM hit),
cut AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= slack
          THEN 0 ELSE 1 END AS fresh FROM dia JOIN tm USING (t)),
num AS (SELECT doc_id, t, diagonal, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM cut),
cov AS (SELECT doc_id, t, span, min(diagonal) AS start, count(DISTINCT p) AS covered
        FROM (SELECT doc_id, t, span, diagonal, unnest(range(place, place + k)) AS p FROM hit JOIN num USING (doc_id, t, diagonal))
        GROUP BY ALL),
sp AS (SELECT doc_id, label, base, greatest(start, 0) AS start, covered * 1.0::DOUBLE / size AS part
       FROM cov JOIN tm USING (t) WHERE covered >= ceil(share * size)),
ag AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(part) AS score, count(*) AS n_spans
       FROM sp GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN ag USING (doc_id)"""


def _quality() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
tri AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE c > 1) GROUP BY 1),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN rep USING (doc_id)),
l AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM x)
SELECT *, failed_bits & {BASE} <> 0 AS base_failed, failed_bits & {BASE | POLICIES[CURRENT]} = 0 AS kept FROM l"""


def _ablations() -> str:
    rules = ", ".join(f"('{p}', '{r}', {mask}, {bit})" for p, mask in POLICIES.items() for r, bit in BITS.items() if bit & mask)
    return f"""
SELECT policy, rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed,
  count(*) FILTER (failed_bits & mask = bit) AS n_alone, count(*) FILTER (failed_bits & (mask - bit) = 0) AS n_kept_without
FROM ({_quality()}) q, (VALUES {rules}) v(policy, rule, mask, bit) GROUP BY policy, rule"""


def _base32(hex_digest: str) -> str:
    value = " + ".join(f"(strpos('0123456789abcdef', substr({hex_digest}, 5 * g + {j}, 1)) - 1) * {16 ** (5 - j)}" for j in range(1, 6))
    letters = " || ".join(f"substr('{ALPHABET}', ((v >> {15 - 5 * k}) & 31) + 1, 1)" for k in range(4))
    return (f"array_to_string(list_transform(list_transform(range(8), lambda g: {value}), lambda v: {letters}), '')")


ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS m FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_base32('h')} AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM f"""

EXACT = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents),
f AS (SELECT doc_id, place, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
g AS (SELECT *, row_number() OVER o AS nth, lead(place, 2) OVER o AS last, [line, lead(line) OVER o, lead(line, 2) OVER o] AS win
      FROM f WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
w AS (SELECT *, first_value(doc_id) OVER k AS d1, first_value(nth) OVER k AS n1 FROM g WHERE last IS NOT NULL
      WINDOW k AS (PARTITION BY win ORDER BY doc_id, nth)),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, last + 1)) AS place FROM w WHERE doc_id <> d1 OR nth >= n1 + 3),
k AS (SELECT l.*, gone.place IS NOT NULL AS cut FROM l LEFT JOIN gone USING (doc_id, place))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (cut) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT cut), '')) AS text_sha256 FROM k GROUP BY doc_id"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)"""

INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS k FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 50 THEN 'plain'
             WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b FROM c),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(list_slice(units, 1, a), ''), '') AS p,
        coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') AS m,
        coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') AS s FROM w)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES: dict[str, str] = {
    "op3_license_scan": _licenses(),
    "op4_warc_revisits": ARCHIVES,
    "op5_quality_rules": _quality(),
    "op5_rule_ablations": _ablations(),
    "op6_exact_dedup": EXACT,
    "op8_line_windows": LINES,
    "op10_minmax_near_dedup": NEAR,
    "op12_wavelet_middle": INFILL,
}
