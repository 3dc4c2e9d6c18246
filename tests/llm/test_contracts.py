"""The registered queries' columns against plain Python, on odd rows, on none, and on the small tables."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, packing, queries, warc
from corpusloom.llm.exact import drop_copies, exact_dedup
from corpusloom.llm.licenses import scan_licenses
from corpusloom.llm.minmax import drop_near_copies, near_groups
from corpusloom.llm.mixing import mix, mixed_documents
from corpusloom.llm.pii import find_personal_data
from corpusloom.llm.quality import RULES, ablations, drop_failed, ledger, passes

from . import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
small = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(frame, columns, expected):
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    return frame, [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def check_exact(frame, rows):
    out = exact_dedup(frame)
    same(out, ["doc_id", "keep_id", "group_size", "text_sha256"], brute.exact(rows))
    assert out.filter("kept").count() == len({brute.lower(t) for _, t in rows})
    assert out.filter("kept AND keep_id <> doc_id").count() == 0


def check_quality(frame, rows):
    same(ledger(frame, keep=["doc_id"]),
         ["row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
         [(i, *brute.quality(t)) for i, t in rows])


def check_licenses(frame, rows):
    same(scan_licenses(frame), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"],
         [(i, *brute.licenses(t)) for i, t in rows])


def check_personal(frame, rows):
    out = find_personal_data(frame)
    same(out, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans"],
         [(i, *brute.personal(t)[0], brute.personal(t)[1]) for i, t in rows])
    for r in out.collect():  # base spans stay
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))


def check_near(frame, rows):
    same(near_groups(frame), ["doc_id", "n_shingles", "component_id"], brute.near(rows))


def check_mix(frame, rows, sources):
    out = mix(frame).collect()
    sizes, total = {}, {}
    for (_, t), s in zip(rows, sources):
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    goal = brute.targets(sizes) if rows else {}
    assert sorted(r.size for r in out) == sorted(len(brute.words(t)) for _, t in rows)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        total[(r.source_size, r.target)] = total.get((r.source_size, r.target), 0) + r.taken
    want = {}
    for s, z in sizes.items():
        want[z, goal[s]] = want.get((z, goal[s]), 0) + goal[s]
    assert len(total) == len(want)
    for (z, target), taken in total.items():
        match = [w for w in want if w[0] == z and abs(w[1] - target) < 1e-6]
        assert match and abs(taken - want[match[0]]) <= mixing.BLOCK_WORDS * max(1, round(want[match[0]] / max(target, 1)))


def check_packing(frame, rows, window=packing.WINDOW, unit=packing.UNIT):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    pieces = packing.pack(frame, path, window=window, unit=unit).collect()
    tool = Tokenizer.from_file(path)
    encoded = tool.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    expected = sorted(((i, (*e.ids, 2)) for (i, _), e in zip(rows, encoded)), key=key)
    # pieces of documents that share an id cannot be told apart: those ids' tokens are compared as a whole
    got = {}
    for p in pieces:
        ids = [int.from_bytes(p.ids[k:k + 2], "little") for k in range(0, len(p.ids), 2)]
        assert len(ids) == p.length > 0
        got.setdefault(p.doc_id, []).append((p.start, p.doc_tokens, ids))
    assert sum(len(i) for _, i in expected) == sum(p.length for p in pieces)
    for doc in {i for i, _ in expected}:
        own = [ids for i, ids in expected if i == doc]
        if len(own) == 1:
            parts = sorted(got[doc])
            assert tuple(x for _, _, ids in parts for x in ids) == own[0]
            assert [a for a, _, _ in parts] == [sum(len(x) for _, _, x in parts[:k]) for k in range(len(parts))]
            assert {n for _, n, _ in parts} == {len(own[0])}
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    lengths = [sum(n for _, n in parts) for parts in held.values()]
    padding = sum(window - n for n in lengths if n & (n - 1))
    assert padding <= max(2 * window, 0.01 * sum(lengths))


CHECKS = [check_exact, check_quality, check_licenses, check_personal, check_near, check_packing]


@pytest.mark.parametrize("check", CHECKS)
def test_odd_rows(odd, pairs, check):
    check(odd, pairs)


@pytest.mark.parametrize("check", CHECKS)
def test_no_rows(empty, check):
    check(empty, [])


@small
@pytest.mark.parametrize("check", CHECKS)
def test_small_table(spark, check):
    check(*documents(spark))


def test_mix(spark, odd, empty, pairs):
    check_mix(odd, pairs, [r.source for r in odd.select("source").collect()])
    check_mix(empty, [], [])


@small
def test_mix_small_table(spark):
    frame, rows = documents(spark)
    check_mix(frame, rows, [r.source for r in frame.select("source").collect()])
    again = [mix(frame).select("doc_id", "taken").orderBy("doc_id").collect() for _ in range(2)]
    assert again[0] == again[1]


def test_mixed_documents(odd, empty):
    taken = mix(odd).agg(F.sum("taken")).first()[0]
    out = mixed_documents(odd)
    assert out.columns == odd.columns
    assert sum(len(brute.words(r.text)) for r in out.collect()) == taken
    assert mixed_documents(empty).count() == 0


def test_drops(odd, empty, pairs):
    for drop, n in ((drop_copies, len({brute.lower(t) for _, t in pairs})),
                    (drop_near_copies, None), (drop_failed, None)):
        out = drop(odd)
        assert out.columns == odd.columns
        assert out.count() == (n or out.count())
        assert drop(empty).count() == 0


def test_failed_documents_go(odd, pairs):
    kept = {r.doc_id for r in drop_failed(odd).collect()}
    assert kept == {9, 10}


def test_smallest_stays(odd):
    kept = {r.doc_id for r in exact_dedup(odd, keep="smallest").filter("kept").collect()}
    assert {1, 4, 6} <= kept and not {2, 7} & kept


def test_ledger_policies(odd):
    rows = ledger(odd).cache()
    table = {r.rule: r for r in ablations(rows).collect()}
    n = rows.count()
    failed = [r.failed for r in rows.collect()]
    kept = rows.filter(passes()).count()
    for bit, name in enumerate(RULES):
        if name in table:
            assert table[name].n_failed == sum(1 for f in failed if f >> bit & 1)
            assert table[name].n_kept_without == kept + table[name].n_alone <= n
    assert ablations(rows.limit(0)).count() == 0


def archive_rows(frame):
    return frame.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"),
                        F.concat(F.lit("http://x/\r\n"), F.col("doc_id")).alias("url"), "kept")


def test_archives(spark, tmp_path, odd, empty, pairs):
    frame = archive_rows(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    frame.write.parquet(str(tmp_path / "pages"))
    frame = spark.read.parquet(str(tmp_path / "pages"))
    rows = [(r.page_id, r.html) for r in frame.collect()]
    path = warc.write_archives(frame, str(tmp_path / "archives"), file_bytes=1000)
    back = warc.read_archives(spark, path)
    same(back, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], brute.revisits(rows))
    text = {i: t or "" for i, t in rows}
    for r in back.collect():
        assert bytes(r.payload).decode() == (text[r.page_id] if r.record_type == "response" else "")
    assert warc.rewrite(archive_rows(empty)).count() == 0
    assert warc.rewrite(archive_rows(odd)).count() == len(pairs)  # null and repeated ids


def test_short_payloads_stay(spark, tmp_path, odd):
    frame = archive_rows(odd)
    path = warc.write_archives(frame, str(tmp_path / "archives"), least_bytes=1)
    assert warc.read_archives(spark, path).filter("payload_bytes = 0 AND record_type = 'revisit'").isEmpty()


@small
def test_archives_small_table(spark):
    frame = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in frame.collect()]
    same(queries.QUERIES["op4_warc_revisits"](spark, SF),
         ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], brute.revisits(rows))
