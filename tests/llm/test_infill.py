"""Fill-in-the-middle against plain Python."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.infill import UNITS, WaveletMatrix, classes, cut_places, fill_in_middle, restored
from corpusloom.llm.queries import QUERIES

from .conftest import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TOKEN = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


def by_hand(doc, text, percent=50):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        form, out, parts = "plain", text, (None, None)
    else:
        form, parts = "spm" if h[3] % 100 < 80 else "psm", (len(prefix), len(middle))
        out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text)]
    return doc, len(units), form, *parts, *sha


def key(row):
    return tuple((x is None, str(x)) for x in row)


def check(spark, folder, rows):
    got = QUERIES["op12_wavelet_middle"](spark, folder).collect()
    assert sorted(map(tuple, got), key=key) == sorted((by_hand(*r) for r in rows), key=key)


MARKED = [(100 + i, t) for i, t in enumerate(
    ["<P>", "a <S> b", "x<M", "<P", "S>", " ", "\n\n", " a", "a ", "a b  c", "<" * 9, ">S< P> <", "\x00 \x1f\x85"] * 5)]


def test_odd_rows(spark, odd, pairs, tmp_path):
    odd.unionByName(table(spark, MARKED), allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), [*pairs, *MARKED])


def test_no_rows(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), [])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_small_table(spark):
    check(spark, SF, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_ranks():
    draw = np.random.default_rng(3)
    for size in (0, 1, 2, 50, 1000):
        symbols = draw.integers(0, 8, size).astype(np.uint8)
        matrix, places = WaveletMatrix(symbols), np.arange(size + 1)
        for c in range(8):
            assert matrix.rank(c, places).tolist() == [int((symbols[:p] == c).sum()) for p in places]


def test_cuts_of_words_and_lines():
    draw = random.Random(4)
    texts = ["".join(draw.choices("ab \n\té", k=draw.randint(0, 30))) for _ in range(300)]
    draws = np.array([[draw.getrandbits(32), draw.getrandbits(32)] for _ in texts])
    pattern = {"word": TOKEN, "line": re.compile("[^\\n]*\\n")}
    for unit in UNITS:
        n, cuts = cut_places(texts, draws, unit)
        for i, t in enumerate(texts):
            units = pattern[unit].findall(t)
            assert n[i] == len(units)
            goal = sorted(int(x) % (len(units) + 1) for x in draws[i])
            assert cuts[i].tolist() == [len("".join(units[:k])) for k in goal], (unit, t)


def test_class_of_each_character():
    assert classes(np.array([97, 98, 32, 10, 99, 32], dtype=np.uint32), np.array([6])).tolist() == [0, 4, 2, 3, 4, 6]
    assert classes(np.array([], dtype=np.uint32), np.array([0, 0])).tolist() == []


def test_all_texts_cut_and_restored(odd, pairs):
    rows = fill_in_middle(odd, keep=("doc_id", "text", "kept"), percent=100)
    back = rows.select("row.*", "form", restored(F.col("output"), F.col("form")).alias("back"),
                       F.concat("prefix", "middle", "suffix").alias("parts")).collect()
    assert len(back) == len(pairs)
    for r in back:
        assert r.back == (r.text or "") and r.kept == "clash"
        assert r.parts == (r.text if r.form != "plain" else None)
        assert (r.form == "plain") == (not r.text)
