"""Repeated rows found by a bitmap, keys of sentences under moved splits, and places found by a search tree."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classes, repeats
from corpusloom.operators import split as sp
from corpusloom.sources import conllu

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def split_by(spark):
    """Call with sizes to change how files are split from then on."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}

    def change(*values):
        for k, v in zip(SPLITS, values):
            spark.conf.set(k, v)

    yield change
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts(n=3000):
    draw = random.Random(3)
    rows = [(i, f"t{int(draw.expovariate(0.002))}", draw.choice(["a", "b", None])) for i in range(n)]
    rows += [(n + i, "hot", "a") for i in range(2000)] + [(n + 2000 + i, None, "a") for i in range(5)]
    return rows


def kept(rows, by=False):
    count = Counter((t, b) if by else t for _, t, b in rows if t is not None and (b is not None or not by))
    return sorted(i for i, t, b in rows if count[(t, b) if by else t] <= 1)


@pytest.mark.parametrize("bits", [64, 4096, repeats.BITS])
@pytest.mark.parametrize("max_rows", [0, 100_000])
def test_ambiguous_texts(spark, monkeypatch, bits, max_rows):
    """Few repeated texts or many, and bits that nearly every text shares."""
    monkeypatch.setattr(repeats, "BITS", bits)
    rows = texts()
    df = spark.createDataFrame(rows, "id long, text string, by string").repartition(7)
    out = classes.drop_ambiguous(df, max_rows=max_rows)
    assert out.columns == df.columns
    assert sorted(r.id for r in out.collect()) == kept(rows)
    out = classes.drop_ambiguous(df, by=("by",), max_rows=max_rows)
    assert sorted(r.id for r in out.collect()) == kept(rows, by=True)
    assert classes.drop_ambiguous(df.limit(0), max_rows=max_rows).count() == 0


def test_texts_stay_where_they_are(spark):
    """Beyond the bound, too, rows meet the bitmap by a broadcast; only doubtful ones are exchanged."""
    df = spark.createDataFrame(texts(), "id long, text string, by string")
    plan = classes.drop_ambiguous(df, max_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    clear, doubtful = plan.split("BroadcastHashJoin")[1:]
    assert plan.count("Exchange hashpartitioning") == 1  # of the doubtful rows, grouped
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan  # the input itself is not evaluated again
    assert clear and doubtful


def test_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(repeats, "COPIES", 7)
    rows = [(t or "", f"v-{t}", i % 3) for i, t, _ in texts()]
    df = spark.createDataFrame([(a, b, min(c for x, _, c in rows if x == a) if a == "hot" else 0) for a, b, c in rows],
                               "k string, v string, w int").repartition(5)
    got = repeats.number_equal(df, ["k"]).collect()
    count = Counter(k for k, _, _ in rows)
    assert sorted((r.k, r.nth) for r in got) == sorted((k, i) for k, n in count.items() for i in range(n))
    assert all(r.v == ("v-None" if r.k == "" else f"v-{r.k}") for r in got)
    assert repeats.number_equal(df.limit(0), ["k"]).count() == 0


def block(i, end="\n"):
    lines = [f"# sent_id = s{i}", f"# text = word{i} other", f"1\tword{i}\tword\tNOUN\t_\tNumber=Sing\t0\troot\t_\t_",
             "2\tother\tother\tADJ\t_\t_\t1\tamod\t_\t_"]
    return end.join(lines) + end + end


@pytest.fixture(scope="module")
def treebanks(tmp_path_factory):
    """1,968 sentences of 50 different blocks: 32 part files of one treebank, one in ten with CRLF; and one of single sentences."""
    root, draw = tmp_path_factory.mktemp("banks"), random.Random(4)
    part = root / "en_many-ud-train.conllu"
    part.mkdir()
    left = 1968
    for i in range(32):
        n = min(left, draw.randint(40, 80)) if i < 31 else left
        left -= n
        end = "\r\n" if i % 10 == 3 else "\n"
        (part / f"part-{i:03d}").write_bytes("".join(block(draw.randrange(50), end) for _ in range(n)).encode())
    (root / "en_one-ud-dev.conllu").write_text("".join(block(i) for i in range(500)))
    (root / "en_crlf-ud-test.conllu").write_bytes("".join(block(i, "\r\n") for i in range(500)).encode())
    return root


def keys(df):
    return sorted(r.sent_key for r in df.select("sent_key").collect())


@pytest.mark.parametrize("layout", ["files", "blocks"])
def test_keys_when_splits_move(spark, treebanks, split_by, layout):
    split_by("128m", "4m", "1")
    df = conllu.read_conllu(spark, str(treebanks), layout=layout)
    first = keys(df)
    assert len(first) == len(set(first)) == 2968
    for sizes in (("2k", "0", "1"), ("64k", "0", "40"), ("1k", "1k", "3")):
        split_by(*sizes)
        assert keys(df) == first  # the same rows evaluated again
    assert keys(conllu.read_conllu(spark, str(treebanks), layout="files")) == first


def test_line_ends_and_parts_make_no_difference(spark, treebanks):
    lines = lambda name: {r.sent_key.split(":", 1)[1] for r in conllu.read_conllu(
        spark, str(treebanks / name), layout="blocks").collect()}
    assert lines("en_one-ud-dev.conllu") == lines("en_crlf-ud-test.conllu")


@pytest.mark.parametrize("name", ["en_one-ud-dev.conllu", "en_crlf-ud-test.conllu"])
def test_large_files_are_split(spark, treebanks, split_by, monkeypatch, name):
    monkeypatch.setattr(conllu, "WHOLE_FILE_BYTES", 10_000)
    split_by("8k", "0", "1")
    df = conllu.read_conllu(spark, str(treebanks / name))
    parts = df.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 500 and len(parts) > 5
    mixed = conllu.read_conllu(spark, str(treebanks))  # part files whole, the two large ones split
    assert mixed.count() == 2968 and mixed.select("sent_key").distinct().count() == 2968


def test_names_with_pattern_characters(spark, tmp_path):
    for name in ("en_a[1]-ud-dev.conllu", "en_b {x}-ud-dev.conllu"):
        (tmp_path / name).write_text(block(1) + block(2))
    assert conllu.read_conllu(spark, str(tmp_path), layout="blocks").count() == 4


@pytest.mark.parametrize("wide", [2, 3, 64])
def test_search_tree(spark, wide):
    draw = random.Random(5)
    cuts = [(g, ({"p": f"{g}{i}"}["p"],), f"{draw.random():.6f}") for g, n in (("a", 1), ("b", 7), ("c", 300)) for i in range(n)]
    rows = [(draw.choice("abcd"), f"{draw.random():.6f}") for _ in range(2000)]
    rows += [(g, c) for g, _, c in cuts]  # a cut belongs to its own part
    out = sp.place_between(
        spark.createDataFrame(rows, "g string, o string"),
        spark.createDataFrame(cuts, "g string, part struct<part: string>, cut string"), ["g"], "o", wide)
    assert out.columns == ["g", "o", "part"]
    by_hand = {}
    for g, (p,), c in cuts:
        by_hand.setdefault(g, []).append((c, p))
    for v in by_hand.values():
        v.sort()
    want = [(g, o, next((p for c, p in by_hand.get(g, []) if c >= o), None)) for g, o in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_labels_of_many_classes(spark):
    rows = [(i, "tr" if i % 3 else "te", f"c{i % 2500}" if i % 2 else "hot") for i in range(12_000)]
    df = spark.createDataFrame(rows, "key long, stage string, label string").repartition(4)
    got = sp.control_labels(df, "key").collect()
    assert len(got) == len(rows)
    assert Counter((r.stage, r.control_label) for r in got) == Counter((s, x) for _, s, x in rows)
    assert sum(r.label == r.control_label for r in got) < 0.4 * len(rows)
