import math
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.morph import TOKEN_TYPE
from corpusloom.plans import build
from corpusloom.plans.pattern import Pattern

from .samples import brute_force, node_ok, random_sentence, to_rows

SCHEMA = f"sent_key string, words array<{TOKEN_TYPE}>"

PATTERNS = {
    "star": ({"V": {}, "S": {}, "O": {}}, {("V", "S"): {"deprels": "nsubj.*"}, ("V", "O"): {"deprels": ".*"}}),
    "path": ({"A": {"upos": "NOUN|VERB"}, "B": {}, "C": {"lemma": "x"}, "D": {"upos": "ADP"}},
             {("A", "B"): {"deprels": "obj|obl"}, ("B", "C"): {"deprels": ".*"}}),
    "siblings": ({"Top": {"upos": "NOUN|VERB|ADP"}, "L": {}, "R": {"exclude": ["Tense"]}},
                 {("Top", "L"): {"deprels": "obl|obj"}, ("Top", "R"): {"deprels": ".*"},
                  ("L", "R"): {"lindist": (-4, 5), "fconstraint": {"disjoint": ["Number"]}}}),
    "apart": ({"A": {"Number": "Sing"}, "B": {"exclude": ["Tense"]}},
              {("A", "B"): {"lindist": (2, math.inf), "fconstraint": {"disjoint": ["Case"]}}}),
    "near": ({"A": {"form": "A|b"}, "B": {"xpos": ".*"}}, {("A", "B"): {"lindist": (-2, 1)}}),
    "near_back": ({"A": {}, "B": {"upos": "ADP"}, "C": {}},
                  {("C", "B"): {"deprels": ".*"}, ("A", "B"): {"lindist": (1, 2)}}),
    "two_parts": ({"A": {}, "B": {}, "C": {}, "D": {}},
                  {("A", "B"): {"deprels": "obj"}, ("C", "D"): {"deprels": "nsubj:pass"}}),
    "plain": ({"A": {}, "B": {"upos": "VERB"}}, {("A", "B"): {}}),
    "both_ways": ({"A": {}, "B": {}}, {("A", "B"): {"deprels": "obj"}, ("B", "A"): {"lindist": (1, 3)}}),
    "unrelated": ({"A": {}, "B": {"upos": "NOUN|VERB"}, "C": {}},
                  {("A", "B"): {"fconstraint": {"intersec": ["Number"], "disjoint": ["Case"]}},
                   ("C", "B"): {"fconstraint": {"disjoint": ["Number"]}, "lindist": (-math.inf, -1)}}),
    "far_pairs": ({"A": {}, "B": {}, "C": {}, "D": {"upos": "ADP|NOUN"}},
                  {("A", "B"): {"deprels": "obj|obl"}, ("B", "C"): {"fconstraint": {"intersec": ["Case"]}},
                   ("C", "D"): {"lindist": (2, math.inf)}}),
    "negated": ({"A": {"upos": "^(?!NOUN|VERB$).*$", "Tense": "pa.*"}, "B": {}}, {("A", "B"): {"deprels": ".*"}}),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    sentences = [random_sentence(rng, rng.randint(1, 9)) for _ in range(120)]
    # ids with gaps: a word is looked up by its id, not by its place
    for s in sentences[:20]:
        if len(s) > 3 and s[1]["head"] and not any(w["head"] == s[1]["id"] for w in s):
            del s[1]
    rows = to_rows(sentences)
    return sentences, spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("name", PATTERNS)
def test_against_brute_force(corpus, name):
    sentences, df = corpus
    nodes, constraints = PATTERNS[name]
    p = Pattern(nodes, constraints)
    w = F.col("words")
    got = {r.sent_key: r for r in df.select(
        "sent_key", p.exists(w).alias("e"), p.matches(w).alias("m"), p.first_match(w).alias("f"), p.has_nodes(w).alias("h")).collect()}
    hits = 0
    for k, words in enumerate(sentences):
        want = brute_force(nodes, constraints, words)
        hits += bool(want)
        row = got[str(k)]
        assert row.e == bool(want)
        assert sorted(tuple(m) for m in row.m) == want
        assert row.h == all(any(node_ok(f, x) for x in words) for f in nodes.values())
        if want:
            assert tuple(row.f[n] for n in p.bound) == want[0]
            for n in p.free:
                assert row.f[n] == min(x["id"] for x in words if node_ok(nodes[n], x))
        else:
            assert row.f is None
    assert 0 < hits < len(sentences)


def test_nodes_only(corpus):
    sentences, df = corpus
    p = Pattern({"A": {"upos": "ADP"}, "B": {"Number": "Plur"}})
    got = {r.sent_key for r in build.filter_sentences(df, p).collect()}
    want = {str(k) for k, s in enumerate(sentences)
            if any(node_ok({"upos": "ADP"}, x) for x in s) and any(node_ok({"Number": "Plur"}, x) for x in s)}
    assert got == want
    rest = {r.sent_key for r in build.filter_not_matching(df, p).collect()}
    assert rest == {str(k) for k in range(len(sentences))} - want
    with pytest.raises(ValueError):
        p.matches(F.col("words"))


def test_query_errors():
    with pytest.raises(KeyError):
        Pattern({"A": {"colour": "red"}})
    with pytest.raises(TypeError):
        Pattern({"A": {"exclude": "Number"}})
    with pytest.raises(ValueError):
        Pattern({"A": {"exclude": ["Colour"]}})
    with pytest.raises(KeyError):
        Pattern({"A": {}, "B": {}}, {("A", "B"): {"wrong": "case"}})
    with pytest.raises(KeyError):
        Pattern({"A": {}, "B": {}}, {("A", "B"): {"fconstraint": {"wrong": ["Number"]}}})
    with pytest.raises(TypeError):
        Pattern({"A": {}, "B": {}}, {("A", "B"): {"fconstraint": {"intersec": "Number"}}})
    with pytest.raises(ValueError):
        Pattern({"A": {}}, {("A", "B"): {"deprels": ".*"}})
    with pytest.raises(KeyError):
        Pattern({"A": {"Gender[psor]": "Fem"}})
    Pattern({"A": {"Gender[psor]": "Fem"}}, extra_categories=("Gender[psor]",))


def test_long_sentence_follows_arcs(spark):
    """A pattern along relations stays quick in a sentence of many thousand words."""
    n = 6000
    words = [{"id": i, "form": "a", "lemma": "x", "upos": "NOUN", "xpos": None, "feats": None,
              "head": i // 2, "deprel": "obj" if i % 2 else "nsubj"} for i in range(1, n + 1)]
    df = spark.createDataFrame(to_rows([words]), SCHEMA)
    p = Pattern({"A": {}, "B": {}, "C": {}}, {("A", "B"): {"deprels": "obj"}, ("B", "C"): {"deprels": "nsubj"}})
    got = df.select(F.size(p.matches(F.col("words"))).alias("n")).first()["n"]
    assert got == len([1 for i in range(1, n + 1) if i % 2 == 0 and (i // 2) % 2 == 1 and (i // 2) > 1])


LOOSE = {
    "none": ({"A": {}, "B": {"upos": "VERB"}, "C": {"upos": "NOUN"}},
             {("A", "B"): {"fconstraint": {"intersec": ["Number"]}}, ("B", "C"): {"fconstraint": {"intersec": ["Case"]}}}),
    "all": ({"A": {}, "B": {}, "C": {}},
             {("A", "B"): {"fconstraint": {"intersec": ["Number"]}}, ("B", "C"): {"lindist": (1, math.inf)}}),
    "far": ({"A": {"upos": "ADP"}, "B": {"upos": "ADP"}, "C": {}},
            {("A", "B"): {"lindist": (5, math.inf)}, ("B", "C"): {"fconstraint": {"disjoint": ["Number"]}}}),
}


@pytest.mark.parametrize("name,first", [("none", None), ("all", (1, 3, 4)), ("far", None)])
def test_unrelated_nodes_in_a_long_sentence(spark, name, first):
    """Three nodes without a relation between them: no product of 2,000 words each is tried."""
    n = 2000
    words = [{"id": i, "form": "a", "lemma": "x", "upos": "ADP" if i == n else ("NOUN", "VERB")[i % 2], "xpos": None,
              "feats": {"Number": "Sing" if i % 2 else "Plur", "Case": f"c{i % 5}" if i % 2 == 0 else "k"},
              "head": i - 1, "deprel": "dep"} for i in range(1, n + 1)]
    df = spark.createDataFrame(to_rows([words]), SCHEMA).cache()
    df.count()
    p = Pattern(*LOOSE[name])
    start = time.time()
    got = df.select(p.exists(F.col("words")).alias("e"), p.first_match(F.col("words")).alias("f")).first()
    assert got.e == (first is not None) and (got.f and tuple(got.f)) == first
    assert time.time() - start < 30


def test_many_nodes_are_analysed(spark):
    """Long chains of loose constraints stay below the depth that Spark's analysis allows."""
    words = [{"id": i, "form": "a", "lemma": "x", "upos": "NOUN", "xpos": None, "feats": {"Number": "Sing"},
              "head": 0, "deprel": "dep"} for i in range(1, 9)]
    df = spark.createDataFrame(to_rows([words]), SCHEMA)
    for k in (4, 5, 7):
        names = [f"N{i}" for i in range(k)]
        p = Pattern({n: {} for n in names}, {(a, b): {"fconstraint": {"intersec": ["Number"]}, "lindist": (1, math.inf)}
                                             for a, b in zip(names, names[1:])})
        row = df.select(p.exists(F.col("words")).alias("e"), p.first_match(F.col("words")).alias("f")).first()
        assert row.e and tuple(row.f) == tuple(range(1, k + 1))


def test_build_filter_task(spark):
    rng = random.Random(9)
    sentences = [random_sentence(rng, 6) for _ in range(300)]
    rows = [(k, w, f"text {i // 2}" if i < 20 else f"text {i}") for i, (k, w) in enumerate(to_rows(sentences))]
    df = spark.createDataFrame(rows, f"sent_key string, words array<{TOKEN_TYPE}>, text string")
    one = {"HIT": PATTERNS["star"]}
    out = build.build_filter_task(df, one).collect()
    texts = [r.text for r in out]
    assert len(set(texts)) == len(texts) == 280  # ten texts come twice and go altogether
    labels = {r.sent_key: r.label for r in out}
    for k, s in enumerate(sentences):
        if str(k) in labels:
            assert labels[str(k)] == ("HIT" if brute_force(*one["HIT"], s) else "not_HIT")
    stages = [r.stage for r in out]
    assert stages.count("tr") == 224 and abs(stages.count("va") - stages.count("te")) <= 2
    with pytest.warns(UserWarning):
        build.build_filter_task(df, one, (0.9, 0.2, 0.1))
    with pytest.raises(ValueError):
        build.build_filter_task(df.limit(3), one)
    with pytest.raises(ValueError):
        build.build_filter_task(df.limit(7), one)
