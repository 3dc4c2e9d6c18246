import random

import pytest
from pyspark.sql import functions as F

from corpusloom import convert_treebanks, filter_treebanks
from corpusloom.functions import morph
from corpusloom.functions.morph import TOKEN_TYPE
from corpusloom.operators import morphology as mo
from corpusloom.sources import taskfile

from .samples import TOY, preorder, random_sentence, to_rows

SCHEMA = f"sent_key string, words array<{TOKEN_TYPE}>"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    sentences = [random_sentence(rng, rng.randint(1, 14)) for _ in range(150)]
    return sentences, spark.createDataFrame(to_rows(sentences), SCHEMA).repartition(5).cache()


def _heads(heads):
    return [{"id": i, "form": "a", "lemma": "a", "upos": "NOUN", "xpos": None, "feats": {"Case": "Nom"},
             "head": h, "deprel": "dep"} for i, h in enumerate(heads, 1)]


def test_paths_give_preorder(corpus):
    sentences, df = corpus
    rows = {r.sent_key: r.p for r in df.select("sent_key", morph.token_paths(F.col("words")).alias("p")).collect()}
    for k, s in enumerate(sentences):
        paths = rows[str(k)]
        assert [p[-1] for p in sorted(paths)] == preorder(s)
        heads = {w["id"]: w["head"] for w in s}
        for p in paths:
            assert heads[p[0]] == 0 and all(heads[b] == a for a, b in zip(p, p[1:]))


def test_odd_trees(spark):
    cases = {"chain": list(range(0, 70)), "star": [0] + [1] * 30, "cycle": [0, 3, 2, 1], "self": [0, 2],
             "two": [0, 0], "none": [2, 1], "out": [0, 9]}
    df = spark.createDataFrame(to_rows([_heads(h) for h in cases.values()]), SCHEMA)
    got = {r.sent_key: r for r in df.select("sent_key", morph.token_paths(F.col("words")).alias("p"),
                                            morph.tree_status(F.col("words")).alias("s")).collect()}
    by = dict(zip(cases, (got[str(i)] for i in range(len(cases)))))
    assert max(len(p) for p in by["chain"].p) == 70
    assert by["star"].s == "ok"
    assert by["cycle"].p[1] is None and by["cycle"].p[2] is None and by["cycle"].p[3] == [1, 4]
    assert by["self"].p[1] is None
    assert (by["cycle"].s, by["self"].s, by["chain"].s) == ("cycle", "cycle", "ok")
    assert (by["two"].s, by["none"].s, by["out"].s) == ("many_roots", "no_root", "bad_head")


def _below(words):
    """Size of every word's subtree by counting along heads, None for a word that comes to no root."""
    heads = {w["id"]: w["head"] for w in words}

    def path(i):
        seen = []
        while i and i not in seen:
            seen.append(i)
            i = heads.get(i)
        return seen if i == 0 else []

    paths = {i: path(i) for i in heads}
    return {i: sum(i in p for p in paths.values()) or None for i in heads}


def test_keys_of_both_kinds_order_alike(corpus):
    sentences, df = corpus
    w = F.col("words")
    for r in df.select("sent_key", morph.preorder_key(w).alias("p"), morph.preorder_key(w, 4).alias("r")).collect():
        words = sentences[int(r.sent_key)]
        for keys in (r.p, r.r):
            assert [w["id"] for _, w in sorted(zip(keys, words), key=lambda x: x[0])] == preorder(words)


def test_preorder_ranks_and_sizes(corpus, spark):
    sentences, df = corpus
    rows = {r.sent_key: r.p for r in df.select("sent_key", morph.preorder(F.col("words")).alias("p")).collect()}
    for k, s in enumerate(sentences):
        at = {w["id"]: p for w, p in zip(s, rows[str(k)])}
        assert [i for i, _ in sorted(at.items(), key=lambda x: x[1].rank)] == preorder(s)
        assert {i: p.size for i, p in at.items()} == _below(s)
    cases = [[], [0], [0, 0, 1, 2], [0, 3, 2, 1], [2, 1], [0, 9, 1, 2], [0, None, -1, 1], [1, 0, 2, 2, 4], list(range(70))]
    odd = spark.createDataFrame(to_rows([_heads(h) for h in cases]), SCHEMA)
    got = {int(r.sent_key): r.p for r in odd.select("sent_key", morph.preorder(F.col("words")).alias("p")).collect()}
    pairs = [[p and tuple(p) for p in got[k]] for k in range(len(cases))]
    assert pairs[:2] == [[], [(1, 1)]]
    assert pairs[2] == [(1, 2), (3, 2), (2, 1), (4, 1)]
    assert pairs[3] == [(1, 2), None, None, (2, 1)]
    assert pairs[4] == [None, None]
    assert pairs[5] == [(1, 2), None, (2, 1), None]
    assert pairs[6] == [(1, 2), None, None, (2, 1)]
    assert pairs[7] == [None] + [(1, 4), (2, 1), (3, 2), (4, 1)]
    assert pairs[8] == [(i + 1, 70 - i) for i in range(70)]


def test_a_chain_of_20000_words(spark):
    n = 20_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(
        i.alias("id"), F.lit("w").alias("form"), F.lit("NOUN").alias("upos"), F.lit("dep").alias("deprel"),
        (F.when(i == n, 0).otherwise(i + 1)).cast("int").alias("head"),
        F.when(i % 7 == 0, F.create_map(F.lit("Case"), i.cast("string"))).alias("feats")))
    df = spark.range(1).select(F.lit("s").alias("sent_key"), words.alias("words"))
    ends = df.select(morph.preorder(F.col("words")).alias("p")).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(n - 1)).alias("z")).first()
    assert (tuple(ends.a), tuple(ends.z)) == ((n, 1), (1, n))
    top = mo.top_category_tokens(df, ("sent_key",)).collect()
    assert [(r.category, r.value) for r in top] == [("Case", str(n // 7 * 7))]


def _first(words, category, test):
    at = {w["id"]: w for w in words}
    for i in preorder(words):
        w = at[i]
        if w["feats"] and category in w["feats"] and test(w):
            return w
    return None


@pytest.mark.parametrize("upos,deprel,match", [(None, None, "any"), ("NOUN", None, "any"), (None, "obj", "any"),
                                               ("NOUN", "obj", "any"), ("NOUN", "obj", "all")])
def test_first_token_of_category(corpus, upos, deprel, match):
    sentences, df = corpus
    got = {(r.sent_key, r.category): (r.id, r.value) for r in
           mo.top_category_tokens(df, ("sent_key",), upos, deprel, match).collect()}
    tests = [t for t in (upos and (lambda w: w["upos"] == upos), deprel and (lambda w: w["deprel"] == deprel)) if t]
    joined = (all if match == "all" else any)
    want = {}
    for k, s in enumerate(sentences):
        for c in ("Number", "Tense", "Case"):
            w = _first(s, c, lambda w: not tests or joined(t(w) for t in tests))
            if w:
                want[str(k), c] = (w["id"], w["feats"][c])
    assert got == want


@pytest.mark.parametrize("sorting", mo.SORTINGS)
def test_classify_and_inventory(corpus, sorting):
    sentences, df = corpus
    name = {None: lambda w, d: "no_sorting", "by_pos": lambda w, d: w["upos"], "by_deprel": lambda w, d: d,
            "by_pos_and_deprel": lambda w, d: f"{w['upos']}_{d}"}[sorting]
    inventory = {}
    for s in sentences:
        for w in s:
            for c in w["feats"] or {}:
                inventory.setdefault(name(w, w["deprel"].split(":")[0]), set()).add(c)
    got = {r.subcategory: r.categories for r in mo.category_inventory(df, sorting).collect()}
    assert got == {k: sorted(v) for k, v in inventory.items()}
    assert mo.category_count(df, sorting).first()["n_categories"] == sum(map(len, inventory.values()))
    want = set()
    for k, s in enumerate(sentences):
        for c in ("Number", "Tense", "Case"):
            w = _first(s, c, lambda w: True)
            if w and name(w, w["deprel"]) in inventory:
                want.add((str(k), name(w, w["deprel"]), c, w["feats"][c]))
    rows = [tuple(r) for r in mo.classify(df, ("sent_key",), sorting).select("sent_key", "subcategory", "category", "label").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    with pytest.raises(ValueError):
        mo.classify(df, ("sent_key",), "by_colour")


def _conllu(rng, n, start):
    blocks = []
    for i in range(start, start + n):
        words = random_sentence(rng, 5)
        lines = [f"# text = sentence number {i} ."]
        for w in words:
            feats = "|".join(f"{k}={v}" for k, v in sorted((w["feats"] or {}).items())) or "_"
            lines.append("\t".join([str(w["id"]), w["form"], w["lemma"], w["upos"], w["xpos"] or "_", feats,
                                    str(w["head"]), w["deprel"], "_", "_"]))
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) + "\n"


@pytest.mark.parametrize("files", [1, 2, 3])
def test_convert_by_number_of_files(spark, tmp_path, files):
    rng = random.Random(files)
    names = {1: ["train"], 2: ["train", "dev"], 3: ["train", "dev", "test"]}[files]
    for i, role in enumerate(names):
        (tmp_path / f"xx_toy-ud-{role}.conllu").write_text(_conllu(rng, 60, 100 * i), encoding="utf-8")
    (tmp_path / "xx_toy-extra.conllu").write_text(_conllu(rng, 5, 900), encoding="utf-8")
    out = str(tmp_path / "out")
    tasks = convert_treebanks(spark, str(tmp_path), save_to=out)
    rows = tasks.rows.collect()
    assert {r.task for r in rows} == {"no_sorting_Case", "no_sorting_Number", "no_sorting_Tense"}
    assert {r.lang for r in rows} == {"xx_toy"}
    for task in {r.task for r in rows}:
        mine = [r for r in rows if r.task == task]
        assert len({r.sent_key for r in mine}) == len(mine)
        assert {r.stage for r in mine} == {"tr", "va", "te"}
        number = lambda r: int(r.text.split()[2]) // 100
        if files == 3:
            assert {(number(r), r.stage) for r in mine} == {(0, "tr"), (1, "va"), (2, "te")}
        if files == 2:
            assert {(number(r), r.stage) for r in mine} == {(0, "tr"), (1, "va"), (1, "te")}
            assert abs(sum(r.stage == "va" for r in mine) - sum(r.stage == "te" for r in mine)) <= 1
    back = taskfile.read_tasks(spark, out)
    assert back.count() == len(rows)
    assert {r.status for r in tasks.status.collect()} == {"ok"}
    again = convert_treebanks(spark, tr_path=str(tmp_path / "xx_toy-ud-train.conllu"),
                              te_path=str(tmp_path / "xx_toy-extra.conllu"), sorting="by_pos")
    assert {r.lang for r in again.rows.select("lang").distinct().collect()} <= {"xx_toy"}
    assert {r.status for r in again.status.collect()} >= {"one_class"} or files
    with pytest.raises(ValueError):
        convert_treebanks(spark, te_path="x")


def test_too_small_corpus_is_reported(spark, tmp_path):
    (tmp_path / "yy_t-ud-train.conllu").write_text(_conllu(random.Random(1), 6, 0), encoding="utf-8")
    tasks = convert_treebanks(spark, str(tmp_path))
    assert tasks.rows.count() == 0
    assert {r.status for r in tasks.status.collect()} <= {"not_enough_data", "one_class"}


def test_filter_treebanks(spark, tmp_path):
    for part in (1, 2):
        (tmp_path / f"zz_t-ud-test{part}.conllu").write_text(_conllu(random.Random(part), 80, part * 1000), encoding="utf-8")
    queries = {"OBJ": ({"H": {}, "D": {}}, {("H", "D"): {"deprels": "^obj$"}})}
    out = filter_treebanks(spark, str(tmp_path), queries, "obj", save_to=str(tmp_path / "out"))
    back = taskfile.read_tasks(spark, str(tmp_path / "out"))
    assert back.count() == out.count() > 150
    assert {(r.lang, r.task) for r in back.select("lang", "task").distinct().collect()} == {("zz_t", "obj")}
    assert {r.label for r in back.select("label").distinct().collect()} == {"OBJ", "not_OBJ"}


def test_sentences_left_out_are_counted(spark, tmp_path):
    file = tmp_path / "toy-ud.conllu"
    file.write_text(TOY.rstrip("\n") + "\n\n# sent_id = s4\n# text = round\n1\tround\tround\tADV\t_\t_\t1\troot\t_\t_\n\n")
    tasks = convert_treebanks(spark, tr_path=str(file))
    got = {(r.lang, r.role, r.outcome): r.n for r in tasks.outcomes.collect()}
    assert got == {("toy", "train", "ok"): 2, ("toy", "train", "many_roots"): 1, ("toy", "train", "no_root"): 1}
