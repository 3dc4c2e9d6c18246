import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom import probe_folder, probe_task
from corpusloom.operators import metrics as me
from corpusloom.operators import results as rs
from corpusloom.operators import vectors as ve
from corpusloom.plans import probe
from corpusloom.session import persist_table
from corpusloom.sources import taskfile
from corpusloom.sources.vectors import from_frame


def plain_report(pairs):
    classes = sorted({x for p in pairs for x in p})
    n = len(pairs)
    out = {}
    for k in classes:
        tp = sum(t == p == k for t, p in pairs)
        sup, pred = sum(t == k for t, _ in pairs), sum(p == k for _, p in pairs)
        pr, rc = tp / pred if pred else 0.0, tp / sup if sup else 0.0
        out[str(k)] = (pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0.0, sup)
    acc = sum(t == p for t, p in pairs) / n
    out["accuracy"] = (acc, acc, acc, n)
    rows = [out[str(k)] for k in classes]
    out["macro avg"] = tuple(sum(r[i] for r in rows) / len(rows) for i in range(3)) + (n,)
    out["weighted avg"] = tuple(sum(r[i] * r[3] for r in rows) / n for i in range(3)) + (n,)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_against_plain_python(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 1, 2, 4])) for _ in range(300)]  # 4 is never true
    df = spark.createDataFrame(pairs, "label int, prediction int")
    want = plain_report(pairs)
    got = {r["class"]: r for r in me.classification_report(df).collect()}
    assert set(got) == set(want)
    for k, (p, r, f, s) in want.items():
        assert got[k].support == s
        assert (got[k].precision, got[k].recall, got[k].f1) == pytest.approx((p, r, f))
    assert me.accuracy(df).first()[0] == pytest.approx(want["accuracy"][0])
    assert me.f1_weighted(df).first()[0] == pytest.approx(want["weighted avg"][2])
    both = {r.metric: r.value for r in me.compute_metrics(df, ["f1", "accuracy"]).collect()}
    assert both == pytest.approx({"f1": want["weighted avg"][2], "accuracy": want["accuracy"][0]})
    assert [r.metric for r in me.compute_metrics(df, "f1").collect()] == ["f1"]
    with pytest.raises(NotImplementedError):
        me.compute_metrics(df, ["recall_at_9"])


def test_log_loss_and_argmax(spark):
    df = spark.createDataFrame([([0.2, 0.8], 1), ([0.5, 0.5], 0), ([1.0, 0.0], 1)], "probability array<double>, label_idx int")
    want = -(math.log(0.8) + math.log(0.5) + math.log(1e-15)) / 3
    assert me.log_loss(df).first()[0] == pytest.approx(want)
    assert [r.a for r in df.select(ve.argmax(F.col("probability")).alias("a")).collect()] == [1, 0, 0]


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 9.0]],), ([[1.0, 1.0]],)], "v array<array<double>>")
    got = {how: [r.p for r in df.select(ve.pool(F.col("v"), how).alias("p")).collect()] for how in ve.POOLINGS}
    assert got == {"first": [[1, 2], [1, 1]], "last": [[5, 9], [1, 1]], "sum": [[9, 15], [1, 1]], "avg": [[3, 5], [1, 1]]}
    with pytest.raises(NotImplementedError):
        ve.pool(F.col("v"), "max")


def test_layer_rules(spark):
    df = ve.layer_explode(spark.createDataFrame([(1, [[0.1], [0.2], [0.3]])], "id int, layers array<array<double>>"))
    assert [(r.layer, r.features) for r in df.orderBy("layer").collect()] == [(0, [0.1]), (1, [0.2]), (2, [0.3])]
    assert ve.layer_select(df).count() == 2 and ve.layer_select(df, "singlerun").count() == 1
    with pytest.raises(NotImplementedError):
        ve.layer_select(df, "sometimes")


def test_results(spark):
    cols = "task_language string, task_category string, hf_model_name string, classifier_name string, control boolean, layer int, stage string, metric string, value double, log_path string"
    rows = [("en", "N", "m", "logreg", ctl, layer, "test", "f1", value, f"p{ctl}") for ctl, layer, value in
            [(False, 0, 0.8), (False, 0, 0.6), (True, 0, 0.3), (False, 1, 0.9), (True, 1, 0.4), (False, 2, 0.5)]]
    facts = spark.createDataFrame(rows, cols)
    means = {(r.log_path, r.layer): round(r.metric_scores, 6) for r in rs.aggregate_results(facts).collect()}
    assert means == {("pFalse", 1): 0.7, ("pTrue", 1): 0.3, ("pFalse", 2): 0.9, ("pTrue", 2): 0.4, ("pFalse", 3): 0.5}
    pivot = rs.pivot_results(rs.aggregate_results(facts.filter("not control")), [1, 2, 3]).first()
    assert [round(pivot[str(i)], 6) for i in (1, 2, 3)] == [0.7, 0.9, 0.5]
    gaps = {r.layer: round(r.selectivity, 6) for r in rs.selectivity(facts).collect()}
    assert gaps == {0: 0.4, 1: 0.5}
    with pytest.raises(ValueError):
        rs.aggregate_results(facts, "recall")


@pytest.fixture(scope="module")
def vectors(spark):
    """Two layers: the second tells the classes apart, the first is noise."""
    rng = random.Random(0)
    rows = []
    for i in range(400):
        label = "ab"[i % 4 == 0]
        stage = "tr" if i % 10 < 7 else "va" if i % 10 < 8 else "te"
        shift = 3.0 if label == "a" else -3.0
        for layer in (1, 2):
            rows.append((i, stage, label, layer, [rng.gauss(shift * (layer - 1), 1.0) for _ in range(4)]))
    return spark.createDataFrame(rows, "id int, stage string, label string, layer int, features array<double>")


def test_probe_layers(spark, vectors):
    prepared = probe.prepare(persist_table(vectors, "v"))
    got = {(r.layer, r.stage, r.metric): r.value for r in probe.probe_layers(prepared, "id", max_iter=20).collect()}
    assert got[2, "te", "accuracy"] > 0.97 > 0.85 > got[1, "te", "f1"]
    assert got[2, "te", "log_loss"] < got[1, "te", "log_loss"]
    one = probe.load_layer(spark, probe.store_layers(prepared), 2)
    net = {(r.stage, r.metric): r.value for r in probe.probe_scores(one, "mlp", max_iter=20).collect()}
    assert net["te", "accuracy"] > 0.95
    assert probe.repeat_small_classes(one.filter("stage = 'tr'")).groupBy("label").count().count() == 2
    with pytest.raises(NotImplementedError):
        probe.probe_layers(prepared, "id", "forest")


def test_code_length(spark, vectors):
    prepared = probe.prepare(persist_table(vectors, "v"))
    path = probe.store_layers(prepared)
    totals = {}
    for layer in (1, 2):
        blocks = probe.code_length(probe.load_layer(spark, path, layer), "id", max_iter=15)
        rows = sorted(blocks.collect(), key=lambda r: r.block)
        assert [r.n for r in rows] == [17, 18, 35, 70, 140]
        assert rows[0].bits == rows[0].uniform_bits == 17.0
        totals[layer] = probe.compression(blocks).first()
    assert totals[2].compression > 3 > totals[1].compression


def test_sweep_reports_failures(spark, vectors):
    good = vectors.withColumn("task", F.lit("good"))
    # a task whose training rows have a single class cannot be fitted by the network
    bad = vectors.filter("label = 'a'").withColumn("task", F.lit("bad")).withColumn("features", F.array(F.lit(float("nan"))))
    rows = persist_table(good.unionByName(bad), "v")
    out = probe.sweep(probe.prepare(rows, ("task",)), "id", classifier="mlp", max_iter=5).collect()
    assert {r.status for r in out if r.task == "good"} == {"ok"}
    assert any(r.status != "ok" for r in out if r.task == "bad")


def test_probe_of_a_task_file(spark, tmp_path):
    rng = random.Random(4)
    words = {"0": "alpha beta gamma", "1": "delta omega sigma"}
    lines = [f"{'tr' if i % 5 < 3 else 'va' if i % 5 == 3 else 'te'}\t{i % 2}\t{' '.join(rng.choices(words[str(i % 2)].split(), k=6))}"
             for i in range(120)] + ["tr\t0\talpha alpha"] * 3
    path = tmp_path / "en_toy_Letters.csv"
    path.write_text("\n".join(lines) + "\n")
    facts = probe_task(spark, str(path), log_to=str(tmp_path / "facts"), layers=2, max_iter=15)
    got = {(r.stage, r.metric): r for r in facts.filter("layer = 1").collect()}
    assert got["test", "f1"].value > 0.9
    assert (got["test", "f1"].task_language, got["test", "f1"].task_category) == ("en", "Letters")
    assert spark.read.parquet(str(tmp_path / "facts")).count() == facts.count()


def toy_lines(rng, n=90):
    words = {"0": "alpha beta gamma", "1": "delta omega sigma"}
    return [("tr" if i % 5 < 3 else "va" if i % 5 == 3 else "te", str(i % 2), " ".join(rng.choices(words[str(i % 2)].split(), k=6)))
            for i in range(n)]


def test_probe_of_a_folder_of_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [("en", "good", *r) for r in toy_lines(rng)] + [("de", "good", *r) for r in toy_lines(rng)]
    rows += [("en", "bad", *r) for r in toy_lines(rng, 30)] + [("en", "bad", "te", "new", "alpha")]
    taskfile.write_tasks(spark.createDataFrame(rows, "lang string, task string, stage string, label string, text string"), str(tmp_path / "tasks"))
    out = probe_folder(spark, str(tmp_path / "tasks"), layers=2, max_iter=10).collect()
    good = {(r.lang, r.stage, r.metric): r for r in out if r.task == "good"}
    assert {r.status for r in good.values()} == {"ok"} and {k[0] for k in good} == {"en", "de"}
    assert good["de", "te", "f1"].value > 0.9
    assert [(r.lang, r.layer, r.metric, r.status) for r in out if r.task == "bad"] == [
        ("en", None, None, "label not seen in training: new")]


def test_keys_of_task_rows(spark):
    rows = [("tr", "a", "x")] * 25 + [("tr", "a", "y"), ("te", None, "y"), ("te", "y", None)]
    fields = "stage string, label string, text string"
    a = sorted(map(str, taskfile.with_keys(spark.createDataFrame(rows, fields), 10).collect()))
    b = sorted(map(str, taskfile.with_keys(spark.createDataFrame(rows[::-1], fields).repartition(7), 4).collect()))
    assert a == b and len(set(a)) == len(rows)
    kept = taskfile.with_keys(spark.createDataFrame(rows, fields))
    assert kept.select("key").distinct().count() == len(rows)
    assert Counter(map(tuple, kept.drop("key").collect())) == Counter(rows)


def test_probe_of_given_vectors(spark, vectors):
    given = from_frame(vectors.filter("layer = 2"), "features", "label", "stage", "id")
    facts = {(r.layer, r.stage, r.metric): r.value for r in probe.run_probe(
        None, "sample_id", vectors=given, probing_type="singlerun", max_iter=10).collect()}
    assert facts[0, "test", "accuracy"] > 0.97
    control = {(r.stage, r.metric): r.value for r in probe.run_probe(
        None, "sample_id", vectors=given, probing_type="singlerun", max_iter=10, control=True).collect()}
    assert control["test", "accuracy"] < 0.85


def test_code_length_probe_gives_the_metrics_too(spark, vectors):
    prepared = probe.prepare(persist_table(vectors.filter("layer = 2"), "v"))
    got = {(r.stage, r.metric): r.value for r in probe.probe_layers(prepared, "id", "mdl", max_iter=10).collect()}
    assert got["te", "f1"] > 0.95 and got["tr", "compression"] > 3


def test_smoothing_of_a_code_length(spark):
    """All of it is the uniform code, one bit a label; a little leaves the model's."""
    rows = [(i, "tr", "ab"[i % 2], 1, [float(i % 2)]) for i in range(64)]
    rows = spark.createDataFrame(rows, "id int, stage string, label string, layer int, features array<double>")
    prepared = probe.prepare(persist_table(rows, "v"))
    sums = [probe.compression(probe.code_length(prepared, "id", max_iter=10, smoothing=s)).first().bits for s in (1e-3, 1.0)]
    assert sums[1] == pytest.approx(64) and sums[0] < 30


def test_encoder_runs_once_per_text_and_uses_the_store(spark):
    rows = spark.createDataFrame([(i, f"text number {i % 7}") for i in range(50)], "id int, text string")
    out = probe.encode_layers(rows, "id", layers=3, width=8)
    assert out.count() == 150
    by_text = out.withColumn("k", F.col("id") % 7).groupBy("k", "layer").agg(F.countDistinct("features").alias("n"))
    assert {r.n for r in by_text.collect()} == {1}
    assert Counter(len(r.features) for r in out.collect()) == {8: 150}
