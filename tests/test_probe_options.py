"""Options of a whole probe: pooling, long texts, and the parameters that its facts carry."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.encoder import hashed_tokens
from corpusloom.plans import probe
from corpusloom.sources import runlog

WORDS = {"fruit": ["apple", "pear", "plum", "fig"], "tool": ["hammer", "saw", "drill", "axe"]}


def task(spark, n=120):
    rows = []
    for i in range(n):
        label = "fruit" if i % 2 else "tool"
        words = [WORDS[label][(i // k) % 4] for k in (1, 3, 5)][:1 + i % 3] + ["x"] * (5 if i % 10 == 0 else 0)
        rows.append((i, ("tr", "tr", "tr", "va", "te")[i // 2 % 5], label, " ".join(words)))
    return rows, spark.createDataFrame(rows, "key long, stage string, label string, text string").repartition(3)


def test_pooled_vectors(spark):
    rows = [(1, "a bb ccc"), (2, "dddd"), (3, ""), (4, "a bb ccc")]
    df = spark.createDataFrame(rows, "key long, text string")
    predict = hashed_tokens(2, 5)()
    by_hand = {i: predict(np.array([t], dtype=object))[0] for i, t in rows}
    merge = {"first": lambda m: m[0], "last": lambda m: m[-1], "sum": lambda m: m.sum(axis=0), "avg": lambda m: m.mean(axis=0)}
    for how, fold in merge.items():
        out = probe.encode_layers(df, "key", layers=2, width=5, pooling=how).collect()
        assert len(out) == 8
        for r in out:
            want = fold(by_hand[r.key]) if len(by_hand[r.key]) else np.zeros(10)
            np.testing.assert_allclose(r.features, want[5 * r.layer:5 * r.layer + 5], atol=1e-5)
    with pytest.raises(NotImplementedError):
        probe.encode_layers(df, "key", pooling="median")


def test_long_texts(spark):
    rows, df = task(spark)
    kept, dropped = probe.fit_length(df, 5)
    want = [r for r in rows if len(r[3].split(" ")) <= 5]
    assert sorted(map(tuple, kept.collect())) == want and kept.columns == df.columns
    assert sum(dropped.values()) == len(rows) - len(want) > 0
    cut, none = probe.fit_length(df, 2, "cut")
    assert none == {}
    assert sorted(map(tuple, cut.collect())) == [(*r[:3], " ".join(r[3].split(" ")[:2])) for r in rows]
    assert probe.fit_length(df, None)[0] is df
    with pytest.raises(ValueError):
        probe.fit_length(df, 2, "wrap")
    odd = spark.createDataFrame([(1, "tr", "a", None), (2, "tr", "a", "")], df.schema)
    assert [r.text for r in probe.fit_length(odd, 1, "cut")[0].orderBy("key").collect()] == [None, ""]


def test_parameters_of_a_run(spark, tmp_path):
    rows, df = task(spark)
    facts = probe.run_probe(df, "key", "en", "things", layers=2, width=8, max_iter=5, pooling="avg", max_len=5, metrics=("f1",),
                            run_id="r1", log_to=str(tmp_path / "facts"), file_path="/tasks/en_things.csv", batch_size=16)
    assert facts.filter("metric = 'f1' AND stage = 'test'").count() == 1
    back = spark.read.parquet(str(tmp_path / "facts")).select(
        runlog.parameter("mapped_labels", "map<string,long>").alias("labels"),
        runlog.parameter("original_classes_ratio", "map<string,map<string,long>>").alias("ratio"),
        runlog.parameter("excluded_rows", "map<string,long>").alias("excluded"), runlog.parameter("pooling").alias("pooling"),
        runlog.parameter("encoding_batch_size", "long").alias("batch"), runlog.parameter("file_path").alias("path"),
        runlog.parameter("probing_type").alias("type"), runlog.parameter("nothing").alias("nothing"),
        runlog.parameter("elapsed_time", "double").alias("seconds")).collect()
    assert len(back) == facts.count() and all(b == back[0] for b in back)
    r = back[0]
    assert r.labels == {"fruit": 0, "tool": 1} and r.pooling == "avg" and r.batch == 16
    assert r.path == "/tasks/en_things.csv" and r.type == "layerwise" and r.nothing is None and r.seconds > 0
    kept = [x for x in rows if len(x[3].split()) <= 5]
    assert r.ratio == {s: {c: n for c in WORDS if (n := sum(x[1] == s and x[2] == c for x in kept))} for s in ("tr", "va", "te")}
    assert sum(r.excluded.values()) == len(rows) - len(kept)


def test_parameters_of_logs(spark, tmp_path):
    params = {"task_language": "de", "task_category": "Case", "hf_model_name": "m", "classifier_name": "mlp",
              "metric_names": ["f1"], "probing_type": "layerwise", "mapped_labels": {"Nom": 0}}
    for i, more in enumerate(({}, {"classifier_name": 7, "extra": {"deep": [1, 2]}})):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "log.json").write_text(json.dumps({
            "params": params | more, "results": {"test_score": {"f1": [0.5, 0.75]}, "val_score": {"f1": [0.25, 0.5]}}}))
    logs = runlog.read_logs(spark, str(tmp_path))
    scores = runlog.log_scores(logs)
    assert scores.filter("task_language = 'de'").count() == 8
    assert logs.filter(runlog.parameter("extra.deep[1]", "int") == 2).count() == 1
    assert {r.m for r in logs.select(runlog.parameter("metric_names", "array<string>").alias("m").cast("string")).collect()} == {"[f1]"}
    assert scores.filter(F.col("classifier_name").isNull()).isEmpty()
