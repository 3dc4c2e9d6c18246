"""Probing: texts to layer vectors, one classifier per layer, scores as rows.

Vectors live in a table partitioned by layer. A fit reads the folder of its own
layer; ``pyspark.ml`` trains on the distributed rows. The driver only starts
the fits, a few at a time, and sees scores, never vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from time import time

import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encoder import hashed_ngrams, hashed_tokens
from ..operators.classes import class_counts, class_weights, label_encode, label_map
from ..operators.dims import join_small, settle
from ..operators.metrics import compute_metrics, log_loss
from ..operators.split import assign_parts, control_labels
from ..operators.vectors import (
    dropped_rows, encode_distinct, layer_explode, layer_select, length_filter, length_truncate, pool, text_id,
)
from ..session import fresh_path, persist_table
from ..sources.ledger import Ledger, clustered
from ..sources.runlog import parameters, write_facts
from ..sources.vectors import VectorStore

# Defaults of a probe.
HIDDEN = 256
ENCODE_BATCH = 32
CLASSIFIERS = ("logreg", "mlp", "mdl")
FITS_AT_ONCE = 4
# Share of the uniform code in a code length.
SMOOTHING = 1e-3
SWEEP_FIELDS = "layer int, stage string, metric string, value double, status string"


def encode_layers(rows: DataFrame, key: str, text: str = "text", layers: int = 4, width: int = 32,
                  make_predict_fn: Callable | None = None, batch_size: int = ENCODE_BATCH,
                  store: DataFrame | None = None, pooling: str | None = None, keep_in: str | None = None) -> DataFrame:
    """Long vector table of the rows; each different text goes through the model once.

    The model gives a text all its layers' vectors, end to end. With ``pooling`` it gives each token of the text such a
    row, and these are pooled (``operators.vectors.POOLINGS``). Texts of like length come together in a batch.
    ``keep_in`` is the folder of a store on disk, for one model: only texts that it lacks are encoded, at once, and kept there.
    """
    if pooling is None:
        udf = predict_batch_udf(
            make_predict_fn or hashed_ngrams(layers, width),
            return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
        )
    else:
        udf = token_udf(make_predict_fn or hashed_tokens(layers, width), batch_size)

    def encode(texts: DataFrame) -> DataFrame:
        vectors = texts.sortWithinPartitions(F.length(text)).withColumn("__v", udf(text))
        if pooling is not None:
            # a text without tokens has the vector of nothing
            nothing = F.array_repeat(F.lit(0.0).cast("double"), layers * width)
            vectors = vectors.withColumn("__v", F.coalesce(pool(F.col("__v"), pooling).cast("array<double>"), nothing).cast("array<float>"))
        cut = F.transform(F.sequence(F.lit(0), F.lit(layers - 1)),
                          lambda i: F.slice("__v", i * width + 1, F.lit(width)))
        return vectors.select("text_id", cut.alias("layers"))

    if keep_in is not None:
        disk = VectorStore(rows.sparkSession, keep_in, {"layers": layers, "width": width, "pooling": pooling})
        texts = rows.filter(F.col(text).isNotNull()).groupBy(text_id(text).alias("text_id")).agg(F.first(text).alias(text))
        disk.add(texts, encode)
        # nothing is missing now but a text that is NULL, which has no vector
        store, encode = disk.read(texts), lambda none: none.select("text_id", F.lit(None).cast("array<array<float>>").alias("layers"))
    return layer_explode(encode_distinct(rows, encode, key, text, store))


def token_udf(make_predict_fn: Callable, batch_size: int):
    """A model that gives a row of numbers per token, as a column function; it is loaded once per task."""

    @F.pandas_udf("array<array<float>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for texts in batches:
            rows = []
            for at in range(0, len(texts), batch_size):
                rows += [list(x) for x in predict(texts.iloc[at:at + batch_size].to_numpy())]
            yield pd.Series(rows)

    return run


def fit_length(task: DataFrame, max_len: int | None, too_long: str = "drop", text: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """Texts of at most ``max_len`` tokens, and how many rows of each stage were left out.

    Tokens stand between blanks. Longer texts are dropped with their labels (``drop``), or cut (``cut``).
    """
    if too_long not in ("drop", "cut"):
        raise ValueError("too_long is 'drop' or 'cut'")
    if max_len is None:
        return task, {}
    cut = task.withColumn("__tokens", F.split(text, " "))
    if too_long == "cut":
        return length_truncate(cut, max_len, "__tokens").withColumn(
            text, F.when(F.col(text).isNotNull(), F.array_join("__tokens", " "))).drop("__tokens"), {}
    dropped = {r["stage"]: r["dropped"] for r in dropped_rows(cut, max_len, tokens="__tokens").collect()}
    return length_filter(cut, max_len, "__tokens").drop("__tokens"), dropped


def prepare(vectors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add label numbers and balanced weights; vectors become ML vectors."""
    one = vectors.filter(F.col("layer") == vectors.agg(F.min("layer")).first()[0])
    labelled = label_encode(vectors, label_map(one, by=by), by=by)
    weights = class_weights(one, by=by).select(*by, "label", "weight")
    weighted = join_small(labelled, weights, [*by, "label"], "left")
    return weighted.withColumn("features", array_to_vector("features")).withColumn(
        "label_idx", F.col("label_idx").cast("double"))


def stored(prepared: DataFrame) -> DataFrame:
    """Prepared rows as they are written: vectors as arrays of floats."""
    return prepared.withColumn("features", vector_to_array("features", "float32"))


def store_layers(prepared: DataFrame) -> str:
    """Write the vectors by layer to the shared folder; gives the path."""
    path = fresh_path(prepared.sparkSession, "layers")
    clustered(stored(prepared), "layer").write.partitionBy("layer").parquet(path)
    return path


def load_layer(spark: SparkSession, path: str, layer: int) -> DataFrame:
    rows = spark.read.parquet(path).filter(F.col("layer") == layer)
    return rows.withColumn("features", array_to_vector("features"))


def fit(train: DataFrame, classifier: str, n_classes: int, width: int, max_iter: int = 50,
        seed: int = 42, hidden: int = HIDDEN):
    """A fitted classifier. The loss is balanced by weights, or for the network by repeats.

    ``mdl`` is fitted without weights: a code length is that of the data as they are.
    """
    if classifier in ("logreg", "mdl"):
        model = LogisticRegression(
            family="multinomial", featuresCol="features", labelCol="label_idx", maxIter=max_iter, regParam=1e-4,
        )
        return (model if classifier == "mdl" else model.setWeightCol("weight")).fit(train)
    if classifier == "mlp":
        model = MultilayerPerceptronClassifier(
            layers=[width, hidden, max(n_classes, 2)], featuresCol="features", labelCol="label_idx",
            maxIter=max_iter, seed=seed, blockSize=128,
        )
        return model.fit(repeat_small_classes(train))
    raise NotImplementedError(f"unknown classifier: {classifier}")


def repeat_small_classes(train: DataFrame) -> DataFrame:
    """Rows repeated in proportion to their class weight; every row stays."""
    smallest = train.agg(F.min("weight")).first()[0]
    times = F.greatest(F.round(F.col("weight") / F.lit(smallest)), F.lit(1)).cast("int")
    return train.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).drop("__copy")


def score(model, rows: DataFrame) -> DataFrame:
    """Rows with ``prediction``, ``label`` and the class probabilities as an array."""
    return model.transform(rows).select(
        "stage", F.col("label_idx").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
    )


def probe_scores(rows: DataFrame, classifier: str = "logreg", metrics=("f1", "accuracy"),
                 max_iter: int = 50) -> DataFrame:
    """Train on ``tr``; metrics and mean log loss of every stage: (stage, metric, value)."""
    size = rows.filter("stage = 'tr'").agg(
        (F.max("label_idx") + 1).cast("int").alias("k"), F.max(F.size(vector_to_array("features"))).alias("w")
    ).first()
    model = fit(rows.filter("stage = 'tr'"), classifier, size["k"], size["w"], max_iter)
    scored = score(model, rows)
    loss = log_loss(scored, label="label", by=("stage",)).select(
        "stage", F.lit("log_loss").alias("metric"), F.col("log_loss").alias("value"))
    return compute_metrics(scored, list(metrics), ("stage",)).unionByName(loss)


def code_length(rows: DataFrame, key: str, fractions=(16, 8, 4, 2, 1), max_iter: int = 30,
                seed: int = 42, smoothing: float = SMOOTHING) -> DataFrame:
    """Online code length of the training labels in bits, block by block.

    The training rows are put in seeded order. The first 1/16 is sent with a
    uniform code; each next block with the classifier fitted on all before it.
    The code mixes the classifier's p with the uniform one of k classes,
    (1 - smoothing) * p + smoothing / k, so it stays a code and a class that the
    classifier has not seen yet costs log2(k / smoothing) bits.
    """
    spark = rows.sparkSession
    train = rows.filter("stage = 'tr'").withColumn("__all", F.lit(0))
    total = train.agg(F.count(F.lit(1)).alias("n"), (F.max("label_idx") + 1).cast("int").alias("k")).first()
    n, k = total["n"], total["k"]
    ends = sorted({max(n // f, 1) for f in fractions})
    sizes = [end - start for start, end in zip([0, *ends], ends)]
    quotas = spark.createDataFrame(
        [(0, i, str(i), s) for i, s in enumerate(sizes)], "__all int, pos int, part string, size bigint")
    placed = assign_parts(train, quotas, ["__all"], F.col(key), seed).withColumn("block", F.col("part").cast("int"))
    path = fresh_path(spark, "blocks")
    placed.select("block", key, "label_idx", "weight", vector_to_array("features").alias("features")) \
        .write.partitionBy("block").parquet(path)
    blocks = spark.read.parquet(path).withColumn("features", array_to_vector("features"))
    parts = [spark.createDataFrame([(0, sizes[0], float(sizes[0]) * _log2(k))], "block int, n bigint, bits double")]
    for i in range(1, len(sizes)):
        before = blocks.filter(F.col("block") < i)
        now = blocks.filter(F.col("block") == i)
        if before.select("label_idx").distinct().limit(2).count() < 2:
            # one class so far: nothing to fit, a uniform code
            bits = F.lit(_log2(k))
            coded = now
        else:
            coded = fit(before, "mdl", k, 0, max_iter).transform(now)
            p = F.coalesce(F.get(vector_to_array("probability"), F.col("label_idx").cast("int")), F.lit(0.0))
            bits = -F.log2(F.lit(1 - smoothing) * p + F.lit(smoothing / max(k, 2)))
        parts.append(settle(coded.groupBy(F.lit(i).alias("block")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(bits).alias("bits"))))
    uniform = F.col("n") * F.lit(_log2(k))
    return reduce(DataFrame.unionByName, parts).withColumn("uniform_bits", uniform)


def _log2(k: int) -> float:
    import math

    return math.log2(max(k, 2))


def compression(lengths: DataFrame) -> DataFrame:
    """Total code length and how often it goes into the uniform one."""
    return lengths.agg(
        F.sum("n").alias("n"), F.sum("bits").alias("bits"), F.sum("uniform_bits").alias("uniform_bits")
    ).withColumn("compression", F.col("uniform_bits") / F.col("bits"))


def _probe_one(rows: DataFrame, classifier: str, metrics, max_iter: int, key: str) -> DataFrame:
    if classifier == "mdl":
        total = compression(code_length(rows, key, max_iter=max_iter))
        lengths = total.select(F.lit("tr").alias("stage"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in ("bits", "uniform_bits", "compression")
        ])).alias("m")).select("stage", "m.*")
        return lengths.unionByName(probe_scores(rows, classifier, metrics, max_iter))
    return probe_scores(rows, classifier, metrics, max_iter)


def probe_layers(prepared: DataFrame, key: str, classifier: str = "logreg", metrics=("f1", "accuracy"),
                 probing_type: str = "layerwise", max_iter: int = 50) -> DataFrame:
    """A classifier per layer: (layer, stage, metric, value)."""
    if classifier not in CLASSIFIERS:
        raise NotImplementedError(f"unknown classifier: {classifier}")
    spark = prepared.sparkSession
    path = store_layers(layer_select(prepared, probing_type))
    layers = [r["layer"] for r in spark.read.parquet(path).select("layer").distinct().orderBy("layer").collect()]

    def run(layer: int) -> DataFrame:
        rows = load_layer(spark, path, layer).cache()
        try:
            out = settle(_probe_one(rows, classifier, metrics, max_iter, key))
        finally:
            rows.unpersist()
        return out.select(F.lit(layer).alias("layer"), "stage", "metric", "value")

    with ThreadPoolExecutor(FITS_AT_ONCE) as threads:
        return reduce(DataFrame.unionByName, list(threads.map(run, layers)))


def sweep(prepared: DataFrame | Callable[[], DataFrame], key: str, by: str = "task", classifier: str = "logreg",
          metrics=("f1", "accuracy"), max_iter: int = 50, at_once: int = FITS_AT_ONCE,
          ledger: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """All tasks of a collection and all layers; a failed fit becomes a row with its reason.

    Vectors and the scores of every fit are written to the folder ``ledger`` as they come. A sweep that was stopped
    and is started again with the same ledger reads the vectors there and fits only what has no score yet; fits
    that failed are tried again. A ledger belongs to one input and one set of options; other options are refused.
    ``prepared`` may be a function, which is called only where the ledger lacks the vectors; it needs ``spark``.
    """
    spark = spark or prepared.sparkSession
    book = Ledger(spark, ledger or fresh_path(spark, "sweep")).settle_on("sweep", {
        "by": by, "key": key, "classifier": classifier, "metrics": list(metrics), "max_iter": max_iter})
    make = prepared if callable(prepared) else (lambda: prepared)
    vectors = book.table("layers", lambda: stored(layer_select(make())), by, "layer")
    schema = f"{by} string, {SWEEP_FIELDS}"
    # small jobs: names of folders, not rows of vectors
    pairs = [(r[by], r["layer"]) for r in vectors.select(by, "layer").distinct().orderBy(by, "layer").collect()]
    ready = {(r[by], r["layer"]) for r in
             book.appended("fits", schema).filter("status = 'ok'").select(by, "layer").distinct().collect()}

    def run(pair) -> None:
        task, layer = pair
        try:
            mine = vectors.filter((F.col(by) == task) & (F.col("layer") == layer))
            rows = mine.withColumn("features", array_to_vector("features"))
            out = settle(_probe_one(rows, classifier, metrics, max_iter, key))
            found = out.select(F.lit(str(task)).alias(by), F.lit(layer).cast("int").alias("layer"), "stage", "metric",
                               F.col("value").cast("double").alias("value"), F.lit("ok").alias("status"))
        except Exception as error:
            reason = f"{type(error).__name__}: {error}"
            found = spark.createDataFrame([(str(task), layer, None, None, None, reason)], schema)
        book.append("fits", f"{task}\n{layer}", found)

    with ThreadPoolExecutor(at_once) as threads:
        list(threads.map(run, [p for p in pairs if (str(p[0]), p[1]) not in ready]))
    return book.appended("fits", schema)


def unseen_labels(vectors: DataFrame, by: str = "task") -> DataFrame:
    """Labels of a task that its training rows lack: (by, label)."""
    seen = vectors.filter("stage = 'tr'").select(by, "label").distinct()
    return vectors.select(by, "label").distinct().join(seen, [by, "label"], "left_anti")


def sweep_tasks(vectors: DataFrame, key: str, by: str = "task", ledger: str | None = None, **options) -> DataFrame:
    """``sweep`` of stored vectors (key, by, stage, label, layer, features).

    A task with labels that its training rows lack cannot be scored: it becomes a row that names them,
    without a layer, and the other tasks are fitted. What ``ledger`` holds is not made again.
    """
    spark = vectors.sparkSession
    ledger = ledger or fresh_path(spark, "sweep")
    bad = Ledger(spark, ledger).table("unseen", lambda: unseen_labels(vectors, by).groupBy(by).agg(
        F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("labels")))
    fitted = sweep(lambda: prepare(join_small(vectors, bad.select(by), [by], "left_anti"), (by,)), key, by,
                   ledger=ledger, spark=spark, **options)
    reason = F.concat(F.lit("label not seen in training: "), F.col("labels"))
    return fitted.unionByName(bad.select(by, reason.alias("status")), allowMissingColumns=True)


def run_probe(task: DataFrame | None, key: str, task_language: str | None = None, task_category: str | None = None,
              model_name: str = "hashed-3grams", classifier: str = "logreg", metrics=("f1", "accuracy"),
              control: bool = False, layers: int = 4, width: int = 32,
              make_predict_fn: Callable | None = None, max_iter: int = 50,
              run_id: str = "run", log_to: str | None = None, probing_type: str = "layerwise",
              vectors: DataFrame | None = None, pooling: str | None = None, max_len: int | None = None,
              too_long: str = "drop", batch_size: int = ENCODE_BATCH, file_path: str | None = None,
              keep_in: str | None = None) -> DataFrame:
    """A whole probe of a task (key, stage, label, text) to run facts.

    With ``control`` the labels are permuted within each stage first. Facts are
    written to ``log_to`` when it is given, in place of those of an earlier run of that name.
    Given ``vectors`` (key, stage, label, layer, features) stand in place of the task and nothing is
    encoded; those of ``sources.vectors.from_frame`` have the one layer of ``probing_type="singlerun"``.
    ``keep_in`` keeps vectors on disk from run to run, ``pooling`` takes a model of token vectors, ``max_len`` and ``too_long`` what becomes of long texts. What the run was
    started with, the numbers of the labels, rows of each class and stage, rows left out and the time taken stand in ``params``.
    """
    start, dropped = time(), {}
    permuted = lambda rows, by=(): control_labels(rows, key, by=by).drop("label").withColumnRenamed("control_label", "label")
    if vectors is None:
        task, dropped = fit_length(task, max_len, too_long)
        task = permuted(task) if control else task
        vectors = encode_layers(task, key, layers=layers, width=width, make_predict_fn=make_predict_fn,
                                batch_size=batch_size, pooling=pooling, keep_in=keep_in)
    elif control:
        vectors = permuted(vectors, ("layer",))  # the order hangs on key and seed alone: alike in all layers
    # written once: label tables, weights and fits read the vectors, and the model sees each text once
    vectors = persist_table(vectors, "vectors")
    scores = probe_layers(prepare(vectors), key, classifier, metrics, probing_type, max_iter)
    stage = F.when(F.col("stage") == "va", "val").when(F.col("stage") == "te", "test").otherwise("train")
    one = vectors.filter(F.col("layer") == vectors.agg(F.min("layer")).first()[0])
    sizes = class_counts(one, ("stage",)).collect()  # a row per stage and class
    ratio: dict[str, dict[str, int]] = {}
    for r in sizes:
        ratio.setdefault(r["stage"], {})[str(r["label"])] = r["n"]
    params = parameters({
        "mapped_labels": {label: i for i, label in enumerate(sorted(ratio.get("tr", {})))}, "original_classes_ratio": ratio,
        "probing_type": probing_type, "encoding_batch_size": batch_size, "metric_names": list(metrics), "max_iter": max_iter,
        "pooling": pooling, "max_len": max_len, "too_long": too_long, "excluded_rows": dropped, "file_path": file_path,
        "elapsed_time": round(time() - start, 3)})
    facts = scores.select(
        F.lit(run_id).alias("run_id"), F.lit(task_language).cast("string").alias("task_language"),
        F.lit(task_category).cast("string").alias("task_category"), F.lit(model_name).alias("hf_model_name"),
        F.lit(classifier).alias("classifier_name"), F.lit(control).alias("control"), "layer",
        F.lit(0).alias("epoch"), stage.alias("stage"), "metric", "value",
        F.lit(None).cast("string").alias("log_path"), params.alias("params"),
    )
    if log_to:
        write_facts(facts, log_to)
    return facts
