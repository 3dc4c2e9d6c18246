"""Registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_table
from . import packing, warc
from .common import arrow_rows, read_table
from .exact import exact_dedup
from .infill import fill_in_middle, restored
from .licenses import scan_licenses
from .lines import PASSAGE_WORDS, line_dedup
from .minmax import near_groups
from .mixing import mix
from .oracles import ORACLES  # noqa: F401  (taken up by the entry points)
from .pieces import decode_pieces, encode_pieces
from .pii import find_personal_data
from .quality import BASE, POLICIES, ablations, ledger, passes
from .resampling import resample
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_nnls_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, folder, "documents"), tokenizer_path())
    with arrow_rows(spark, 1000):
        return persist_table(packing.digests(pieces), "pieces")


@query
def op2_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(read_table(spark, folder, "documents"), read_table(spark, folder, "labels")).drop("__row")


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read_table(spark, folder, "documents"))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger(read_table(spark, folder, "documents"), keep=["doc_id"])
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return rows.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes()).alias("kept"), F.col("failed").cast("long").alias("failed_bits"),
        "n_lines")


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read_table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op4_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.rewrite(read_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(read_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(read_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op8_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return line_dedup(docs, passage_words=PASSAGE_WORDS).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(read_table(spark, folder, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans", "n_added")


@query
def op10_minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(read_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op11_cholesky_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(read_table(spark, folder, "embeddings")).select(
        "row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query
def op12_wavelet_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle(read_table(spark, folder, "documents"))
    return cut.select(
        "row.doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op13_backtracked_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    rows = encode_pieces(read_table(spark, folder, "documents"), model).select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    texts = decode_pieces(rows, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
    with arrow_rows(spark, 1000):
        return persist_table(texts, "digests")


@query
def op5_rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each policy does, from the stored ledger: measured once, read by one narrow column."""
    rows = ledger(read_table(spark, folder, "documents"), keep=["doc_id"])
    rows = persist_table(rows.drop("__row"), "ledger", compression="zstd")
    return reduce(DataFrame.unionByName, [ablations(rows, p).withColumn("policy", F.lit(p)) for p in POLICIES])
