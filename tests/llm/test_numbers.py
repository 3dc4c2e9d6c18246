"""Row numbers that later steps join on stay the same when the scan is split otherwise between two jobs."""

import random

import pytest

from corpusloom.llm import exact, lines, minmax, mixing, warc
from corpusloom.llm.queries import QUERIES
from corpusloom.session import persist_table

from . import brute
from .conftest import table
from .test_more import lines_by_hand

SPLITS = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def moving(spark, monkeypatch):
    """Files are one partition each until a table is written, and all one partition from then on."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}

    def write(df, name, **options):
        out = persist_table(df, name, **options)
        for k, v in SPLITS.items():
            spark.conf.set(k, v)
        return out

    for module in (exact, lines, minmax, mixing, warc, "corpusloom.llm.common"):
        if isinstance(module, str):
            monkeypatch.setattr(f"{module}.persist_table", write, raising=False)
        else:
            monkeypatch.setattr(module, "persist_table", write)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def copies(spark, tmp_path):
    """Rows of six files: 60 texts of several lines, every third one a copy of the one before it, half of these with a word more."""
    draw, rows = random.Random(12), []
    for i in range(60):
        text = "\n".join(" ".join(draw.choices("abcdefghijklmnopq", k=30)) + "." for _ in range(5))
        rows.append((i, rows[-1][1] + " more" * (i % 2) if i % 3 == 2 else text))
    table(spark, rows).repartitionByRange(6, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet")), rows


def test_copies_dropped(copies, moving):
    docs, rows = copies
    assert sorted(r.doc_id for r in exact.drop_copies(docs).collect()) == sorted({k for _, k, _, _ in brute.exact(rows)})


def test_near_copies_dropped(copies, moving):
    docs, rows = copies
    groups = minmax.near_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, groups)) == sorted(brute.near(rows))


def test_one_of_each_near_group(copies, moving):
    docs, rows = copies
    assert sorted(r.doc_id for r in minmax.drop_near_copies(docs).collect()) == sorted({c for _, _, c in brute.near(rows)})


def test_lines_removed(copies, moving):
    docs, rows = copies
    assert [r.text for r in lines.line_dedup(docs).orderBy("doc_id").collect()] == lines_by_hand(rows)


def test_documents_mixed(copies, moving):
    docs, rows = copies
    mixed = mixing.mixed_documents(docs).collect()
    assert abs(sum(len(brute.words(r.text)) for r in mixed) - sum(len(brute.words(t)) for _, t in rows)) <= 3 * 64


def test_archives_written(spark, tmp_path, copies, moving):
    docs, rows = copies
    docs.selectExpr("doc_id AS page_id", "text AS html", "'http://x/' AS url").repartitionByRange(6, "page_id").write.parquet(
        str(tmp_path / "pages.parquet"))
    out = QUERIES["op4_warc_revisits"](spark, str(tmp_path))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(brute.revisits(rows))
