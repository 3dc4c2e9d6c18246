"""Spans of secrets."""

import pytest

from corpusloom.llm.pii import KINDS, candidates

from .conftest import table


@pytest.mark.parametrize("length", [6, 200, 201, 5000, 200_000])
def test_span_covers_the_whole_value(spark, tmp_path, length):
    value = ("aB3-_." * length)[:length]
    table(spark, [(1, f'export token="{value}" and more')]).write.parquet(str(tmp_path / "t"))
    found = candidates(spark.read.parquet(str(tmp_path / "t"))).filter(f"kind = {KINDS.index('secret')}").collect()
    assert [(r.start, r.end) for r in found] == [(7, 14 + length)]
