"""Record ids of archives, and what the records say of their blocks."""

import base64
import gzip
import hashlib
import pathlib

from pyspark.sql import functions as F

from corpusloom.llm import warc


def records(path):
    return [r for f in sorted(pathlib.Path(path).glob("*.gz")) for r in warc.parse(gzip.open(f).read())]


def test_ids_of_two_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"text {i // 2}", f"http://x/{i}") for i in range(20)], "page_id long, html string, url string")
    first = warc.write_archives(pages, str(tmp_path / "a"))
    other = warc.write_archives(pages.withColumn("html", F.concat("html", F.lit("!"))), str(tmp_path / "b"))
    ids = [[h["warc-record-id"] for h, _ in records(p)] for p in (first, other)]
    assert len(set(ids[0]) | set(ids[1])) == 40
    assert {r.record_id for r in warc.read_archives(spark, first).collect()} == set(ids[0])


def test_revisits_name_their_response(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"text {i // 4}", f"http://x/{i}") for i in range(20)], "page_id long, html string, url string")
    found = records(warc.write_archives(pages, str(tmp_path / "a")))
    by_id = {h["warc-record-id"]: (h, body) for h, body in found}
    assert sum(h["warc-type"] == "revisit" for h, _ in found) == 15
    for h, body in found:
        digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert h["warc-block-digest"] == digest and int(h["content-length"]) == len(body)
        if h["warc-type"] == "revisit":
            target, payload = by_id[h["warc-refers-to"]]
            assert target["warc-type"] == "response" and target["warc-payload-digest"] == h["warc-payload-digest"]
            assert h["warc-refers-to-date"] == target["warc-date"] and payload
