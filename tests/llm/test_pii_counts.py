"""Counts of found spans, check sums of base spans, and planted secrets that the method has to find."""

import hashlib
import random

from pyspark.sql import functions as F

from corpusloom.llm.queries import QUERIES

from . import brute
from .conftest import table


def test_counts_and_check_sums(spark, odd, pairs, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op9_personal_data"](spark, str(tmp_path)).collect()
    want = sorted((str(i), *brute.personal(t)[0], hashlib.sha256(brute.personal(t)[1].encode()).hexdigest()) for i, t in pairs)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    for r in out:
        assert r.n_spans == len(list(filter(None, r.spans.split(","))))
        assert r.n_added == r.n_spans - r.n_email - r.n_ip - r.n_card - r.n_phone >= 0


def test_planted_secrets(spark, tmp_path):
    draw, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, planted = [], set()
    for i in range(400):
        words = [draw.choice(["the", "garden", "was", "quiet", "and", "old"]) for _ in range(60)]
        if i % 8 == 0:
            planted.add(i)
            words.insert(draw.randrange(60), draw.choice(["password: ", "api_key = ", "secret="]) + "".join(draw.choices(letters, k=24)))
        if i % 5 == 0:
            words.insert(3, f"user{i}@mail.example.org")
        rows.append((i, " ".join(words)))
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op9_personal_data"](spark, str(tmp_path)).filter(F.col("n_added") > 0).collect()
    found = {r.doc_id for r in out}
    assert found <= planted and len(found) >= 0.9 * len(planted)
