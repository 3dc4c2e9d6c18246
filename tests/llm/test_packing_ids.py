"""Token ids of the packing operator against the tokenizer on whole texts."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing
from corpusloom.llm.queries import QUERIES, tokenizer_path

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = tokenizer_path()
HARD = ["", " ", "<|endoftext|>", "a<|endoftext|>.B", "A<|ENDOFTEXT|>b", "ΑΣ. ΑΣΑ, Σa.b", "a.", "a.,", "a,.\n", "a.\n\nb", "don't. 'S 'T",
        "x." * 50, "é́ İ ı ß ẞ", "a​b c", "word### 12.5% a≠b", "\x00\x01 \x1f\x85x", "日本語 мир 😀", "÷×x", "µªº", "a" * 2000]


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(PATH)


def check(tool, texts):
    ids, begin = packing.encode(pa.array(texts, pa.string()), PATH)
    for text, e, a, b in zip(texts, tool.encode_batch(texts, add_special_tokens=False), begin, begin[1:]):
        assert ids[a:b].tolist() == e.ids, repr(text)


def test_hard_texts(tool):
    check(tool, HARD)
    check(tool, [])


def test_random_texts(tool):
    draw = random.Random(1)
    alphabets = ["ab .,", "<|endoftext|> startof", "AaÉéİıßẞΣσς .,'\n\t​́", "it's 12.5 a.b, c.\n", "日本 мир\x00\x01\x1f 𝔘😀 <|",
                 "'sS'tT're'Ll d  　x", "éñüaz!#%&()*+/:;=?@[]^_`{}~"]
    texts = ["".join(draw.choices(alphabets[i % 7], k=draw.randint(0, 30))) for i in range(20_000)]
    texts = [t + " <|startoftext|>." + t.upper() if i % 13 == 0 else t for i, t in enumerate(texts)]
    for at in range(0, len(texts), 500):
        check(tool, texts[at:at + 500])


def test_small_cache(tool, monkeypatch):
    """Words leave the cache many times over and come back."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    packing._loaded.clear()
    draw = random.Random(2)
    for _ in range(50):
        check(tool, [" ".join(f"w{int(draw.expovariate(0.05))}x" for _ in range(30)) for _ in range(5)])
    packing._loaded.clear()


def check_sums(spark, folder, tool, rows):
    want = {i: np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in rows}
    for p in QUERIES["op1_nnls_packing"](spark, folder).collect():
        if p.doc_id in want:
            part = want[p.doc_id][p.start:p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(want[p.doc_id])


def test_check_sums_of_odd_rows(odd, pairs, tool, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [i for i, _ in pairs]
    check_sums(odd.sparkSession, str(tmp_path), tool, [(i, t) for i, t in pairs if ids.count(i) == 1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_check_sums_of_small_table(spark, tool):
    check_sums(spark, SF, tool, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
