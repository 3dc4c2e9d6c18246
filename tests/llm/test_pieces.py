"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import pieces
from corpusloom.llm.pieces import decode_pieces, encode_pieces
from corpusloom.llm.queries import QUERIES, tokenizer_path
from corpusloom.llm.recent import Recent, ids_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tool():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Vocabulary(PATH)


def encoded(model, text):
    return model.encode([text])[0].tolist()


HARD = ["", " ", "  ", "\n", " \n ", "a" * 5000, "ab" * 3000, " " * 3000, "日本" * 2000, "▁", "▁ ▁x", "x​y", "<s></s><unk>",
        "<0x41>", "\x00\x01\x1f", "é́ǆİ", "𝔘𝔫😀", "1.5.2 a.b, c", "empower².ャ", "\r\n\r\n\t\tend.", "�﻿"]


def test_hard_texts(model, tool):
    for text in HARD:  # one by one, and so without the search of many words at once
        assert encoded(model, text) == tool.encode(text), repr(text[:40])
        assert model.decode(tool.encode(text)) == tool.decode(tool.encode(text))


def test_random_texts(model, tool):
    draw, known = random.Random(7), sorted(model.score)
    alphabets = ["ab ", "aeinrst ", " \n\t▁", "abcdefghijklmnopqrstuvwxyzABC .,;0123456789\n ", "日本語мир éüß́​İ 𝔘\x00<s>0xA²"]
    texts = []
    for i in range(30_000):
        kind = i % 7
        if kind < 5:
            texts.append("".join(draw.choices(alphabets[kind], k=draw.randint(0, 40))))
        else:
            texts.append((" " * (draw.randint(0, 20) * (kind - 5))).join(draw.choices(known, k=draw.randint(1, 5))))
    for at in range(0, len(texts), 3000):
        part = texts[at:at + 3000]
        ids, begin = model.encode(part)
        for text, a, b in zip(part, begin, begin[1:]):
            assert ids[a:b].tolist() == tool.encode(text), repr(text)
    for text in texts[:1000]:
        assert encoded(model, text) == tool.encode(text), repr(text)


def test_pairs_leave_the_table(tool, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 64)
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    small, draw = pieces.Vocabulary(PATH), random.Random(11)
    texts = [" ".join("".join(draw.choices("abcdefghinorstu", k=12)) for _ in range(9)) for _ in range(100)]
    ids, begin = small.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == tool.encode(texts)


def test_neighbours_by_merging_whole(model):
    draw, known = random.Random(8), sorted(model.shorter)
    halves = sorted(model.halves.values())
    for i in range(20_000):
        left, right = draw.choice(halves) if i % 3 == 0 else (draw.choice(known), draw.choice(known))
        if i % 3 == 1 and right[:1] in model.shorter and left + right[:1] in model.shorter:
            left, right = left + right[:1], right[1:] or right
        if right in model.shorter:
            assert model.fits(left, right) == (model.merged(left + right)[0] == [left, right])


def test_backtracking_happens(model, tool):
    """The longest piece is not always right: some word needs a step back, and still gets the library's ids."""
    draw, known = random.Random(9), [p for p in sorted(model.halves) if p.isalpha()]
    stepped = 0
    for _ in range(3000):
        word = "".join(draw.choices(known, k=3))
        rest, greedy = pieces.SPACE + word, []
        while rest:
            greedy.append(next(rest[:k] for k in range(len(rest), 0, -1) if rest[:k] in model.shorter))
            rest = rest[len(greedy[-1]):]
        ids = tool.encode(word)
        stepped += [model.number[p] for p in greedy] != ids
        assert encoded(model, word) == ids
    assert stepped > 100


def test_random_ids(model, tool):
    draw, lists = random.Random(10), []
    for i in range(8000):
        k = draw.randint(0, 8)
        if i % 4 < 2:
            lists.append(draw.choices(range(32_000) if i % 2 else [*range(300), 29871], k=k))
        else:
            lists.append(tool.encode("".join(draw.choices("ab é日\n\x00▁", k=k))) + [2] * (i % 4 - 2))
    together = [x for at in range(0, 8000, 100) for x in
                model.decode_lists(pa.array(lists[at:at + 100], pa.list_(pa.int32())).slice(3)).to_pylist()]
    assert together == [tool.decode(x) for i, x in enumerate(lists) if i % 100 >= 3]
    assert [model.decode(x) for x in lists] == [tool.decode(x) for x in lists]
    for wrong in ([5, 32_000], [-1]):
        with pytest.raises(ValueError):
            model.decode(wrong)
        with pytest.raises(ValueError):
            model.decode_lists(pa.array([wrong], pa.list_(pa.int32())))


def test_cache_keeps_hot_words():
    worked = []

    def work(words):
        worked.extend(words)
        return [w.encode() for w in words]

    recent = Recent(3)
    for i in range(50):
        ids, begin = ids_of(pa.array(["hot", f"n{i}", "hot"]), np.array([0, 2, 2, 3]), recent, work, "u1")
        assert bytes(ids).decode() == f"hotn{i}hot" and begin.tolist() == [0, 4 + len(str(i)), 4 + len(str(i)), 7 + len(str(i))]
        assert len(recent.words) + len(recent.old) <= 2 * 3 + 4
    assert worked.count("hot") == 1 and len(worked) == 51


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(tool, rows):
    out = []
    for i, t in rows:
        ids = tool.encode(t or "") + [tool.eos_id()]
        out.append((i, len(ids), digest(" ".join(map(str, ids))), digest(tool.decode(ids))))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)


def write(frame, folder):
    frame.write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_query_odd_rows(odd, pairs, tool, tmp_path):
    got = QUERIES["op13_backtracked_pieces"](odd.sparkSession, write(odd, tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(tool, pairs), key=key)


def test_query_no_rows(empty, tmp_path):
    assert QUERIES["op13_backtracked_pieces"](empty.sparkSession, write(empty, tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_query_small_table(spark, tool):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_backtracked_pieces"](spark, SF).collect())) == sorted(expected(tool, rows))


def test_round_trip_of_the_operators(odd, pairs):
    rows = encode_pieces(odd, PATH, keep=("doc_id", "kept", "__row"), end_id=False)
    assert rows.filter("size(ids) = 0").count() == sum(not t for _, t in pairs)
    back = decode_pieces(rows, PATH).select("row.doc_id", "row.kept", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t or "") for i, t in pairs), key=key)
    assert {r.kept for r in back} == {"clash"}


def test_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 5]), (4, [261])], "k int, ids array<int>")
    assert dict(map(tuple, decode_pieces(rows, PATH).collect())) == {1: None, 2: "", 3: None, 4: "t"}
