"""Repeated passages on one or two lines, and copies of texts of one or two lines."""

import random
from collections import defaultdict

from corpusloom.llm.lines import line_dedup

from .conftest import table


def by_hand(rows, size=3, most=50):
    where, filled, gone = defaultdict(list), [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        lines = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate((text or "").split("\n"))]
        lines = [(k, x) for k, x in lines if x]
        filled.append(lines)
        for i in range(len(lines)):
            for k in range(1, size + 1):
                part = [x for _, x in lines[i:i + k]]
                count = [sum(len(x.split()) for x in part[:j]) for j in (k - 1, k)]
                if len(part) == k and (k == size or count[0] <= most < count[1] or (i == 0 and len(lines) == k)):
                    where[tuple(part)].append((n, i))
    for part, places in where.items():
        for n, i in places[1:]:
            if n != places[0][0] or i >= places[0][1] + len(part):
                gone[n].update(range(filled[n][i][0], filled[n][i + len(part) - 1][0] + 1))
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[n]) for n, (_, t) in enumerate(rows)]


def test_long_lines_and_short_texts(spark, tmp_path):
    draw = random.Random(4)
    long = [" ".join(draw.choices("abcdefgh", k=60)) for _ in range(3)]
    half = [" ".join(draw.choices("abcdefgh", k=30)) for _ in range(4)]
    pool = [*long, *half, " " + half[0], "", "x", "y z"]
    rows = [(i, "\n".join(draw.choice([*pool, f"u{draw.random()}"]) for _ in range(draw.randint(0, 9)))) for i in range(150)]
    rows += [(150, "short text"), (151, "short text"), (152, "two\nlines"), (153, "two\nlines\n"), (154, "before\n" + long[0]),
             (155, long[0]), (156, None), (157, "first\nshort text\nlast"), (158, (long[1] + "\n") * 4)]
    table(spark, rows).repartition(4).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r.text for r in line_dedup(docs, passage_words=50).collect()}
    assert got == {i: t for (i, _), t in zip(rows, by_hand(rows))}
    assert got[150] == "short text" and got[151] == "" and got[153] == "" and got[155] == ""
    left = "\n".join(got.values()).split("\n")
    assert all(left.count(x) == 1 for x in long)
