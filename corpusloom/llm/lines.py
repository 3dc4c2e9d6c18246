"""Line dedup by overlapping windows of three lines.

Lines with a word are hashed, three in a row at a time. Windows that occur again anywhere are found in one aggregation over
hashes; the first occurrence (smallest id, then place) stays, and the lines of all later ones are removed:
their ranges are merged per document and what lies between them is joined again.
With ``passage_words`` there are shorter windows too: one or two lines of more words than that, and whole texts of
fewer than three lines.
Hashes are 128 bits, and only they, ids and places are shuffled, but for the texts that lose lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .common import by_group, numbered, run_of, split_words, stored, text_of

BLANK = " \t\x0b\x0c\r"
PASSAGE_WORDS = 50


def _filled(lines: Column) -> Column:
    """(place, line without outer blanks) of lines with a word."""
    pairs = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(BLANK)).alias("line")))
    return F.filter(pairs, lambda p: p["line"] != "")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
            passage_words: int | None = None) -> DataFrame:
    """``__row``, id, ``nth`` filled line, ``first`` and ``last`` line, ``n`` lines and the hash (k1, k2) of each window, stored.

    Documents with fewer filled lines than ``size`` have none, unless ``passage_words`` is given: then such a text is a
    window, and so are the fewest lines from a line on that have more words, if they are fewer than ``size``.
    """
    rows = numbered(docs, __id=id_col, __text=text_col)
    rows = rows.select("__row", "__id", _filled(F.split(text_of("__text"), "\n")).alias("__lines"))
    n = F.size("__lines")
    line = lambda k: F.get("__lines", F.col("nth") + k)

    def window(k: int) -> Column:
        parts = [line(i)["line"] for i in range(k)]
        return F.struct(line(0)["at"].alias("first"), line(k - 1)["at"].alias("last"), F.lit(k).alias("n"),
                        F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))

    if passage_words is None:
        rows = rows.withColumn("nth", F.explode(F.when(n >= size, F.sequence(F.lit(0), n - size))))
        return persist_table(rows.select("__row", "__id", "nth", window(size).alias("__w")).select(
            "__row", "__id", "nth", "__w.*"), "windows")
    rows = rows.withColumn("__counts", F.transform("__lines", lambda x: F.size(split_words(x["line"]))))
    rows = rows.withColumn("nth", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    words = [F.lit(0)]
    for k in range(size - 1):
        words.append(words[-1] + F.get("__counts", F.col("nth") + k))  # null beyond the last line
    wanted = [((words[k] > passage_words) & (words[k - 1] <= passage_words)) | ((n == k) & (F.col("nth") == 0))
              for k in range(1, size)]
    wanted.append(F.col("nth") + size <= n)
    found = F.array_compact(F.array(*[F.when(w, window(k)) for k, w in enumerate(wanted, 1)]))
    return persist_table(rows.select("__row", "__id", "nth", F.inline(found)), "windows")


def covered(found: DataFrame) -> DataFrame:
    """``__row`` and ``__ranges``, the sorted (first, last) lines of its later occurrences.

    In one document an occurrence that overlaps the first one is not a later one, so a line repeated
    many times keeps a whole window.
    """
    who = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"), "nth")
    groups = by_group(found, ["k1", "k2"], who).filter("__rows > 1")
    later = (F.col("__row") != F.col("__best.row")) | (F.col("nth") >= F.col("__best.nth") + F.col("n"))
    return found.withColumn("__run", run_of()).join(groups, ["__run", "k1", "k2"]).filter(later).groupBy("__row").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("__ranges"))


def _outside(lines: Column, ranges: Column) -> Column:
    """Lines in none of the ranges."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("next"))

    def step(acc: Column, r: Column) -> Column:
        between = F.slice(lines, acc["next"] + 1, F.greatest(r["first"] - acc["next"], F.lit(0)))
        return F.struct(F.concat(acc["kept"], between).alias("kept"), F.greatest(acc["next"], r["last"] + 1).alias("next"))

    return F.aggregate(ranges, start, step, lambda acc: F.concat(
        acc["kept"], F.slice(lines, acc["next"] + 1, F.size(lines))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
               passage_words: int | None = None) -> DataFrame:
    """One row per input row: ``__row``, id, ``text`` without later occurrences, ``n_lines`` before and ``n_removed``.

    ``passage_words`` removes repeats of fewer lines too, if they have more words or are a whole text (see ``windows``).
    Lines end at line feeds; outer blanks do not count, and lines without a word are removed only within a window.
    Null text counts as empty. Null ids come after others, rows that share an id in the order of
    rows. An empty table gives an empty result.
    """
    docs = stored(docs, id_col, text_col)
    rows = numbered(docs, __id=id_col, __text=text_col).withColumn("__text", text_of("__text"))
    gone = covered(windows(docs, id_col, text_col, size, passage_words))
    rows = rows.join(gone, "__row", "left")
    lines = F.split("__text", "\n")
    kept = F.when(F.col("__ranges").isNull(), lines).otherwise(_outside(lines, F.col("__ranges")))
    return rows.select("__row", F.col("__id").alias(id_col), F.size(lines).cast("long").alias("n_lines"), kept.alias("__kept")).select(
        "__row", id_col, F.array_join("__kept", "\n").alias("text"), "n_lines",
        (F.col("n_lines") - F.size("__kept")).alias("n_removed"))
