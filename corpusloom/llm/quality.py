"""Quality rules: a ledger of failure bits and measurements, then policies over it.

Every rule looks at a text once. The ledger keeps the measurements and one bit per failed rule;
a policy is a version name with a bit mask, applied without reading texts again. Ablations
(what a policy would keep without one of its rules) come from one aggregation of the bits.
All of it is column expressions: a text never leaves its row, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, split_words, text_of

SYMBOLS = "[^#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

# Rules in the order of their bits; each tells what fails.
RULES: dict[str, str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words",
    "symbols": "4 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "10 * word_chars < 15 * n_words",
    "many_words": "n_words > 100000",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
# Versions are only added; a stored ledger can be read under any of them.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BITS["symbols"] | BITS["repeated_lines"],
    "v2": BASE | BITS["symbols"] | BITS["repeated_lines"] | BITS["long_words"] | BITS["short_words"],
}
CURRENT = "v2"


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words lie in a window of ``size`` words that the text holds twice or more.

    Windows are sorted as numbers, the upper bits from their hash and the lower ones their place,
    so equal windows become neighbours; neighbours are compared word by word before they count.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("long")))  # as many as any place needs

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(size)])

    packed = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.call_function(
        "shiftleft", window(i), bits).bitwiseOR(i.cast("long")))

    def same(ordered: Column, mask: Column, i: Column, j: Column) -> Column:
        a, b = (F.get(ordered, k).bitwiseAND(mask).cast("int") for k in (i, j))
        alike = [F.get(words, a + k) == F.get(words, b + k) for k in range(size)]
        near = F.call_function("shiftrightunsigned", F.get(ordered, i).bitwiseXOR(F.get(ordered, j)), bits) == 0
        out = near
        for x in alike:
            out = out & x
        return out

    def covered(ordered: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        last = F.size(ordered) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda i:
                         F.when(i > 0, same(ordered, mask, i, i - 1)).otherwise(F.lit(False))
                         | F.when(i < last, same(ordered, mask, i, i + 1)).otherwise(F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda i: F.get(ordered, i).bitwiseAND(mask).cast("int")))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(places, start, lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    return F.when(n < size + 1, F.lit(0)).otherwise(let(F.sort_array(packed), covered))


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default, in a struct ``row``), ``__row``, measurements and ``failed``, the failure bits.

    Words are runs of anything but white space; a null or empty text has none. Measurements:
    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines`` (those equal to an earlier one), ``n_repeat_words``. Repeated rows and null ids are
    rows like others; columns of the input clash with nothing, as they stay inside ``row``.
    """
    names = keep if keep is not None else docs.columns
    text = text_of("__text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.col(f"`{text_col}`").alias("__text"))
    rows = rows.select(
        "row", split_words(text).alias("__words"), F.length(F.regexp_replace(text, SPACES, "")).alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r\n")) != "").alias("__lines"))
    # a row number cannot be computed twice, so no filter on measurements is moved below this step, where it
    # would compute them anew for every word
    rows = rows.select(
        "row", F.monotonically_increasing_id().alias("__row"), F.size("__words").cast("long").alias("n_words"), F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"), F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"))
    failed = F.lit(0)
    for name, rule in RULES.items():
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)))
    return rows.withColumn("failed", failed)


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: str = CURRENT, failed: str = "failed") -> DataFrame:
    """Per rule of a policy: ``n_failed``, ``n_alone`` (failed by nothing else), ``n_kept_without`` it.

    Rows are first counted per bit pattern (2 ** number of rules at most), so one pass over the
    ledger answers for all rules.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col(failed).bitwiseAND(F.lit(mask)).alias("__bits")).agg(F.count(F.lit(1)).alias("__n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BITS.items() if bit & mask]
    bit = F.col("__rule.bit")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("__n"))), F.lit(0))
    return patterns.withColumn("__rule", F.explode(F.array(*rules))).groupBy(F.col("__rule.rule").alias("rule")).agg(
        total(F.col("__bits").bitwiseAND(bit) != 0).alias("n_failed"),
        total(F.col("__bits") == bit).alias("n_alone"),
        total(F.col("__bits").bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"))


def drop_failed(docs: DataFrame, text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns."""
    return ledger(docs, text_col).filter(passes(policy) & (F.col("__row") >= 0)).select("row.*")
