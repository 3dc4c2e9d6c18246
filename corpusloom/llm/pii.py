"""Personal data by weak supervision.

Patterns propose spans. Four labelers look at each: the strict pattern with its checks, a gazetteer
(top-level domains, issuer prefixes, country codes), words of the context, and the shape. Each
votes yes, no, or abstains. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern means personal data; a logistic classifier of votes and kind is
fitted to these likelihoods and decides about spans. Spans of the base patterns always stay.

Texts are read once, by column expressions. Vote patterns are few whatever the corpus (kinds x 3 ** labelers), so their
counts, over all spans of all texts, are what the driver sees.

Patterns are written so that matching takes linear time and no stack: repeats are possessive where what follows
cannot be part of them, and a match begins at the start of a run or right after the last match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_table
from .common import let, numbered, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "local", "secret")
LABELERS = ("strict", "gazetteer", "context", "shape")
CONTEXT = 32  # characters before a span that the context labeler reads

PATTERNS: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+().\x20-])\x20?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?:(?i:password|passwd|secret|token|api_?key)\x20{0,2}[=:]\x20{0,2}\x22?[^\s\x22]{6,}+|AKIA[0-9A-Z]{16})",
}
# Words that the context labeler takes as a yes, or as a no, for a kind.
YES_WORDS = {
    "email": "mail|contact|write|reply|send", "ip": "ip|host|server|address|login", "card": "card|visa|credit|pay|account",
    "phone": "call|phone|tel|fax|mobile|contact", "ssn": "ssn|social|security", "local": "call|phone|tel|fax|mobile|contact",
    "secret": "login|user|key|auth|secret|export",
}
NO_WORDS = {
    "email": "example of", "ip": "version|release|section|build", "card": "isbn|order|serial|invoice|ticket",
    "phone": "score|sum|plus", "ssn": "part|serial|order", "local": "isbn|order|serial|invoice", "secret": "reset your|forgot",
}
# Common top-level domains and the first digits of card numbers and of international numbers.
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|it|uk|us|eu|nl|ch|at|pl|ru|cn|jp|br|in|ca|au"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[4-8]|6(?:011|4|5))"
COUNTRIES = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind: (kind, nth, match, length of the text before it since the last match, context)."""
    pattern = PATTERNS[kind]
    empty = F.array().cast("array<struct<kind:int,nth:int,span:string,gap:int,context:string>>")

    def placed(matches: Column) -> Column:
        def one(pieces: Column) -> Column:
            return F.transform(matches, lambda m, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), m.alias("span"),
                F.length(F.get(pieces, i)).alias("gap"),
                F.lower(F.right(F.get(pieces, i), F.lit(CONTEXT))).alias("context")))

        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), one)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def one(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, b: a + b) % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, 0 for no, 2 for an abstention."""
    return F.when(yes, 1).when(~yes if no is None else no, 0).otherwise(2)


def _by_kind(choices: dict[str, Column]) -> Column:
    out = F.lit(2)
    for kind, vote in choices.items():
        out = F.when(F.col("kind") == KINDS.index(kind), vote).otherwise(out)
    return out


def votes() -> dict[str, Column]:
    """The labelers as columns of ``kind``, ``span`` and ``context``."""
    span, context = F.col("span"), F.col("context")
    digits = F.regexp_replace(span, "[^0-9]+", "")
    n = F.length(digits)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    valid_ip = span.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    return {
        "strict": _by_kind({
            "email": F.lit(1), "ip": _vote(valid_ip),
            "card": _vote(F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))),
            "phone": _vote((n >= 8) & (n <= 15)), "ssn": F.lit(2), "local": F.lit(2),
            "secret": _vote(span.rlike("^AKIA"), F.lit(False))}),
        "gazetteer": _by_kind({
            "email": _vote(F.lower(span).rlike(rf"\.(?:{DOMAINS})$")),
            "ip": _vote(~span.rlike(r"^(?:0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$")),
            "card": _vote(digits.rlike(ISSUERS)), "phone": _vote(digits.rlike(COUNTRIES)),
            "ssn": _vote(~span.rlike("^(?:000|666|9)")), "local": _vote(~digits.rlike("^[01]")),
            "secret": _vote(span.rlike("^(?i:password|passwd|token|secret|api)|^AKIA"))}),
        "context": _by_kind({k: _vote(context.rlike(rf"\b(?:{YES_WORDS[k]})"), context.rlike(rf"\b(?:{NO_WORDS[k]})"))
                             for k in KINDS}),
        "shape": _by_kind({
            "email": _vote(F.length(span) <= 80), "ip": _vote(F.length(span) >= 8),
            "card": _vote(span.rlike(r"^(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})$")),
            "phone": _vote((n >= 10) & (n <= 13)), "ssn": _vote(~digits.rlike("0000$|^...00")),
            "local": _vote(span.rlike(r"\(")), "secret": _vote(span.rlike("[0-9]") & span.rlike("[A-Za-z]"))}),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proposed spans with their votes, and one row with a null kind for a text without any, stored.

    Columns: ``__row``, id, ``kind`` (place in KINDS), ``start``, ``end`` (code points, end exclusive), ``base``
    (a base span) and one column per labeler.
    """
    rows = numbered(docs, __id=id_col, __text=text_of(F.col(f"`{text_col}`")))
    found = F.concat(*[_found(F.col("__text"), k) for k in KINDS])
    rows = rows.select("__row", "__id", F.explode_outer(found).alias("__f")).select("__row", "__id", "__f.*")
    before = Window.partitionBy("__row", "kind").orderBy("nth")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(before).cast("long"))
    rows = rows.withColumn("start", F.col("end") - F.length("span"))
    rows = rows.select("__row", F.col("__id").alias(id_col), "kind", "start", "end",
                       *[v.cast("int").alias(name) for name, v in votes().items()])
    base = (F.col("kind") < len(BASE_KINDS)) & (F.col("strict") == 1)
    return persist_table(rows.withColumn("base", F.coalesce(base, F.lit(False))), "spans")


def fit_reliability(counts: dict[tuple, int], rounds: int = 100) -> tuple[list[tuple[float, float]], dict[tuple, float]]:
    """EM over patterns (kind, vote, vote, ...) with counts.

    Gives for each labeler the chances of a yes for personal data and for other spans (of its votes, without
    abstentions), and for each pattern the chance that it is personal data. Starts from labelers that are
    right four times of five, and smooths by one vote on each side.
    """
    labelers = len(LABELERS)
    yes, no = [0.8] * labelers, [0.2] * labelers
    kinds = sorted({p[0] for p in counts})
    prior = {k: 0.5 for k in kinds}
    chance: dict[tuple, float] = {}
    for _ in range(rounds):
        for p in sorted(counts):
            odds = math.log(prior[p[0]] / (1 - prior[p[0]]))
            for j, vote in enumerate(p[1:]):
                if vote != 2:
                    a, b = (yes[j], no[j]) if vote else (1 - yes[j], 1 - no[j])
                    odds += math.log(a / b)
            chance[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for k in kinds:
            own = [(counts[p], chance[p]) for p in sorted(counts) if p[0] == k]
            prior[k] = (1 + sum(n * c for n, c in own)) / (2 + sum(n for n, _ in own))
        for j in range(labelers):
            cast = [(p[1 + j], counts[p], chance[p]) for p in sorted(counts) if p[1 + j] != 2]
            yes[j] = (1 + sum(n * c for v, n, c in cast if v)) / (2 + sum(n * c for _, n, c in cast))
            no[j] = (1 + sum(n * (1 - c) for v, n, c in cast if v)) / (2 + sum(n * (1 - c) for _, n, c in cast))
    return list(zip(yes, no)), chance


def _features(pattern: tuple) -> list[float]:
    return [1.0 if pattern[0] == k else 0.0 for k in range(len(KINDS))] + [{1: 1.0, 0: -1.0, 2: 0.0}[v] for v in pattern[1:]]


def fit_classifier(counts: dict[tuple, int], chance: dict[tuple, float], rounds: int = 500, rate: float = 1.0,
                   penalty: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier of kind and votes, fitted to the chances, patterns weighted by their logarithms."""
    rows = [(_features(p), math.log1p(counts[p]), chance[p]) for p in sorted(counts)]
    total = sum(w for _, w, _ in rows) or 1.0
    weights = [0.0] * (len(KINDS) + len(LABELERS))
    for _ in range(rounds):
        slope = [penalty * w for w in weights]
        for x, n, y in rows:
            miss = (score(weights, x) - y) * n / total
            for i, v in enumerate(x):
                if v:
                    slope[i] += miss * v
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def score(weights: list[float], features: list[float]) -> float:
    z = sum(w * x for w, x in zip(weights, features))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def classify(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``spans`` with ``chance`` of personal data and ``found``: base spans, and others from the threshold on."""
    cols = ["kind", *LABELERS]
    counted = spans.filter("kind IS NOT NULL").groupBy(*cols).count().collect()  # one row per vote pattern
    counts = {tuple(r[c] for c in cols): r["count"] for r in counted}
    _, chance = fit_reliability(counts)
    weights = fit_classifier(counts, chance)
    table = [(*p, score(weights, _features(p))) for p in sorted(counts)]
    scored = spans.sparkSession.createDataFrame(table, ", ".join(f"{c} int" for c in cols) + ", chance double")
    out = spans.join(F.broadcast(scored), cols, "left")
    return out.withColumn("found", F.col("base") | (F.coalesce(F.col("chance"), F.lit(0.0)) >= threshold))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, ``n_<kind>`` of base spans, ``base_spans`` and ``spans`` (kind:start:end, by kind
    in the order of KINDS, then by start, comma-joined), ``n_spans`` of all and ``n_added`` of those beside the base.

    A null or empty text has no span. Places are code points. Null ids and repeated rows are rows like others; an empty
    table gives an empty result.
    """
    spans = classify(candidates(docs, id_col, text_col), threshold)
    name = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct("kind", "start", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    line = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, item))), lambda x: x["s"]), ",")
    count = lambda k: F.sum(F.when(F.col("base") & (F.col("kind") == KINDS.index(k)), 1).otherwise(0))
    return spans.groupBy("__row").agg(
        F.max(id_col).alias(id_col), *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        line(F.col("base")).alias("base_spans"), line(F.col("found") & F.col("kind").isNotNull()).alias("spans"),
        F.count_if(F.col("found") & F.col("kind").isNotNull()).alias("n_spans"),
        F.count_if(F.col("found") & F.col("kind").isNotNull() & ~F.col("base")).alias("n_added")).drop("__row")
