"""License scans by diagonal voting.

Every k-gram of words of every text is hashed and joined with the k-grams of the templates. A
hit at word ``pos`` of a text and word ``at`` of a template votes for the diagonal ``pos - at``,
the place where the template would begin. Votes are counted per diagonal, neighbouring diagonals
of a long template are merged (a word more or less moves the rest of a passage to the next one), and
a span counts if the words of the template that its votes cover, compared as words, are enough.

A text is read once: one more row per text goes through the same join, so that texts without hits
come out with the others and nothing has to be joined back.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, split_words, text_of

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GRAM = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    share: float = 1.0   # of the template's words that a span has to cover
    slack: int = 0       # diagonals further apart than this are different spans

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(GAP, self.text.lower()) if w]


def _passage(label: str, text: str) -> Template:
    return Template(label, text, share=0.75, slack=4)


# Phrases and labels that are always looked for.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
# Opening passages and short names of public licenses.
MORE = (
    Template("apache", "apache license"),
    Template("mit", "mit license"),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("cc", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("public-domain", "dedicated to the public domain"),
    _passage("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
                    " and associated documentation files"),
    _passage("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in"
                       " compliance with the License"),
    _passage("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"
                    " provided that the following conditions are met"),
    _passage("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
                    " without fee is hereby granted"),
    _passage("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the"
                    " GNU General Public License as published by the Free Software Foundation"),
    _passage("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    _passage("public-domain", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES = BASE + MORE


def template_grams(spark: SparkSession, templates: tuple[Template, ...], gram: int = GRAM) -> DataFrame:
    """One row per k-gram of a template; its size is that of the templates, whatever the corpus.

    A template shorter than ``gram`` words is one gram by itself. The row of template -1 meets every text.
    """
    rows = [(0, [], -1, 0)]
    for t, template in enumerate(templates):
        words = template.words
        k = min(gram, len(words))
        rows += [(k, words[at:at + k], t, at) for at in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "t_k int, t_words array<string>, t int, t_at int")
    keys = [F.xxhash64(F.lit(k), *[F.col("t_words")[i] for i in range(k)]) for k in range(1, gram + 1)]
    key = F.lit(0).cast("long")
    for k in range(1, gram + 1):
        key = F.when(F.col("t_k") == k, keys[k - 1]).otherwise(key)
    return grams.withColumn("t_key", key)


def votes(docs: DataFrame, templates: tuple[Template, ...], gram: int = GRAM, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``__row``, id, ``n_words``, ``t``, ``diagonal``, ``t_at``, ``t_k``: one row per verified hit of a gram."""
    sizes = sorted({min(gram, len(t.words)) for t in templates})
    rows = numbered(docs, __id=id_col, __text=text_col)
    rows = rows.select("__row", "__id", split_words(ascii_lower(text_of("__text")), GAP).alias("__words"))
    rows = rows.withColumn("__pos", F.explode(F.sequence(F.lit(-1), F.size("__words") - 1)))
    pos, words = F.col("__pos"), F.col("__words")
    keys = [F.struct(F.lit(0).alias("k"), F.when(pos < 0, F.lit(0).cast("long")).alias("key"))]
    keys += [F.struct(F.lit(k).alias("k"), F.when(
        pos >= 0, F.xxhash64(F.lit(k), *[F.get(words, pos + i) for i in range(k)])).alias("key")) for k in sizes]
    # the first gram size shares its struct with the row of the text itself
    first = F.struct(F.when(pos < 0, F.lit(0)).otherwise(keys[1]["k"]).alias("k"),
                     F.when(pos < 0, F.lit(0).cast("long")).otherwise(keys[1]["key"]).alias("key"))
    grams = rows.select("__row", "__id", "__words", "__pos", F.inline(F.array(first, *keys[2:])))
    table = template_grams(docs.sparkSession, templates, gram)
    hit = (F.col("key") == F.col("t_key")) & (F.col("k") == F.col("t_k")) & (
        (F.col("k") == 0) | (F.slice("__words", F.greatest(F.col("__pos"), F.lit(0)) + 1, F.col("t_k"))
                             == F.col("t_words")))
    return grams.join(F.broadcast(table), hit).select(
        "__row", "__id", F.size("__words").cast("long").alias("n_words"), "t",
        (F.col("__pos") - F.col("t_at")).alias("diagonal"), "t_at", "t_k")


def _choice(values: list, name: str = "t"):
    """The value of template ``t`` from a list."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(name))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, gram: int = GRAM, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Verified spans, and one row with ``t`` = -1 per text.

    Columns: ``__row``, id, ``n_words``, ``t`` (place in ``templates``), ``label``, ``base``,
    ``first_word``, ``votes``, ``covered`` (words of the template) and ``share`` of the template.
    """
    lengths = [len(t.words) for t in templates]
    line = votes(docs, templates, gram, id_col, text_col).groupBy("__row", "t", "diagonal").agg(
        F.max("__id").alias("__id"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("__votes"),
        F.collect_set(F.struct("t_at", "t_k")).alias("__at"))
    order = Window.partitionBy("__row", "t").orderBy("diagonal")
    fresh = F.col("diagonal") - F.lag("diagonal").over(order) > _choice([t.slack for t in templates])
    line = line.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("int"))
    line = line.withColumn("__span", F.sum("__new").over(order))
    found = line.groupBy("__row", "t", "__span").agg(
        F.max("__id").alias(id_col), F.max("n_words").alias("n_words"), F.min("diagonal").alias("first_word"),
        F.sum("__votes").alias("votes"), F.flatten(F.collect_list("__at")).alias("__at"))
    places = F.flatten(F.transform("__at", lambda x: F.sequence(x["t_at"], x["t_at"] + F.greatest(x["t_k"], F.lit(1)) - 1)))
    found = found.withColumn("covered", F.size(F.array_distinct(places)))
    need = [math.ceil(t.share * n) for t, n in zip(templates, lengths)]
    return found.filter((F.col("t") < 0) | (F.col("covered") >= _choice(need))).select(
        "__row", id_col, "n_words", "t", _choice([t.label for t in templates]).alias("label"),
        _choice([t.base for t in templates]).alias("base"), F.greatest("first_word", F.lit(0)).alias("first_word"),
        "votes", "covered", (F.col("covered") / _choice(lengths)).alias("share"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, gram: int = GRAM,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` and ``n_spans``.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; a null or empty text has
    none. ``n_base`` counts all places of base phrases, overlapping ones too; ``first_word`` and
    ``last_word`` are the smallest and largest word where one starts, null if there is none. ``score``
    is the largest share of a template that a span covers, 0 without spans. Null ids and repeated rows are rows
    like others; an empty table gives an empty result.
    """
    real, base = F.col("t") >= 0, F.col("base")
    joined = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return spans(docs, templates, gram, id_col, text_col).groupBy("__row").agg(
        F.max(id_col).alias(id_col), F.max("n_words").alias("n_words"),
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(real).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sum(F.when(real, 1).otherwise(0)).alias("n_spans")).drop("__row")
