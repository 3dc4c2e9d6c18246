"""Scalar text expressions. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of word characters or a run of other
# non-space characters. The classes are spelled out because Java's Unicode \w
# also takes combining marks, which the tokenizer to match does not, and its \s
# leaves out spaces beyond ASCII.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
DIGIT_CLASS = r"\p{Nd}"
WORDPUNCT = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}]+"
_CLASSES = {"w": WORD_CLASS, "s": SPACE_CLASS, "d": DIGIT_CLASS}


def wordpunct_tokens(text: Column) -> Column:
    """Array of word and punctuation tokens."""
    return F.regexp_extract_all(text, F.lit(WORDPUNCT), F.lit(0))


def wordpunct(text: Column) -> Column:
    """The tokens of ``text`` joined by single spaces."""
    return F.array_join(wordpunct_tokens(text), " ")


def python_regex(pattern: str) -> str:
    """A regex as Python reads it, in the terms of the JVM.

    Word, digit and space classes and word borders are those of Unicode, also inside brackets, where
    ``[`` and ``&&`` stand for themselves. Named groups and conditions are refused.
    """
    if "(?P" in pattern or "(?(" in pattern:
        raise ValueError(f"named groups and conditions are not supported in patterns: {pattern}")
    word = f"[{WORD_CLASS}]"
    borders = {
        "b": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
        "B": f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))",
        "Z": r"\z",
    }
    out, i, inside = [], 0, -1  # inside: where the bracket's first member stands, or -1
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e.lower() in _CLASSES:
                plain = _CLASSES[e.lower()]
                out.append(f"[^{plain}]" if e.isupper() else plain if inside >= 0 else f"[{plain}]")
            elif inside >= 0 and e == "b":
                out.append(r"\x08")
            elif inside < 0 and e in borders:
                out.append(borders[e])
            else:
                out.append(c + e)
            i += 2
            continue
        if inside < 0 and c == "[":
            out.append(c)
            i += 1
            if pattern[i:i + 1] == "^":
                out.append("^")
                i += 1
            inside = i
            continue
        if inside >= 0 and c == "]":
            out.append("]" if i > inside else r"\]")
            inside = -1 if i > inside else inside
        elif inside >= 0 and c in "[&":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def full_match(value: Column, pattern: str) -> Column:
    """True where the whole value matches the regex as Python reads it, ignoring case; NULL does not match."""
    return F.coalesce(value.rlike(rf"(?iud)\A(?:{python_regex(pattern)})\z"), F.lit(False))


def deprel_base(deprel: Column) -> Column:
    """The relation without its subtype: ``nsubj:pass`` becomes ``nsubj``."""
    return F.split_part(deprel, F.lit(":"), F.lit(1))


def composite_key(*parts: Column) -> Column:
    """Subcategory name such as ``NOUN_nsubj``."""
    return F.concat_ws("_", *parts)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def corpus_language(path: Column, language: str | None = None) -> Column:
    """The given language, else the file stem before the first ``-``."""
    if language:
        return F.lit(language)
    return F.split_part(file_stem(path), F.lit("-"), F.lit(1))


def _path_value(path: Column, key: str) -> Column:
    """``value`` of a folder ``key=value`` in the path, else NULL."""
    found = F.regexp_extract(path, rf"(?:^|/){key}=([^/]+)", 1)
    return F.when(found != "", found)


def task_language(path: Column) -> Column:
    """The folder ``lang=...`` of a written task, else the first ``_`` piece of the stem; NULL without ``_``."""
    pieces = F.split(file_stem(path), "_")
    return F.coalesce(_path_value(path, "lang"), F.when(path.contains("_"), F.element_at(pieces, 1)))


def task_category(path: Column) -> Column:
    """Last ``_`` piece of the folder ``task=...`` of a written task, else of the stem; NULL without ``_``."""
    pieces = F.split(file_stem(path), "_")
    written = F.element_at(F.split(_path_value(path, "task"), "_"), -1)
    return F.coalesce(written, F.when(path.contains("_"), F.element_at(pieces, -1)))


def shuffle_key(seed: int | str, key: Column) -> Column:
    """Repeatable pseudo-random order: md5 of ``seed:key``, as 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
