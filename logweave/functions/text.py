"""Expressions on text: patterns, match offsets in bytes, previews."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A compiled search: ``regex`` is what Spark's regular expressions take."""

    query: str
    regex: str
    may_be_empty: bool

    @property
    def empty(self) -> bool:
        return not self.query


def compile_pattern(query: str, use_regex: bool = False, case_sensitive: bool = False, whole_word: bool = False) -> Pattern:
    """A literal is quoted; without ``case_sensitive`` letters fold as Unicode has it."""
    body = query if use_regex else r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    if whole_word:
        body = rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"
    regex = body if case_sensitive else f"(?iu){body}"
    try:
        empty = use_regex and re.compile(query).search("") is not None
    except re.error:
        empty = use_regex  # the dialects differ: take the path that is right for either
    return Pattern(query, regex, empty)


def check_pattern(spark: SparkSession, pattern: Pattern) -> None:
    """Raise for a pattern that Spark cannot compile, before any row is read."""
    spark.range(1).select(F.regexp_count(F.lit(""), F.lit(pattern.regex))).collect()


def _sums_before(steps: pd.Series) -> pd.Series:
    sizes = steps.map(len).to_numpy()
    flat = np.concatenate([np.empty(0, np.int64), *steps])
    ends = np.concatenate([[0], np.cumsum(flat)])
    first = np.cumsum(sizes) - sizes
    before = ends[:-1] - np.repeat(ends[first], sizes)
    return pd.Series(np.split(before, first[1:]) if len(sizes) else [])


def sums_before(steps: Column) -> Column:
    """For each number of an array the sum of those before it.

    Spark's own functions on arrays copy the array for each element that they add; this takes linear time
    also in texts of a million lines. Only numbers cross to Python.
    """
    return F.pandas_udf(_sums_before, "array<bigint>")(F.transform(steps, lambda x: x.cast("long")))


def match_spans(text: Column, pattern: Pattern) -> Column:
    """Array of (start, len) in bytes of all matches that are not empty, left to right.

    The pieces between the matches and the matches alternate, so running sums of their byte lengths
    give exact offsets also in text of several bytes a character.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0)), F.octet_length)
    gaps = F.transform(F.slice(F.split(text, pattern.regex, -1), 1, F.size(found)), F.octet_length)
    steps = F.zip_with(gaps, found, lambda gap, size: gap + size)
    before = F.zip_with(sums_before(steps), gaps, lambda at, gap: at + gap)
    return F.arrays_zip(before.alias("start"), found.alias("len"))


def match_count(text: Column, pattern: Pattern) -> Column:
    return F.regexp_count(text, F.lit(pattern.regex)).cast("long")


def preview(raw: Column, start: Column, before: int = 32, after: int = 128) -> Column:
    """The text around a match: bytes before and after it, within its line, white space collapsed."""
    begin = F.greatest(start - before, F.lit(0))
    data = F.encode(raw, "UTF-8")
    cut = F.substring(data, (begin + 1).cast("int"), (start - begin + after).cast("int"))
    return F.trim(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), r"[\t ]+", " "))


def word_at(text: Column, position: int) -> Column:
    """The word of letters, digits and underscores that covers the 0-based character ``position``."""
    head = F.regexp_extract(F.substring(text, 1, position), r"([A-Za-z0-9_]*)\z", 1)
    tail = F.regexp_extract(F.substring(text, position + 1, 2**31 - 1 - position), r"\A([A-Za-z0-9_]*)", 1)
    return F.concat(head, tail)


def java_template(template: str, use_regex: bool = True) -> str:
    """A replacement template in the form that Spark takes.

    ``$1``, ``${1}`` and ``${name}`` refer to groups and ``$$`` is a dollar sign; ``$1a`` is the group named
    ``1a``, which no pattern has, so it stands for nothing. A template of a literal search is plain text.
    """
    if not use_regex:
        return template.replace("\\", "\\\\").replace("$", "\\$")

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        if name is None:
            return m[0].replace("\\", "\\\\").replace("$", r"\$")
        if name.isdigit():
            return f"${name}"
        return f"${{{name}}}" if not name[0].isdigit() else ""

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$|\\|[^$\\]+", one, template)
