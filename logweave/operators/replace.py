"""Replacement: everywhere, at one place, and queues of edits laid over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import Pattern, java_template


def replace_all(lines: DataFrame, pattern: Pattern, template: str, use_regex: bool = False, column: str = "raw") -> DataFrame:
    """``lines`` with every match in ``column`` replaced; group references count only in regular expressions."""
    if pattern.empty:
        return lines
    return lines.withColumn(column, F.regexp_replace(column, F.lit(pattern.regex), F.lit(java_template(template, use_regex))))


def splice(raw: Column, start: Column, length: Column, new: Column) -> Column:
    """``raw`` with ``length`` bytes from byte ``start`` (0-based) replaced by ``new``."""
    data = F.encode(raw, "UTF-8")
    head = F.substring(data, F.lit(1), start.cast("int"))
    tail = F.substring(data, (start + length + 1).cast("int"), F.lit(2**31 - 1))
    return F.make_valid_utf8(F.concat(head, F.encode(new, "UTF-8"), tail).cast("string"))


def replace_single(lines: DataFrame, source_id: object, offset: int, old_len: int | Column, new: str) -> DataFrame:
    """(source_id, line_number, line_len, raw) with one byte range of a source replaced; the range lies within a
    line, of whose columns its length may be made. Offsets of what follows change, so none are given."""
    inside = (F.col("source_id") == F.lit(source_id)) & (F.col("file_offset") <= offset) & (F.lit(offset) + F.lit(old_len) <= F.col("file_offset") + F.col("line_len"))
    new_raw = splice(F.col("raw"), F.lit(offset) - F.col("file_offset"), F.lit(old_len), F.lit(new))
    return _edited(lines, F.when(inside, new_raw).otherwise(F.col("raw")))


def _edited(lines: DataFrame, raw: Column) -> DataFrame:
    ends = [c for c in ("line_end",) if c in lines.columns]
    return lines.select("source_id", "line_number", F.octet_length(raw).alias("line_len"), raw.alias("raw"), *ends)


def apply_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(source_id, line_number, line_len, raw) with ``edits`` (source_id, line_number, offset, old_len, new_text) applied.

    Edits name offsets of the original source; those of a line are applied from the last to the first,
    so an edit that changes a length shifts none that is still to come.
    """
    entry = F.struct("offset", "old_len", "new_text")
    queued = edits.groupBy("source_id", "line_number").agg(F.sort_array(F.collect_list(entry), asc=False).alias("edits"))
    joined = lines.join(queued, ["source_id", "line_number"], "left")
    edited = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<offset:bigint,old_len:bigint,new_text:string>>")), F.col("raw"), lambda raw, e: splice(raw, e["offset"] - F.col("file_offset"), e["old_len"], e["new_text"]))
    return _edited(joined, edited)


def rewritten(lines: DataFrame) -> DataFrame:
    """(source_id, text): the texts that the lines of small sources make. What ended a line ends it again, where
    ``line_end`` tells; else a line feed does. Large sources are written by ``sources.bytelog`` instead."""
    end = F.col("line_end") if "line_end" in lines.columns else F.lit("\n")
    entry = F.struct("line_number", F.concat("raw", end).alias("whole"))
    return lines.groupBy("source_id").agg(F.sort_array(F.collect_list(entry)).alias("lines")).select("source_id", F.array_join("lines.whole", "").alias("text"))
