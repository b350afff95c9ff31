"""Results for people: hit rows, filters, labels and the text report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.dims import register_name
from logweave.operators.trace import call_display
from logweave.sources.bytelog import register

#: Labels of a report: fixed values.
STOP_LABELS = {"AllTaintCleared": "all taint cleared", "ScanLimitReached": "scan limit reached", "EndOfTrace": "end of trace", "WindowEnd": "end of the window", "DepthLimitReached": "depth limit reached", "Cancelled": "cancelled"}
FILTERED = ("raw_line", "module_offset", "addr", "asm", "tainted_text")


def location_text(loc: Column) -> Column:
    """``x0`` or ``mem:0x10`` for a location."""
    memory = F.concat(F.lit("mem:0x"), F.substring(loc, 2, 64))
    return F.when(loc.startswith("m"), memory).otherwise(register_name(F.substring(loc, 2, 3).cast("int")))


def in_order(locs: Column) -> Column:
    """Locations in order: registers by number, then addresses as unsigned numbers."""
    keyed = F.transform(locs, lambda x: F.struct(x.startswith("m").alias("memory"), F.length(x).alias("digits"), x.alias("loc")))
    return F.transform(F.sort_array(keyed), lambda x: x["loc"])


def parse_source(text: str) -> str:
    """The location that a user names: a register, or ``mem:0x<hex>``."""
    text = text.strip().lower()
    if m := re.fullmatch(r"mem:(?:0x)?([0-9a-f]{1,16})", text):
        return f"m{int(m[1], 16):x}"
    names = {"sp": 31, "wsp": 31, "xzr": 32, "wzr": 32, "fp": 29, "lr": 30, "nzcv": 33}
    if text in names:
        return f"r{names[text]}"
    if m := re.fullmatch(r"([xw])(\d|[12]\d|30)", text):
        return f"r{int(m[2])}"
    if m := re.fullmatch(r"([qdshbv])(\d|[12]\d|3[01])", text):
        return f"r{34 + int(m[2])}"
    raise ValueError(f"no register or address: {text!r}")


def targets(ruled: DataFrame) -> DataFrame:
    """(source_id, idx, position, loc, label): what can be asked about at each instruction, in order."""
    own = F.array_distinct(F.concat(F.transform(F.concat("dst", "src"), lambda r: F.concat(F.lit("r"), r.cast("string"))), F.transform(F.concat("reads", "writes"), lambda a: F.concat(F.lit("m"), F.lower(F.hex(a["addr"]))))))
    out = ruled.select("source_id", "idx", F.posexplode(own).alias("position", "loc"))
    return out.withColumn("label", location_text(F.col("loc")))


def address_targets(ruled: DataFrame) -> DataFrame:
    """The registers that make the address of a load or store."""
    own = F.array_distinct(F.transform("src", lambda r: F.concat(F.lit("r"), r.cast("string"))))
    return ruled.where(F.col("category").isin("Load", "Store")).select("source_id", "idx", F.posexplode(own).alias("position", "loc")).withColumn("label", location_text(F.col("loc")))


def hit_rows(found: DataFrame, insns: DataFrame) -> DataFrame:
    """Hits (source_id, idx, locs) as rows for a table; calls are shown where they were made."""
    shown = call_display(insns).select("source_id", "idx", F.col("shown_offset").alias("file_offset"), F.col("shown_line").alias("line_number"), F.col("raw").alias("raw_line"), "module_offset", F.col("abs_addr").alias("addr"), "asm")
    text = F.concat(F.lit("{"), F.array_join(F.transform(in_order(F.col("locs")), location_text), ", "), F.lit("}"))
    return found.join(shown, ["source_id", "idx"]).withColumn("tainted_text", text)


def filter_hits(hits: DataFrame, query: str) -> DataFrame:
    """Hits that hold ``query`` in one of their texts, in either case, or in their line number; blank keeps all."""
    query = query.strip()
    if not query:
        return hits
    found = F.col("line_number").cast("string").contains(query)
    for column in FILTERED:
        if column in hits.columns:
            found |= F.coalesce(F.lower(column).contains(query.lower()), F.lit(False))
    return hits.where(found)


def lines_with_hits(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """The lines that hold a hit: a semi-join on the byte offset."""
    return lines.join(hits.select("source_id", "file_offset").distinct(), ["source_id", "file_offset"], "left_semi")


def stop_label(reason: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, label in STOP_LABELS.items():
        found = F.when(reason == name, label).otherwise(found)
    return found


def report(hits: DataFrame, summary: DataFrame, boundary: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(line): a text report of hit rows. ``summary`` is one row (mode, source, start_line, start_offset,
    stop_reason, n_hits); ``boundary`` has (loc), ``mismatches`` (idx, addr, expected, actual)."""
    hex_ = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    at = F.concat(F.lit("Started from: line "), F.col("start_line").cast("string"), F.lit(" (file offset "), hex_("start_offset"), F.lit(")"))
    count = F.concat(F.lit("Total matched: "), F.col("n_hits").cast("string"), F.lit(" instructions"))
    head = F.array(F.concat(F.lit("=== Taint "), F.initcap("mode"), F.lit(" Tracking ===")), F.concat(F.lit("Source: "), F.col("source")), at, count, F.concat(F.lit("Stop reason: "), stop_label(F.col("stop_reason"))))
    zero = F.lit(0).cast("long")
    rows = summary.select(F.lit(1).alias("part"), zero.alias("idx"), F.posexplode(head).alias("row", "line"))
    order = F.struct(F.col("loc").startswith("m"), F.length("loc"), F.col("loc"))
    place = (F.row_number().over(Window.orderBy(order)) - 1).cast("int")
    rows = rows.union(boundary.select(F.lit(2), zero, place, F.concat(F.lit("Unresolved at trace start: "), location_text(F.col("loc")))))
    wrong = F.concat(F.lit("Value mismatch: "), location_text(F.col("addr")), F.lit(" was "), hex_("expected"), F.lit(", read as "), hex_("actual"))
    rows = rows.union(mismatches.select(F.lit(3), "idx", F.lit(0), wrong))
    rows = rows.union(summary.select(F.lit(4), zero, F.posexplode(F.array(F.lit("=" * 60), F.lit("")))))
    body = F.array(F.concat(F.lit("["), F.col("line_number").cast("string"), F.lit("] "), F.col("raw_line")), F.concat(F.lit("      tainted: "), F.col("tainted_text")), F.lit(""))
    rows = rows.union(hits.select(F.lit(5), "idx", F.posexplode(body)))
    return rows.orderBy("part", "idx", "row").select("line")


def write_report(lines: DataFrame, path: str) -> None:
    """Write the ``lines`` of a report, in their order, as one source in place of what is at ``path``."""
    register(lines.sparkSession)
    data = F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("data")
    lines.select(F.spark_partition_id().cast("long").alias("block"), data).write.format("bytelog").mode("overwrite").save(path)
