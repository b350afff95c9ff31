"""A question about a trace, from a line and the name of a location to hit rows, summary and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators import dataflow, hits, trace


@dataclass
class Answer:
    """``hits`` for a table, ``summary`` (one row), ``boundary`` (loc) and ``mismatches`` (idx, addr, expected, actual)."""

    hits: DataFrame
    summary: DataFrame
    boundary: DataFrame
    mismatches: DataFrame

    def report(self) -> DataFrame:
        return hits.report(self.hits, self.summary, self.boundary, self.mismatches)


def run(
    lines: DataFrame, source_id: object, source: str, mode: str, checkpoint: Callable[[DataFrame], DataFrame],
    line_number: int | None = None, offset: int | None = None, skip_start: bool = False,
    max_idle: int = 50_000, max_depth: int | None = None, window_bytes: int | None = 200_000_000,
) -> Answer:
    """Follow ``source`` (a register, or ``mem:0x<hex>``) from the instruction at a line or a byte offset, or the
    next one after it, ``forward`` or ``backward``.

    Only lines that can matter are parsed: forward those up to the end of the window, backward those up to the
    memory lines of the start. A name that is no location and a start without an instruction are refused.
    """
    if mode not in ("forward", "backward") or (line_number is None) == (offset is None):
        raise ValueError("the mode is forward or backward, and the start a line or an offset")
    loc = hits.parse_source(source)
    own = lines.where(F.col("source_id") == F.lit(source_id))
    order, begin = ("line_number", line_number) if offset is None else ("file_offset", offset)
    text = own.where(F.col(order) >= begin)
    first = trace.heads(text).agg(F.min_by(F.struct("line_number", "file_offset"), "line_number").alias("at")).first().at
    if first is None:
        raise ValueError("no instruction at or after the start")
    if mode == "backward":
        after = own.where(F.col("line_number") > first.line_number)
        until = trace.heads(after).agg(F.min("line_number")).first()[0]
        own = trace.within_limits(own, max_line=None if until is None else until - 1)
    insns = checkpoint(dataflow.with_rules(trace.parse_trace(own)))
    start = insns.where(F.col("line_number") == first.line_number).select("idx")
    asked = start.select(F.lit(1).cast("long").alias("query_id"), F.lit(source_id).alias("source_id"), F.lit(loc).alias("loc"), F.col("idx").alias("start_idx"), F.lit(skip_start).alias("skip_start"))
    if mode == "forward":
        found = checkpoint(dataflow.forward(insns, asked.drop("skip_start"), max_idle, window_bytes))
        rows = found.where("kind = 'hit'").select("source_id", "idx", "locs")
        reason = found.where("kind = 'stop'").select(F.col("locs")[0].alias("stop_reason"))
        boundary = insns.limit(0).select(F.lit("").alias("loc"))
        wrong = found.where("kind = 'mismatch'").select("idx", "addr", "expected", "actual")
    else:
        trail, left = dataflow.backward(insns, asked, checkpoint, max_depth)
        trail = checkpoint(trail)
        rows, boundary = trail.select("source_id", "idx", "locs"), checkpoint(left.select("loc"))
        cut = F.count_if("truncated") if max_depth is not None else F.count("*") * 0
        reason = trail.agg(cut.alias("cut")).select(F.when(F.col("cut") > 0, "DepthLimitReached").otherwise("EndOfTrace").alias("stop_reason"))
        wrong = insns.limit(0).select("idx", F.lit("").alias("addr"), F.lit(0).cast("long").alias("expected"), F.lit(0).cast("long").alias("actual"))
    shown = checkpoint(hits.hit_rows(rows, insns))
    count = shown.agg(F.count("*").alias("n_hits"))
    summary = reason.join(count).select(
        F.lit(mode).alias("mode"), F.lit(source).alias("source"), F.lit(first.line_number).alias("start_line"), F.lit(first.file_offset).alias("start_offset"),
        "stop_reason", hits.stop_label(F.col("stop_reason")).alias("stop_text"), "n_hits",
    )
    return Answer(shown, summary, boundary, wrong)
