"""Search over lines: counts, positions, pages, occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import Pattern, match_count, match_spans, preview

PAGE = 1000
SPANS = "source_id, line_number, byte_offset, match_len, line_start, raw"


def matches(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """(source_id, line_number, byte_offset, match_len, line_start, raw) of every match in the lines.

    Offsets are bytes in the source. Anchors hold at line ends, and no match spans two lines. An empty
    query matches nothing.
    """
    if pattern.empty:
        return lines.limit(0).select("source_id", "line_number", F.col("file_offset").alias("byte_offset"), F.lit(0).alias("match_len"), F.col("file_offset").alias("line_start"), "raw")
    if pattern.may_be_empty:
        return _empty_matches(lines, pattern)
    hit = lines.where(F.col("raw").rlike(pattern.regex))  # most lines have no match and end here
    found = hit.select("source_id", "line_number", "file_offset", "raw", F.explode(match_spans(F.col("raw"), pattern)).alias("m"))
    return found.select("source_id", "line_number", (F.col("file_offset") + F.col("m.start")).alias("byte_offset"), F.col("m.len").alias("match_len"), F.col("file_offset").alias("line_start"), "raw")


def _empty_matches(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """Patterns that may match nothing: such matches are places, which splitting a text cannot tell."""
    import regex

    flags = regex.compile(pattern.regex.removeprefix("(?iu)"), regex.IGNORECASE if pattern.regex.startswith("(?iu)") else 0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            starts: list[int] = []
            sizes: list[int] = []
            offsets = batch.column(2).to_pylist()
            for i, raw in enumerate(batch.column(3).to_pylist()):
                for m in flags.finditer(raw):
                    rows.append(i)
                    starts.append(offsets[i] + len(raw[: m.start()].encode()))
                    sizes.append(len(m[0].encode()))
            take = pa.array(rows, pa.int64())
            own = [batch.column(k).take(take) for k in range(4)]
            yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), own[2], own[3]], names=SPANS.split(", "))

    kind = lines.schema["source_id"].dataType.simpleString()
    schema = f"source_id {kind}, line_number long, byte_offset long, match_len int, line_start long, raw string"
    return lines.select("source_id", "line_number", "file_offset", "raw").mapInArrow(find, schema)


def count_matches(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """(n_matches): the exact number of matches in all lines; partial sums meet in one row."""
    return lines.agg(F.coalesce(F.sum(match_count(F.col("raw"), pattern)), F.lit(0)).alias("n_matches"))


def count_by_source(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """(source_id, n_matches), sources without a match included."""
    return lines.groupBy("source_id").agg(F.sum(match_count(F.col("raw"), pattern)).alias("n_matches"))


def find_all(lines: DataFrame, pattern: Pattern, limit: int = PAGE) -> DataFrame:
    """The first ``limit`` matches in order of source and offset, exactly."""
    return matches(lines, pattern).orderBy("source_id", "byte_offset").limit(limit)


def find_first(lines: DataFrame, pattern: Pattern) -> DataFrame:
    return find_all(lines, pattern, 1)


def find_page(lines: DataFrame, pattern: Pattern, start: int, source_id: object, limit: int = PAGE) -> DataFrame:
    """A page of matches of one source, from byte ``start`` on: the next page starts after its last match."""
    found = matches(lines.where((F.col("source_id") == F.lit(source_id)) & (F.col("file_offset") + F.col("line_len") >= start)), pattern)
    return found.where(F.col("byte_offset") >= start).orderBy("byte_offset").limit(limit)


def neighbour(lines: DataFrame, pattern: Pattern, at: int, source_id: object, forward: bool = True) -> DataFrame:
    """The next (or previous) match of a source from byte ``at``, going round at the end."""
    found = matches(lines.where(F.col("source_id") == F.lit(source_id)), pattern)
    offset = F.col("byte_offset")
    beyond = (offset > at) if forward else (offset < at)
    return found.orderBy(beyond.desc(), offset.asc() if forward else offset.desc()).limit(1)


def _asked(lines: DataFrame, pattern: Pattern, asked: DataFrame) -> DataFrame:
    """The matches of each asked source, with the place ``origin`` asked from."""
    return matches(lines, pattern).join(asked.select("source_id", "origin").distinct(), "source_id")


def find_pages(lines: DataFrame, pattern: Pattern, asked: DataFrame, limit: int = PAGE) -> DataFrame:
    """A page of matches for each row of ``asked`` (source_id, origin), from byte ``origin`` on.

    Tasks cut to ``limit`` matches a place before they are dealt out by it.
    """
    order = Window.partitionBy("source_id", "origin").orderBy("byte_offset")
    found = _asked(lines, pattern, asked).where("byte_offset >= origin").withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= limit).drop("place")


def neighbours(lines: DataFrame, pattern: Pattern, asked: DataFrame, forward: bool = True) -> DataFrame:
    """The next (or previous) match for each row of ``asked`` (source_id, origin), going round at the end."""
    offset = F.col("byte_offset")
    beyond = (offset > F.col("origin")) if forward else (offset < F.col("origin"))
    nearest = F.struct((~beyond).alias("round"), (offset if forward else -offset).alias("offset"))
    found = _asked(lines, pattern, asked)
    own = F.struct(*[c for c in found.columns if c not in ("source_id", "origin")])
    return found.groupBy("source_id", "origin").agg(F.min_by(own, nearest).alias("m")).select("source_id", "origin", "m.*")


def with_preview(found: DataFrame) -> DataFrame:
    """Result rows for display: line, offset in hexadecimal and preview."""
    return found.select("source_id", "line_number", "byte_offset", F.lower(F.hex("byte_offset")).alias("hex_offset"), preview(F.col("raw"), F.col("byte_offset") - F.col("line_start")).alias("preview"))


def highlights(found: DataFrame, lines: DataFrame, top: int, rows: int) -> DataFrame:
    """(source_id, line_number, start, end): matches inside the lines on view, relative to their line."""
    seen = lines.where(F.col("line_number").between(top, top + rows - 1)).select("source_id", "line_number", F.col("file_offset").alias("begin"))
    own = found.select("source_id", "line_number", "byte_offset", "match_len").join(seen, ["source_id", "line_number"])
    start = F.col("byte_offset") - F.col("begin")
    return own.select("source_id", "line_number", start.alias("start"), (start + F.col("match_len")).alias("end"))
