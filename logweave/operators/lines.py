"""The line table of texts and files, and lookups between lines and byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import sums_before

LINES = ("source_id", "line_number", "file_offset", "line_len", "raw")


def lines_of_texts(texts: DataFrame, id_col: str, text_col: str, line_ends: bool = False, empty_line: bool = False) -> DataFrame:
    """(source_id, line_number, file_offset, line_len, raw) of every line of every text.

    A text is one row, so its lines come from that row alone and nothing is shuffled. ``file_offset`` is
    in bytes, ``line_len`` without the line end; a text that ends in a line end has no further line. With
    ``line_ends`` a column ``line_end`` has what ends each line, so that the text can be put together again.
    An empty text has no line, with ``empty_line`` one that is empty.
    """
    cut = F.split(text_col, "\n", -1)
    sizes = F.transform(cut, lambda line: F.octet_length(line) + 1)
    own = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("source_id"), cut.alias("cut"), sums_before(sizes).alias("starts"))
    out = own.select("source_id", F.size("cut").alias("n"), F.posexplode(F.arrays_zip("cut", "starts")).alias("at", "line"))
    last = F.col("at") + 1 == F.col("n")
    out = out.where(_is_line(F.col("line.cut"), empty_line))
    raw = F.regexp_replace("line.cut", r"\r\z", "")
    columns = [(F.col("at") + 1).cast("long").alias("line_number"), F.col("line.starts").alias("file_offset"), F.octet_length(raw).alias("line_len"), raw.alias("raw")]
    end = F.concat(F.when(F.col("line.cut").endswith("\r"), "\r").otherwise(""), F.when(last, "").otherwise("\n"))
    return out.select("source_id", *columns, *[end.alias("line_end")] * line_ends)


def _is_line(cut: Column, empty_line: bool) -> Column:
    """Whether piece ``at`` of ``n`` is a line: what is behind the last line end is none if it is empty."""
    found = (F.col("at") + 1 < F.col("n")) | (cut != "")
    return found | (F.col("n") == 1) if empty_line else found


def rows_of_texts(texts: DataFrame, id_col: str, text_col: str, empty_line: bool = False) -> DataFrame:
    """(source_id, raw) of every line of every text, for what needs no places: all of it inside the JVM."""
    cut = F.split(text_col, "\n", -1)
    own = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("source_id"), F.size(cut).alias("n"), F.posexplode(cut).alias("at", "raw"))
    return own.where(_is_line(F.col("raw"), empty_line)).select("source_id", F.regexp_replace("raw", r"\r\z", "").alias("raw"))


def checkpoints(lines: DataFrame, interval: int = 10_000_000) -> DataFrame:
    """(source_id, byte_pos, line_index): the first line start in each ``interval`` of bytes; sparse index."""
    step = F.floor(F.col("file_offset") / interval)
    first = lines.groupBy("source_id", step.alias("step")).agg(F.min("file_offset").alias("byte_pos"), F.min("line_number").alias("line_number"))
    return first.select("source_id", "byte_pos", (F.col("line_number") - 1).alias("line_index"))


def line_summary(lines: DataFrame) -> DataFrame:
    """(source_id, total_lines, total_bytes, average) of each source; bytes as read, with line ends."""
    width = F.col("line_len") + 1
    found = lines.groupBy("source_id").agg(F.count("*").alias("total_lines"), F.max(F.col("file_offset") + width).alias("total_bytes"))
    return found.withColumn("average", F.col("total_bytes") / F.col("total_lines"))


def estimated_lines(file_size: Column, average: Column | None = None) -> Column:
    """A guess at the number of lines, before any count: by an average line, or 80 bytes."""
    return F.floor(file_size / (F.lit(80) if average is None else average)).cast("long")


def line_range(lines: DataFrame, line_number: int, source_id: object = None) -> DataFrame:
    """(source_id, start, end) in bytes of a 1-based line; no row if there is none."""
    found = lines.where(F.col("line_number") == line_number)
    if source_id is not None:
        found = found.where(F.col("source_id") == F.lit(source_id))
    return found.select("source_id", F.col("file_offset").alias("start"), (F.col("file_offset") + F.col("line_len")).alias("end"))


def go_to_line(lines: DataFrame, line_number: int, source_id: object = None) -> DataFrame:
    """The line itself; a number below 1 is refused."""
    if line_number < 1:
        raise ValueError("line numbers begin at 1")
    found = lines.where(F.col("line_number") == line_number)
    return found if source_id is None else found.where(F.col("source_id") == F.lit(source_id))


def viewport(lines: DataFrame, top: int, rows: int) -> DataFrame:
    """``rows`` lines of each source from line ``top`` on, in order."""
    return lines.where(F.col("line_number").between(top, top + rows - 1)).orderBy("source_id", "line_number")


def centred(lines: DataFrame, line_number: int, rows: int) -> DataFrame:
    """The viewport that has ``line_number`` in its middle."""
    return viewport(lines, max(1, line_number - rows // 2), rows)


def offsets_to_lines(offsets: DataFrame, lines: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(source_id, offset, line_number) for every row (source_id, offset): an as-of join on line starts.

    Both sides are cut into ranges of ``width`` bytes, so a large source is many groups. The last line
    that starts before a range is carried into it from a table with a row for each range.
    """
    both = lines.select("source_id", F.col("file_offset").alias("at"), "line_number", F.lit(None).cast("long").alias("offset"))
    both = both.union(offsets.select("source_id", F.col("offset").alias("at"), F.lit(None).cast("long"), "offset"))
    from logweave.operators.ordered import last_before

    found = last_before(both, ["source_id"], "at", "line_number", "found", width, strict=False)
    return found.where("offset IS NOT NULL").select("source_id", "offset", F.col("found").alias("line_number"))


def byte_range(lines: DataFrame, start: int, end: int) -> DataFrame:
    """The lines that touch bytes [start, end)."""
    if start >= end:
        return lines.limit(0)
    return lines.where((F.col("file_offset") < end) & (F.col("file_offset") + F.col("line_len") >= start))


def nearest_line(rows: DataFrame, column: str, value: int) -> DataFrame:
    """Of each source the row whose ``column`` is ``value`` or else the next higher one."""
    return rows.where(F.col(column) >= value).groupBy("source_id").agg(F.min_by(F.struct(*rows.columns), column).alias("row")).select("row.*")
