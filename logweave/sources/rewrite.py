"""Replacement and edits in whole files, byte for byte: ranges are read, rewritten and written side by side.

The outcome is a folder of parts in order, which takes the place of what was at its path only when it is whole;
input and output may be the same path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.text import Pattern, java_template
from logweave.sources.bytelog import CHUNK, RANGE, Source, file_ranges, register, scan, sources_at
from logweave.storage import checkpoint


def _write(rows: DataFrame, data: Column, out: str) -> None:
    register(rows.sparkSession)
    rows.select("block", data.alias("data")).write.format("bytelog").mode("overwrite").save(out)


def replace_all(spark: SparkSession, path: str, out: str, pattern: Pattern, template: str, use_regex: bool = False, range_bytes: int = RANGE) -> None:
    """Replace every match in a file; no range waits for another and nothing is shuffled.

    Lines that are no valid UTF-8 are searched byte by byte, as ISO-8859-1, so their other bytes stay too.
    """
    rows = scan(spark, path, range_bytes, with_data=True)
    body = F.regexp_replace("raw", F.lit(pattern.regex), F.lit(java_template(template, use_regex)))
    start = F.when(F.col("file_offset") == 0, F.when(F.hex(F.substring("data", 1, 3)) == "EFBBBF", 3).otherwise(0)).otherwise(0)
    tail = F.substring(F.col("data"), (F.octet_length("raw") + start + 1).cast("int"), F.lit(2**31 - 1))
    whole = F.concat(F.substring(F.col("data"), F.lit(1), start), F.encode(body, "UTF-8"), tail)
    odd = F.regexp_replace(F.decode("data", "ISO-8859-1"), F.lit(pattern.regex), F.lit(java_template(template, use_regex)))
    data = F.when(F.is_valid_utf8(F.col("data").cast("string")), whole).otherwise(F.encode(odd, "ISO-8859-1"))
    _write(rows, F.col("data") if pattern.empty else data, out)


PIECES = "block long, at long, place long, drop long, new_bytes binary, start long, end long, file string"


def _pieces(edits: DataFrame, ranges: DataFrame, size: int, range_bytes: int) -> DataFrame:
    """The edits, cut at the borders of ranges: what each range leaves out and puts in. An edit puts its bytes in where it
    begins; one at the very end of the file belongs to the last range."""
    last = max(0, -(-size // range_bytes) - 1)
    begin = F.least(F.floor(F.col("offset") / range_bytes), F.lit(last))
    end = F.greatest(begin, F.floor((F.col("offset") + F.col("old_len") - 1) / range_bytes))
    cut = edits.select("*", F.explode(F.sequence(begin, end)).alias("block"))
    low, high = F.greatest("offset", F.col("block") * range_bytes), F.least(F.col("offset") + F.col("old_len"), (F.col("block") + 1) * range_bytes)
    own = cut.select("block", low.alias("at"), "place", F.greatest(high - low, F.lit(0)).alias("drop"), F.when(F.col("block") == begin, F.col("new_bytes")).alias("new_bytes"), F.col("old_len").alias("whole"))
    return own


def _check(edits: DataFrame, pieces: DataFrame, size: int) -> None:
    """Raise for edits outside the file and for those that overlap, which cannot both hold."""
    wrong = edits.where((F.col("offset") < 0) | (F.col("old_len") < 0) | (F.col("offset") + F.col("old_len") > size) | F.col("offset").isNull() | F.col("old_len").isNull())
    if not wrong.isEmpty():
        raise ValueError(f"edits outside the file of {size} bytes: {[tuple(r) for r in wrong.select('offset', 'old_len').limit(3).collect()]}")
    order = Window.partitionBy("block").orderBy("at", "whole", "place").rowsBetween(Window.unboundedPreceding, -1)
    clash = pieces.withColumn("covered", F.max(F.col("at") + F.col("drop")).over(order)).where(F.col("covered") > F.col("at"))
    if not clash.isEmpty():
        raise ValueError(f"edits overlap at {[r.at for r in clash.select('at').limit(3).collect()]}")


def apply_edits(spark: SparkSession, path: str, out: str, edits: DataFrame, range_bytes: int = RANGE) -> None:
    """Apply ``edits`` (offset, old_len, new_bytes) to a file, wherever they are: inside a line, over several lines, at
    the end of the file (an append), side by side.

    Offsets are those of the file as it is. Edits are dealt to ranges of bytes and sorted there; a task copies its range
    and puts them in as it goes along. Of several that insert at one place the order is that of a column ``seq``, if
    there is one, else that of their bytes. Edits that overlap and those outside the file are refused, before anything is written.
    """
    ((_, parts),) = sources_at(path)
    size = sum(part.size for part in parts)
    order = [F.col("seq")] if "seq" in edits.columns else []
    own = checkpoint(edits.select(F.col("offset").cast("long").alias("offset"), F.col("old_len").cast("long").alias("old_len"), F.coalesce("new_bytes", F.lit(b"")).alias("new_bytes"), *order))
    place = F.row_number().over(Window.partitionBy("offset").orderBy("old_len", *order, "new_bytes")).cast("long")
    own = own.withColumn("place", place)
    ranges = file_ranges(spark, path, range_bytes)
    pieces = checkpoint(_pieces(own, ranges, size, range_bytes))
    _check(own, pieces, size)
    none = [F.lit(None).cast(kind) for kind in ("long", "long", "string")]
    heads = ranges.select("block", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("drop"), F.lit(None).cast("binary").alias("new_bytes"), "start", "end", "file")
    if not size:  # an empty file has one range without bytes
        heads = spark.createDataFrame([(0, -1, 0, 0, None, 0, 0, path)], PIECES)
    both = heads.union(pieces.select("block", "at", "place", "drop", "new_bytes", *none))
    dealt = both.repartition("block").sortWithinPartitions("block", "at", F.col("drop") > 0, "place")

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = None, 0

        def rows(data: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
            for x in data:
                yield pa.RecordBatch.from_arrays([pa.array([head["block"]], pa.int64()), pa.array([x], pa.binary())], names=["block", "data"])

        def copied(to: int) -> Iterator[bytes]:
            with Source(head["file"]) as f:
                f.seek(at)
                left = to - at
                while left > 0:
                    data = f.read(min(CHUNK, left))
                    if not data:
                        raise OSError(f"{head['file']} has become shorter")
                    left -= len(data)
                    yield data

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] is not None:
                    if head is not None:
                        yield from rows(copied(head["end"]))
                    head, at = row, row["start"]
                    continue
                yield from rows(copied(row["at"]))
                if row["new_bytes"]:
                    yield from rows(iter([row["new_bytes"]]))
                at = row["at"] + row["drop"]
        if head is not None:
            yield from rows(copied(head["end"]))

    _write(dealt.mapInArrow(splice, "block long, data binary"), F.col("data"), out)
