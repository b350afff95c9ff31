"""A sparse line index beside a file: which line begins where, once for each interval of bytes.

The index is a Parquet table with a row for each interval, written by tasks that only count line ends. It lies in
a folder named by what it was made from (the files with their sizes and times, the interval, the encoding), so one that
does not fit the files any more is not found and a new one is made; a folder counts only when it is whole. When a
source has only grown, the rows of its full intervals are taken from the index before, if the bytes at their ends
are still the same, and tasks read the rest. A lookup reads the few intervals that the index names, and no others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.ordered import as_of, sum_before
from logweave.sources.bytelog import CHUNK, LINE_FEEDS, TAIL, ByteRange, Source, file_ranges, line_batch, open_path, register, sources_at, whole_lines

#: Bytes of an interval.
INTERVAL = 10_000_000
COUNTED = "source_id string, block long, start long, end long, first_start long, lines long, tail string"
FOUND = "source_id string, asked long, line_number long, file_offset long, line_len int, raw string"


def count_lines(path: str, start: int, end: int, feed: bytes = b"\n") -> tuple[int, int | None]:
    """(lines, where the first of them begins) of the lines that start in bytes [start, end)."""
    width, lines, first = len(feed), 0, None
    kind = "<u2" if feed == b"\n\x00" else ">u2" if width == 2 else np.uint8
    with Source(path) as f:
        end = min(end, f.size())
        if start == 0 and end > 0:
            lines, first = 1, 0
        at = max(0, start - width)
        f.seek(at)
        while at < end - width:
            data = f.read(min(CHUNK, end - width - at))
            if not data:
                break
            found = np.frombuffer(data[: len(data) // width * width], kind) == 10
            n = int(np.count_nonzero(found))
            if n and first is None:
                first = at + width * (int(found.argmax()) + 1)
            lines, at = lines + n, at + len(data)
    return lines, first


def _tail(path: str, end: int) -> str:
    with Source(path) as f:
        f.seek(max(0, end - TAIL))
        return hashlib.sha256(f.read(end - max(0, end - TAIL))).hexdigest()


def _counted(ranges: DataFrame, encoding: str) -> DataFrame:
    feed = LINE_FEEDS.get(encoding, b"\n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, block, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "start", "end")), strict=True):
                lines, first = count_lines(file, start, end, feed)
                rows.append((file, block, start, end, first, lines, _tail(file, end)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in COUNTED.split(", ")])

    return ranges.select("file", "block", "start", "end").repartition("file", "block").mapInArrow(count, COUNTED)


def _there(folder: str) -> bool:
    from pyarrow import fs

    store, name = open_path(f"{folder}/_SUCCESS")
    return store.get_file_info(name).type != fs.FileType.NotFound


def _others(home: str, own: str) -> list[str]:
    from pyarrow import fs

    store, name = open_path(home)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return []
    prefix = home[: len(home) - len(name)] if home.endswith(name) else ""
    return [prefix + x.path for x in store.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.Directory and x.base_name != own]


@dataclass
class SparseIndex:
    """``table`` has (source_id, block, start, end, first_start, lines, first_line, tail): the lines that start in
    bytes [start, end), the number of the first of them, from 1, and its offset, null if there is none."""

    path: str
    encoding: str
    table: DataFrame
    #: Intervals that were read to make it.
    counted: int

    def _scan(self, blocks: DataFrame) -> DataFrame:
        """The lines of some intervals; the driver plans a range for each."""
        spark = blocks.sparkSession
        register(spark)
        ranges = [[r.source_id, r.block, r.start, r.end, r.first_line] for r in blocks.where("lines > 0").orderBy("source_id", "block").collect()]
        rows = spark.read.format("bytelog").options(ranges=json.dumps(ranges), encoding=self.encoding).load(self.path)
        return rows.select("source_id", "line_number", "file_offset", "line_len", "raw")

    def _of(self, source_id: str | None) -> DataFrame:
        return self.table if source_id is None else self.table.where(F.col("source_id") == source_id)

    def lines(self, first: int, count: int = 1, source_id: str | None = None) -> DataFrame:
        """``count`` lines of a source from line ``first`` on; a number below 1 is refused."""
        if first < 1:
            raise ValueError("line numbers begin at 1")
        last = first + count - 1
        near = self._of(source_id).where((F.col("first_line") <= last) & (F.col("first_line") + F.col("lines") > first))
        return self._scan(near).where(F.col("line_number").between(first, last))

    def at_offset(self, offset: int, source_id: str | None = None) -> DataFrame:
        """The line of a source that holds a byte; none beyond its end."""
        row = F.struct(*self.table.columns)
        begun = self._of(source_id).groupBy("source_id").agg(F.max("end").alias("size"), F.max_by(row, F.when(F.col("first_start") <= offset, F.col("first_start"))).alias("row"))
        rows = self._scan(begun.where(F.col("size") > offset).select("row.*")).where(F.col("file_offset") <= offset)
        return rows.groupBy("source_id").agg(F.max_by(F.struct(*rows.columns), "file_offset").alias("row")).select("row.*")

    def bytes(self, start: int, end: int, source_id: str | None = None) -> DataFrame:
        """The lines of a source that touch bytes [start, end)."""
        before = self.at_offset(start, source_id).where(F.col("file_offset") < start)
        inside = self._scan(self._of(source_id).where((F.col("start") < end) & (F.col("end") > start)))
        found = before.union(inside.where(F.col("file_offset").between(start, end - 1)))
        return found if start < end else found.limit(0)

    def look_up(self, asked: DataFrame, by: str = "line_number") -> DataFrame:
        """(source_id, asked, line_number, file_offset, line_len, raw) for each row (source_id, asked): the line of that
        number, or with ``by`` = ``offset`` the one that holds that byte. Tasks read each interval once, whatever is asked of it."""
        place = "first_line" if by == "line_number" else "first_start"
        known = self.table.where("lines > 0")
        near = as_of(asked.select("source_id", F.col("asked").cast("long").alias("asked")), known, ["source_id"], "asked", place, ["block", "start", "end", "first_line"])
        dealt = near.where("block IS NOT NULL").repartition("source_id", "block").sortWithinPartitions("source_id", "block", "asked")
        by_number, encoding = by == "line_number", self.encoding

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walk, key = None, None
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if key != (row["source_id"], row["block"]):
                        key, walk = (row["source_id"], row["block"]), _Walk(row, encoding, by_number)
                    found = walk.to(row["asked"])
                    if found is not None:
                        out.append((row["source_id"], row["asked"], *found))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

        return dealt.select("source_id", "block", "start", "end", "first_line", "asked").mapInArrow(read, FOUND)


class _Walk:
    """Goes through the lines of an interval once, to ascending numbers or offsets."""

    def __init__(self, row: dict, encoding: str, by_number: bool):
        self.part = ByteRange(row["source_id"], row["block"], row["start"], row["end"], row["first_line"])
        self.feed = LINE_FEEDS.get(encoding, b"\n")
        self.encoding, self.by_number, self.seen = encoding, by_number, 0
        self.chunks = whole_lines(row["source_id"], row["start"], row["end"], self.feed)
        self.batch, self.keys, self.end = None, np.empty(0, np.int64), -1

    def _next(self) -> bool:
        at, chunk = next(self.chunks, (0, b""))
        if not chunk:
            return False
        self.batch = line_batch(self.part, self.seen, at, chunk, self.encoding, False)
        self.seen += self.batch.num_rows
        self.keys = self.batch.column("line_number" if self.by_number else "file_offset").to_numpy()
        self.end = self.keys[-1] + 1 if self.by_number else at + len(chunk)
        return True

    def to(self, asked: int) -> tuple | None:
        while asked >= self.end:
            if not self._next():
                return None
        i = int(np.searchsorted(self.keys, asked, "right")) - 1
        if i < 0:
            return None
        return tuple(self.batch.column(c)[i].as_py() for c in ("line_number", "file_offset", "line_len", "raw"))


def open_index(spark: SparkSession, path: str, home: str | None = None, interval: int = INTERVAL, encoding: str = "UTF-8") -> SparseIndex:
    """The sparse index of the sources at a path, made if there is none that fits; it lies in ``home``, beside the path
    unless set otherwise."""
    interval = max(2, interval // 2 * 2)
    home = (home or f"{path.rstrip('/')}.lines").rstrip("/")
    home = home if "://" in home or home.startswith("file:") else f"file://{home}"
    sources = sources_at(path)
    made_from = [[source, [[p.file, p.size, p.mtime] for p in parts]] for source, parts in sources]
    own = hashlib.sha256(json.dumps([interval, encoding, made_from]).encode()).hexdigest()[:32]
    folder = f"{home}/{own}"
    counted = 0
    if not _there(folder):
        counted = _make(spark, path, folder, [x for x in _others(home, own) if _there(x)], interval, encoding)
        for other in _others(home, own):
            store, name = open_path(other)
            store.delete_dir(name)
    return SparseIndex(path, encoding, spark.read.parquet(folder), counted)


def _make(spark: SparkSession, path: str, folder: str, before: list[str], interval: int, encoding: str) -> int:
    """Write the index; gives the number of intervals that were read."""
    ranges = file_ranges(spark, path, interval)
    if before:
        old = spark.read.parquet(*before).where((F.col("end") - F.col("start") == interval) & (F.col("encoding") == encoding)).select(*[c.split()[0] for c in COUNTED.split(", ")])
        old = old.dropDuplicates(["source_id", "block", "start", "end", "tail"])
        same = old.join(ranges.select(F.col("file").alias("source_id"), "block", "start", "end"), ["source_id", "block", "start", "end"], "left_semi")
        kept = _unchanged(same)
        todo = ranges.join(kept.select(F.col("source_id").alias("file"), "block"), ["file", "block"], "left_anti")
    else:
        kept, todo = None, ranges
    fresh = _counted(todo, encoding)
    both = fresh if kept is None else kept.select(fresh.columns).union(fresh)
    table = sum_before(both, ["source_id"], "block", "lines", "_before", 10_000).withColumn("first_line", F.col("_before") + 1).drop("_before")
    table.withColumn("encoding", F.lit(encoding)).write.mode("overwrite").parquet(folder)
    return todo.count()


def _unchanged(rows: DataFrame) -> DataFrame:
    """The intervals up to the first one whose last bytes have changed."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [_tail(s, e) == t for s, e, t in zip(*(batch.column(c).to_pylist() for c in ("source_id", "end", "tail")), strict=True)]
            yield batch.append_column("same", pa.array(same, pa.bool_()))

    seen = rows.mapInArrow(check, f"{COUNTED}, same boolean")
    broken = seen.where("NOT same").groupBy("source_id").agg(F.min("block").alias("broken"))
    return seen.where("same").join(broken, "source_id", "left").where("broken IS NULL OR block < broken").drop("same", "broken")
