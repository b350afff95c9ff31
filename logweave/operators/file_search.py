"""Matches in whole files, over line ends, in byte ranges side by side.

A match belongs to the range in which it starts. A task reads its range and as many bytes after it as its
matches take: where the engine reaches the end of what was read, or a match comes within ``look`` bytes of it, twice as much
is read, up to the end of the file. Matches do
not overlap, so where one runs into later ranges, these have to begin after it: ranges whose beginning that moves are
searched again, until none moves any more. Mostly that is one further round over few ranges; it ends for any file, as
after each round one more range at least is final.

Patterns are those of Python's ``regex`` on whole files: ``^`` and ``$`` hold at line ends, ``.`` stops at them, and
``\\n`` and classes such as ``\\s`` go over them. Offsets are bytes. Bytes that are no valid UTF-8 are characters that only
negated classes and ``.`` match; they are counted as they are. Empty matches are none. Matches are those of the whole
file as long as what decides whether a match goes on lies within ``look`` bytes behind its end, and what a look-behind sees
within ``look`` bytes before its range; matches themselves may have any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.sources.bytelog import RANGE, Source, file_ranges, sources_at
from logweave.storage import checkpoint as written

LOOK = 1 << 16
Checkpoint = Callable[[DataFrame], DataFrame]
FOUND = "source_id string, block long, byte_offset long, match_len long"


def file_pattern(query: str, use_regex: bool = False, case_sensitive: bool = False, whole_word: bool = False):
    """A pattern for :func:`file_matches`; a literal may hold line ends."""
    import regex

    body = query if use_regex else regex.escape(query)
    if whole_word:
        body = rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"
    return regex.compile(body, regex.MULTILINE | (0 if case_sensitive else regex.IGNORECASE))


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def _whole(data: bytes, first: bool, last: bool) -> tuple[int, int]:
    """Where the whole characters of bytes begin and end; what is cut at either side is left out unless it is an end of
    the file."""
    low, high = 0, len(data)
    if not first:
        while low < min(3, high) and data[low] & 0xC0 == 0x80:
            low += 1
    if not last:
        for back in range(1, min(4, high - low) + 1):
            lead = data[high - back]
            if lead & 0xC0 != 0x80:
                if lead >= 0xC0 and back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    high -= back
                break
    return low, high


def _boundary(data: bytes, at: int) -> int:
    """``at``, or the end of the character that began before it and goes on there: that one belongs to the range before."""
    for back in range(1, min(3, at) + 1):
        lead = data[at - back]
        if lead & 0xC0 != 0x80:
            width = 1 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            try:
                return at - back + width if width > back and data[at - back : at - back + width].decode() else at
            except UnicodeDecodeError:
                return at
    return at


def matches_in_range(path: str, start: int, end: int, entry: int, pattern, look: int = LOOK) -> Iterator[tuple[int, int]]:
    """(offset, length) in bytes of the matches that start in bytes [max(start, entry), end) of a source.

    Where the end of what it has read keeps the engine from deciding, or is less than ``look`` bytes behind a match,
    more is read, unless it is the end of the file.
    """
    begin, reach = max(start, entry), 2 * look
    size = lambda text: len(text.encode("utf-8", "surrogateescape"))
    with Source(path) as f:
        while begin < end:
            low, high = max(0, begin - look), min(f.size(), end + reach)
            f.seek(low)
            data = f.read(high - low)
            last = high == f.size()
            a, b = _whole(data, low == 0, last)
            at = min(b, max(a, _boundary(data, begin - low)))
            text = _text(data[a:b])
            place, offset = len(_text(data[a:at])), low + at
            open_ = False
            for m in pattern.finditer(text, place, partial=not last):
                offset += size(text[place : m.start()])
                place = m.start()
                if offset >= end:
                    break
                length = size(m[0])
                if m.partial or not last and offset + length + look > low + b:
                    open_ = True
                    break
                if length:
                    yield offset, length
                    offset, place = offset + length, m.end()
                    begin = offset
            if not open_:
                return
            reach *= 2


def _search(ranges: DataFrame, pattern, look: int, checkpoint: Checkpoint) -> DataFrame:
    """The matches that start in ``ranges`` (file, block, start, end, from): those of a file follow each other, and nothing
    before byte ``from`` of it is searched."""
    text, flags = pattern.pattern, pattern.flags

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(text, flags)
        for batch in batches:
            for row in batch.to_pylist():
                found = list(matches_in_range(row["file"], row["start"], row["end"], row["entry"], compiled, look))
                n = len(found)
                columns = [pa.array([row["file"]] * n, pa.string()), pa.array([row["block"]] * n, pa.int64()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["source_id", "block", "byte_offset", "match_len"])

    def searched(rows: DataFrame) -> DataFrame:
        spread = rows.repartition(F.col("file"), F.col("block"))  # ranges are few rows with much work each
        return checkpoint(spread.mapInArrow(search, FOUND))

    ranges = checkpoint(ranges)
    entries = ranges.withColumn("entry", F.greatest("start", "from"))
    found = searched(entries)
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        reached = found.groupBy(F.col("source_id").alias("file"), "block").agg(F.max(F.col("byte_offset") + F.col("match_len")).alias("reached"))
        now = ranges.join(reached, ["file", "block"], "left").select(*ranges.columns, F.greatest("start", "from", F.coalesce(F.max("reached").over(order), F.lit(0))).alias("entry"))
        now = checkpoint(now)
        moved = checkpoint(now.join(entries.select("file", "block", F.col("entry").alias("was")), ["file", "block"]).where("entry <> was").drop("was"))
        if moved.isEmpty():
            return found
        kept = found.join(moved.select(F.col("file").alias("source_id"), "block"), ["source_id", "block"], "left_anti")
        found = checkpoint(kept.select(found.columns).union(searched(moved)))
        entries = now


def file_matches(spark: SparkSession, path: str, pattern, range_bytes: int = RANGE, look: int = LOOK, checkpoint: Checkpoint = written) -> DataFrame:
    """(source_id, byte_offset, match_len) of every match of ``pattern`` in the sources at ``path``; each is one text."""
    ranges = file_ranges(spark, path, range_bytes).withColumn("from", F.lit(0).cast("long"))
    return _search(ranges, pattern, look, checkpoint).select("source_id", "byte_offset", "match_len")


def first_matches(
    spark: SparkSession, path: str, pattern, limit: int = 1, range_bytes: int = RANGE, look: int = LOOK, wave: int = 4, checkpoint: Checkpoint = written,
) -> tuple[DataFrame, int]:
    """The first ``limit`` matches in order of source and offset, and how many ranges were searched for them.

    Ranges are searched in order, in waves that double, until there are enough matches: those of a wave are final before
    the next one begins, so a match near the beginning of a large file costs the first wave only.
    """
    sizes = sorted((source, sum(part.size for part in parts)) for source, parts in sources_at(path))
    counts = [-(-size // range_bytes) for _, size in sizes]
    firsts = spark.createDataFrame([(source, sum(counts[:i])) for i, (source, _) in enumerate(sizes)], "file string, first long")
    ranges = checkpoint(file_ranges(spark, path, range_bytes).join(firsts, "file").withColumn("at", F.col("first") + F.col("block")).drop("first"))
    done, total, last, begin = 0, 0, "", 0
    found: list[DataFrame] = []
    while done < sum(counts) and total < limit:
        part = ranges.where((F.col("at") >= done) & (F.col("at") < done + wave)).drop("at")
        part = part.withColumn("from", F.when(F.col("file") == last, F.lit(begin)).otherwise(0).cast("long"))
        found.append(_search(part, pattern, look, checkpoint))
        ends = found[-1].groupBy("source_id").agg(F.count("*").alias("n"), F.max(F.col("byte_offset") + F.col("match_len")).alias("reached")).orderBy("source_id").collect()
        total += sum(r.n for r in ends)
        if ends:
            last, begin = ends[-1].source_id, ends[-1].reached
        done, wave = done + wave, 2 * wave
    every = reduce(DataFrame.union, found) if found else spark.createDataFrame([], FOUND)
    return every.orderBy("source_id", "byte_offset").limit(limit).select("source_id", "byte_offset", "match_len"), min(done, sum(counts))
