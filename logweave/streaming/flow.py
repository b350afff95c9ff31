"""Forward questions over a trace that grows: instructions and runs as state of a stream.

Two stateful operators follow each other. The first one, by source, holds the last instruction until the line that ends
its memory lines has come; it numbers lines and instructions. The second one, by question and source, holds
what is tainted. State is one row a source and one a question; what a task holds besides is its part of a
micro-batch, which ``max_bytes`` of the tail bounds. Expressions between the two are those of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.functions import trace as T
from logweave.operators import dataflow, trace
from logweave.operators.forward import advance, hit_schema
from logweave.streaming.tail import tail_lines

OPEN = "n_lines long, n_insns long, end long, raw string, line_number long, file_offset long, line_len int, rw array<string>, addr array<long>, val array<long>"
WHOLE = "idx long, line_number long, file_offset long, line_len int, raw string, kind string, r_addr array<long>, r_val array<long>, w_addr array<long>, w_val array<long>"
RUN = "status string, idle long, first long, last long, locs array<string>, vals array<long>"
#: Accesses of a kind that an instruction keeps.
KEPT = 2


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows): the rows of a key that a task has in an Arrow batch, as one Arrow stream. Stateful operators make an
    object of each row that they get, which takes longer than what is done with it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
                places.setdefault(key, []).append(i)
            for at in places.values():
                own, sink = batch.take(pa.array(at)), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(own.column(k).slice(0, 1) for k in keys), data], names=[*keys, "rows"])

    return rows.mapInArrow(pack, ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + ["rows binary"]))


def _ordered(packs: Iterator[Row], order: str) -> Iterator[dict]:
    tables = [pa.ipc.open_stream(pack["rows"]).read_all() for pack in packs]
    for batch in pa.concat_tables(tables).sort_by(order).to_batches(max_chunksize=4096):
        yield from batch.to_pylist()


class Keyed(StatefulProcessor):
    """One value of state a key, which a class of its own makes of it and gives back with ``state``."""

    def __init__(self, kind: type, schema: str, order: str, add: Callable[[object, dict], list[tuple]], names: list[str]):
        self.kind, self.schema, self.order, self.add, self.names = kind, schema, order, add, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = self.kind(*self.value.get()) if self.value.exists() else self.kind()
        out = [Row(*self.names)(*key, *x) for row in _ordered(rows, self.order) for x in self.add(now, row)]
        self.value.update(now.state())
        yield from out

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, keys: list[str], kind: type, state: str, order: str, add: Callable[[object, dict], list[tuple]], schema: str) -> DataFrame:
    """``add`` of the rows of each key in order; what the state is kept in has to be RocksDB for that."""
    conf = rows.sparkSession.conf
    if conf.get(STORE, "").endswith("HDFSBackedStateStoreProvider") or not conf.get(STORE, ""):
        conf.set(STORE, ROCKS)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return _packed(rows, keys).groupBy(*keys).transformWithState(Keyed(kind, state, order, add, names), schema, "append", "None")


class Assembly:
    """The instruction of a source whose memory lines are not all here, and the counts up to it."""

    def __init__(self, n_lines: int = 0, n_insns: int = 0, end: int = 0, raw: str | None = None, line_number: int = 0, file_offset: int = 0, line_len: int = 0, rw: list | None = None, addr: list | None = None, val: list | None = None):
        self.n_lines, self.n_insns, self.end = n_lines, n_insns, end
        self.head = None if raw is None else (line_number, file_offset, line_len, raw)
        self.own = list(zip(rw or [], addr or [], val or [], strict=True))

    def state(self) -> tuple:
        line_number, file_offset, line_len, raw = self.head or (0, 0, 0, None)
        return (self.n_lines, self.n_insns, self.end, raw, line_number, file_offset, line_len, *([x[i] for x in self.own] for i in range(3)))

    def _emitted(self, head: tuple, kind: str) -> tuple:
        accesses = [[x[i] for x in self.own if x[0] == rw] for rw in "RW" for i in (1, 2)]
        self.n_insns += 1
        return (self.n_insns - 1, *head, kind, *accesses)

    def add(self, row: dict) -> list[tuple]:
        """What is whole when a line has come."""
        if row["file_offset"] < self.end:
            raise ValueError(f"the log has been rewritten: a line at byte {row['file_offset']} came after byte {self.end} had been read")
        self.end = row["file_offset"] + row["line_len"] + 1
        self.n_lines += 1
        kind, out = row["kind"], []
        if kind == "MEM":
            if self.head and sum(x[0] == row["rw"] for x in self.own) < KEPT:
                self.own.append((row["rw"], row["addr"], row["val"] if row["known"] else None))
        elif kind:
            if self.head:
                out.append(self._emitted(self.head, "INSN"))
            head = (self.n_lines, row["file_offset"], row["line_len"], row["raw"])
            self.own, self.head = [], head if kind == "INSN" else None
            if kind == "EXT":
                out.append(self._emitted(head, kind))
        return out


def instructions(lines: DataFrame) -> DataFrame:
    """The ruled instructions of a stream of lines (source_id, file_offset, line_len, raw), as ``trace.parse_trace`` and
    ``dataflow.with_rules`` have them.

    The lines of a source have to come in order from its first one on, as the tail gives them; within a micro-batch
    any order will do. An instruction is there when a later one has begun, so the last one waits. A source that is
    rewritten ends the query with an error: what had been tainted in it means nothing any more.
    """
    raw, kind = F.col("raw"), T.kind(F.col("raw"))
    typed = lines.select("source_id", "file_offset", F.col("line_len").cast("int").alias("line_len"), F.coalesce(kind, F.lit("")).alias("kind"), "raw")
    typed = typed.withColumn("a", F.when(F.col("kind") == "MEM", T.access(raw)))
    sent = typed.select(
        "source_id", "file_offset", "line_len", "kind", F.when(F.col("kind").isin("INSN", "EXT"), raw).otherwise("").alias("raw"), F.coalesce("a.rw", F.lit("")).alias("rw"),
        F.coalesce("a.addr", F.lit(0)).cast("long").alias("addr"), F.coalesce("a.val", F.lit(0)).cast("long").alias("val"), F.col("a.val").isNotNull().alias("known"),
    )
    schema = f"source_id {lines.schema['source_id'].dataType.simpleString()}, {WHOLE}"

    whole = _stateful(sent, ["source_id"], Assembly, OPEN, "file_offset", Assembly.add, schema)
    both = lambda side: F.zip_with(f"{side}_addr", f"{side}_val", lambda a, v: F.struct(a.alias("addr"), v.alias("val"), F.lit(False).alias("inferred"))).cast(trace.ACCESS)
    return dataflow.with_rules(trace.typed_instructions(whole.withColumns({"reads": both("r"), "writes": both("w")}), "idx"))


class Run:
    """A question on its way: what is tainted, for how many rows nothing was touched, where it began and what it saw last."""

    def __init__(self, status: str = "waits", idle: int = 0, first: int = 0, last: int = 0, locs: list | None = None, vals: list | None = None):
        self.status, self.idle, self.first, self.last = status, idle, first, last
        self.live = dict(zip(locs or [], vals or [], strict=True))

    def state(self) -> tuple:
        return (self.status, self.idle, self.first, self.last, list(self.live), list(self.live.values()))

    def _stop(self, idx: int, reason: str) -> list[tuple]:
        self.status, self.live = "done", {}
        return [(idx, "stop", [reason], None, None, None)]

    def add(self, row: dict, max_idle: int | None, window_bytes: int | None) -> list[tuple]:
        """The events (idx, kind, locs, addr, expected, actual) of the next row."""
        idx = row["idx"]
        if self.status == "done" or idx < row["start_idx"]:
            return []
        if self.status == "waits":
            self.status, self.live, self.first, self.last = "runs", {row["seed"]: None}, row["file_offset"], idx
            if idx == row["start_idx"]:
                return [(idx, "hit", [row["seed"]], None, None, None)]
        if window_bytes is not None and row["file_offset"] > self.first + window_bytes:
            return self._stop(self.last, "WindowEnd")
        self.last = idx
        wrong, touched = advance(self.live, row)
        out = [(idx, "mismatch", [], *x) for x in wrong]
        self.idle = 0 if touched else self.idle + 1
        if touched:
            out.append((idx, "hit", sorted(self.live), None, None, None))
        if not self.live:
            out += self._stop(idx, "AllTaintCleared")
        elif max_idle is not None and self.idle >= max_idle:
            out += self._stop(idx, "ScanLimitReached")
        return out


def _number(text: str) -> int | None:
    return int(text) if text else None


def _unpacked(row: dict) -> dict:
    pairs = lambda a, b: list(zip(row[a], row[b], strict=True))
    return row | {"clears": list(row["clears"]), "flow": [{"in_loc": a, "out_loc": b} for a, b in pairs("from_loc", "to_loc")]} | {
        name: [{"loc": a, "val": _number(v)} for a, v in pairs(f"{name}_loc", f"{name}_val")] for name in ("seen", "stored")
    }


def forward_stream(ruled: DataFrame, queries: DataFrame, max_idle: int | None = 50_000, window_bytes: int | None = 200_000_000) -> DataFrame:
    """``operators.forward`` over a stream of ruled instructions: the same rows whatever the micro-batches are.

    ``queries`` is a table (query_id, source_id, loc, start_idx). A run ends as in a batch, but not at the end of the trace,
    which a stream has not. Rows come out in append mode, those of a question in order of the trace batch by batch.
    """
    mem = lambda c: F.transform(c, lambda a: F.concat(F.lit("m"), F.lower(F.hex(a["addr"]))))
    val = lambda c: F.transform(c, lambda a: F.coalesce(a["val"].cast("string"), F.lit("")))
    loads = F.when(F.col("category") == "Load", F.col("reads")).otherwise(F.array().cast(trace.ACCESS))
    part = lambda name: F.transform("flow", lambda f: f[name])
    rows = ruled.select(
        "source_id", "idx", "file_offset", "touched", "clears", part("in_loc").alias("from_loc"), part("out_loc").alias("to_loc"),
        mem(loads).alias("seen_loc"), val(loads).alias("seen_val"), mem("writes").alias("stored_loc"), val("writes").alias("stored_val"),
    )
    asked = queries.select("query_id", "source_id", F.col("loc").alias("seed"), "start_idx")
    own = rows.join(asked, "source_id").where("idx >= start_idx")
    schema = hit_schema(queries)

    def add(run: Run, row: dict) -> list[tuple]:
        return [] if run.status == "done" else run.add(_unpacked(row), max_idle, window_bytes)

    return _stateful(own, ["query_id", "source_id"], Run, RUN, "idx", add, hit_schema(queries))


def tail_forward(spark: SparkSession, path: str, queries: DataFrame, max_idle: int | None = 50_000, window_bytes: int | None = 200_000_000, max_bytes: int = 8 << 20) -> DataFrame:
    """A stream of the rows of forward questions about a log that grows; ``queries`` name it as ``source_id``."""
    return forward_stream(instructions(tail_lines(spark, path, max_bytes)), queries, max_idle, window_bytes)
