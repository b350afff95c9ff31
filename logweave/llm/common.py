"""Shared helpers of the training-data operators: tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import sys
import time
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.storage import discard, own_dir, written

__all__ = ["discard", "held", "map_columns", "own_dir", "table", "written"]

#: Rows that a Python worker receives at once. Documents may be long, so batches stay small.
ARROW_ROWS = 256
#: Seconds that a Python worker keeps what no task asked it for.
IDLE = 5.0

_held: dict[Hashable, list] = {}  # key: what is held, when it was last asked for


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for ``key``, kept by this Python worker from task to task.

    Workers outlive the stages of a pipeline. So what was not asked for since IDLE seconds goes when another thing is asked
    for or a map begins; else the memos of all stages add up in every worker.
    """
    drop_idle(key)
    own = _held.get(key)
    if own is None:
        own = _held[key] = [make(), 0.0]
    own[1] = time.monotonic()
    return own[0]


def drop_idle(but: Hashable = None) -> None:
    """Drop what is held and idle, and free memory that Python, Arrow and the C library would keep for later."""
    now = time.monotonic()
    idle = [k for k, (_, at) in _held.items() if k != but and now - at > IDLE]
    if not idle:
        return
    for k in idle:
        del _held[k]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def used_since(began: float) -> None:
    """What was asked for since ``began`` was used until now."""
    for own in _held.values():
        if own[1] >= began:
            own[1] = time.monotonic()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(df: DataFrame, columns: list[str], schema: str, f: Callable[..., list[pa.Array]], rows: int = ARROW_ROWS) -> DataFrame:
    """A map-only pass: ``f`` gets the Arrow arrays of ``columns`` batch by batch and returns those of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_idle()
        for batch in batches:
            if batch.num_rows:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    began = time.monotonic()
                    found = f(*part.columns)
                    used_since(began)
                    yield pa.RecordBatch.from_arrays(found, names=names)

    from pyspark.sql.types import _parse_datatype_string

    names = [field.name for field in _parse_datatype_string(schema)]
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
