"""Exact top-k search by inner product, in tiles.

Queries and vectors are packed into matrices of bounded size. Vectors are dealt over shards by their bytes, and every
block of queries visits every shard once. A task holds the vectors of one shard in the narrowest integers, in order of
their ids, and takes blocks of queries one by one. A tile is the product of a block of queries and a slice of the
shard; what it has beyond the k best of the tiles before is selected, and the lists of shards are merged per
query in a tree. So a task holds one shard, one block and one tile, and the driver the number of bytes.

Defined cases: null vectors and vectors with null or non-finite components take no part, nor do rows with
a null id; vectors are compared with those of their own length; a row is not compared with rows of its
own id; repeated rows are repeated candidates, while a repeated query is one query (of its vectors the
one that sorts first); ties go to the smaller id; fewer candidates than k are all given; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.storage import written

#: Rows of a block of queries, and of a block of vectors and a tile.
QUERIES, VECTORS = 512, 1024
#: Bytes of the vectors of a shard, and shards that there are for fewer bytes if as many partitions are.
SHARD, SHARDS = 64 << 20, 64
#: Sums below these are exact in single and in double precision.
EXACT = ((np.float32, float(2**23)), (np.float64, float(2**52)))
#: Below every score.
LOW = np.iinfo(np.int64).min
#: Lists that a merge joins at once.
FAN_IN = 16


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): vectors as floor(``scale`` * component), without those that take no part."""
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    clean = clean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return clean.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


BLOCK = "dim int, size long, ids binary, matrix binary"


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integers that hold them."""
    least, most = matrix.min(initial=0), matrix.max(initial=0)
    return matrix.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of equal length, as matrices of the narrowest integers; their bytes are ``size``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            matrix = _narrow(matrix)
            columns = [pa.array([dim], pa.int32()), pa.array([matrix.nbytes], pa.int64()), pa.array([ids.astype("<i8").tobytes()]), pa.array([matrix.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "size", "ids", "matrix"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows // 4):
                part = batch.slice(at, rows // 4)
                ids, v = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                lengths, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(lengths) - lengths
                for dim in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == dim)
                    matrix = flat[starts[own][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((ids[own], matrix.reshape(len(own), dim)))
                    if sum(len(x[0]) for x in held[dim]) > rows * 3 // 4:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return vectors.select("id", "v").mapInArrow(pack, BLOCK)


def _read(dim: int, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(matrix, f"<i{len(matrix) // (len(own) * dim or 1) or 2}").reshape(len(own), dim)


def _norm(matrix: np.ndarray) -> float:
    """The largest length of a row, and a little more."""
    return 1.001 * float(np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64).max(initial=0)))


def _tiles(held: list[tuple[np.ndarray, np.ndarray]], rows: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(ids, vectors, norm): slices of all that is held, in order of the ids."""
    ids = np.concatenate([x[0] for x in held])
    matrix = np.concatenate([x[1] for x in held])
    held.clear()
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    return [(ids[at : at + rows], part := matrix[at : at + rows], _norm(part)) for at in range(0, len(ids), rows)]


def _product(queries: np.ndarray, vectors: np.ndarray, most: float, room: dict[type, np.ndarray]) -> np.ndarray:
    """Exact inner products. ``most`` is the product of the largest lengths: no sum of terms is beyond it, so where floats
    hold all integers up to it, none rounds; else the sums are of integers. ``room`` is used again by the next tile."""
    kind = next((t for t, limit in EXACT if most < limit), np.int64)
    out = room.setdefault(kind, np.empty((len(queries), len(vectors)), kind))[:, : len(vectors)]
    return np.matmul(queries.astype(kind), vectors.astype(kind).T, out=out)


def _search(own: np.ndarray, queries: np.ndarray, tiles: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): the best ``k`` of each query by (score, smaller id), without the query's own id.

    Tiles come in order of ids, so what only equals the k-th best of earlier tiles is beyond it.
    """
    score, named = np.full((len(own), k), LOW), np.zeros((len(own), k), np.int64)
    norm, waiting, size, room = _norm(queries), [], 0, {}

    def settle() -> None:
        row, vec, found = (np.concatenate(x) for x in zip(*waiting, strict=True))
        of = np.unique(row)
        at, place = np.nonzero(score[of] > LOW)
        kept = _merge([(of[at], named[of][at, place], score[of][at, place]), (row, vec, found)], k)
        place = np.arange(len(kept[0])) - np.searchsorted(kept[0], kept[0])
        named[kept[0], place], score[kept[0], place] = kept[1], kept[2]
        waiting.clear()

    for ids, vectors, length in tiles:
        scores = _product(queries, vectors, norm * length, room)
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for row in np.flatnonzero(first < last):
            scores[row, first[row] : last[row]] = LOW
        if (bar := score[:, k - 1 :]).min() == LOW and len(ids) > k:  # no list is full before the first tile
            hit = (scores >= np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]) & (scores > LOW)
        else:
            hit = scores > bar.astype(scores.dtype)
        some = np.flatnonzero(hit.any(axis=1))
        if len(some):
            at, column = np.nonzero(hit[some])
            row = some[at]
            waiting.append((row, ids[column], scores[row, column].astype(np.int64)))
            size += len(row)
        if waiting and (size >= score.size or bar.min() == LOW):
            settle()
            size = 0
    if waiting:
        settle()
    row, place = np.nonzero(score > LOW)
    return own[row], named[row, place], score[row, place]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, query_rows: int = QUERIES, vector_rows: int = VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (id, v) its best ``k`` of ``vectors`` (id, v)."""
    blocks = written(_blocks(vectors, vector_rows), "topk-vectors")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-size // SHARD), min(SHARDS, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    single = queries.groupBy("id").agg(F.min("v").alias("v"))
    asked = _blocks(single, query_rows).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(True).alias("asked"), "ids", "matrix")
    given = blocks.select(F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(False).alias("asked"), "ids", "matrix")
    dealt = given.union(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tiles = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                dim, asks, ids, matrix = (batch.column(c)[i].as_py() for c in range(1, 5))
                if dim != now:
                    now, held, tiles = dim, [], []
                if not asks:
                    held.append(_read(dim, ids, matrix))
                    continue
                if held:
                    tiles = _tiles(held, vector_rows)
                if tiles:
                    columns = _search(*_read(dim, ids, matrix), tiles, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    lists = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    fan = 1
    while fan * FAN_IN < shards:  # a level of the tree: lists of FAN_IN groups of shards become one
        fan *= FAN_IN
        lists = _merged(lists.withColumn("branch", F.pmod(F.xxhash64("vec_id"), F.lit(-(-shards // fan)))), ["query_id", "branch"], k)
    best = _merged(lists, ["query_id"], k, ranked=True)
    return best.select("query_id", "rank", "vec_id", "score")


def _merge(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, named, found = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((named, -found, row))
    row, named, found = row[order], named[order], found[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], named[keep], found[keep]


def _merged(lists: DataFrame, by: list[str], k: int, ranked: bool = False) -> DataFrame:
    """The best ``k`` of each group; a group has at most k rows for each of the lists that are joined."""
    entry = F.struct((-F.col("score")).alias("less"), "vec_id", "score")
    best = lists.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("place", "e"))
    rank = [(F.col("place") + 1).cast("int").alias("rank")] if ranked else []
    return out.select("query_id", *rank, F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
