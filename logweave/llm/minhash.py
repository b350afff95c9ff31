"""Near-duplicate documents by MinHash.

1. Every document is hashed once: a single hash puts each shingle into one of BINS bins, whose least
   hash is kept; empty bins borrow from the first filled bin of an order drawn for each bin (one
   permutation with optimal densification). Rows of bins form bands.
2. Documents with equal sets become one class, so copies cost a row and no pairs.
3. A band bucket gives star-shaped candidates: its smallest class against each other one. Candidates
   whose sketches agree enough are confirmed on the full sets.
4. A star can miss a link between two of its points. So classes that share a bucket and are still in
   different components are read again. Their shingles get one order, rare ones first, and each class is keyed by
   the first ones of its set: as many as its set can have apart from a linked one, and one more. Linked sets share one of these
   whatever the order is, so nothing is lost here; the order only keeps groups small: near copies that do not link have that many rare
   shingles of their own. What shares a key forms families: first by stars again, by sketch, then by sketch in blocks of bounded size
   between the families that are left in a group. Within a family classes of different components are
   confirmed on the full sets, by a star first and then, if it leaves several components, in bounded blocks. Only links leave a
   block, never its pairs.
5. Components follow by contracting edges until none is left; a component is named by its smallest id.

Defined cases: words are what ASCII white space parts, A-Z lower-cased; a document with fewer words
than a shingle has its whole sequence as one shingle; one without words (or with a null text) has an
empty set and links with nothing; rows with a null id link with nothing and are kept; rows are documents
of their own also where they share an id, so each has the size and the component of its own text, and
links of any of them count; long texts are used whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import discard, held, map_columns, written

#: Bands and bins in a band: at a similarity of 0.85, 1 - (1 - 0.85**5)**32 = 1 - 7e-9 of the pairs meet.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Longer keys of a bucket and bins that each adds. Of 30,000 random pairs each at 4 of 5, 8 of 10, 16 of 20, 80 of 100 and
#: 85 of 100 shingles, bands alone miss 1, 0, 0, 0, 0 and longer keys 1, 0, 0, 0, 0.
LONGER, LONGER_BINS = 8, 4
#: Sketches of pairs at the threshold agree on fewer bins than their mean less so many deviations once in 10**6.
DEVIATIONS = 4.7
#: Members of a block and words in it, at most (a single longer document makes a block of its own).
BLOCK, BLOCK_WORDS = 512, 1_000_000
#: Slots of the table of counts that orders shingles; any order is right, a finer one makes smaller groups.
SLOTS = 1 << 18
MEMO = 200_000

_ODD = np.random.default_rng(20_011).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; words repeat, so hashes are memoised."""
    return np.fromiter(map(held("minhash words", _WordHashes).__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, given the hashes of the words."""
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        part = hashes[i : len(hashes) - width + 1 + i]
        turn = np.uint64(1 + 21 * i % 63)
        total += ((part << turn) | (part >> (np.uint64(64) - turn))) * _ODD[i % len(_ODD)]
    return _mix(total)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """The hashes of the distinct shingles of ``text``, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        return _mix(np.add.reduce(hashes * _ODD[: len(words)], keepdims=True, dtype=np.uint64) + np.uint64(len(words)))
    return np.unique(window_hashes(hashes, width))


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For each bin, the order in which it asks the others for a value."""
    rng = np.random.default_rng(47)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def bin_values(hashes: np.ndarray) -> np.ndarray:
    """The densified least hashes of the bins; ``hashes`` ascend and are not empty."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # bins ascend with the hashes
    values = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    values[bins[first]] = hashes[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        orders = _orders()[empty]
        values[empty] = values[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    folded = (values.reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mix(folded + np.arange(BANDS, dtype=np.uint64) * _ODD[-1]).view(np.int64)


@lru_cache(maxsize=1)
def _longer_bins() -> np.ndarray:
    """For each band the bins that its longer keys add."""
    rng = np.random.default_rng(83)
    return np.stack([[rng.permutation(BINS)[:LONGER_BINS] for _ in range(LONGER)] for _ in range(BANDS)])


def longer_keys(keys: np.ndarray, bands: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The longer keys of buckets of sketches (a row each): a way to part large buckets that :func:`grouped` does without,
    since keys by shingles lose no link and take fewer rows."""
    picked = np.take_along_axis(sketch[:, None, :], _longer_bins()[bands], axis=2)
    added = np.ascontiguousarray(picked).view(np.uint32)[:, :, 0].astype(np.uint64)
    return _mix(_mix(added + np.arange(LONGER, dtype=np.uint64) * _ODD[-2]) + keys.view(np.uint64)[:, None]).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Of docs (id, mark, text): ``id``, ``mark``, ``n`` (size of the set), ``print`` (of the set), ``bands``
    and ``sketch`` (a byte for each bin)."""

    def sketch(ids: pa.Array, marks: pa.Array, texts: pa.Array) -> list[pa.Array]:
        import xxhash

        sizes, prints, bands, bytes_ = [], [], [], []
        for text in texts.to_pylist():
            found = shingle_set(text, width)
            sizes.append(len(found))
            if len(found):
                values = bin_values(found)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(values))
                bytes_.append(values.astype(np.uint8).tobytes())
            else:
                prints.append(None), bands.append(None), bytes_.append(None)
        return [ids, marks, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]

    return map_columns(docs, ["id", "mark", "text"], "id long, mark long, n long, print binary, bands array<long>, sketch binary", sketch)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """Of texts (id, text): ``id`` and ``hashes``, the bytes of the shingle set."""

    def hashed(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        return [ids, pa.array([shingle_set(text, width).tobytes() for text in texts.to_pylist()], pa.binary())]

    return map_columns(texts, ["id", "text"], "id long, hashes binary", hashed)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` (hashes) fall into each of SLOTS slots.

    Tasks count their sets and Spark sums the counts; what reaches the driver is a row for each slot at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total[_slots(np.frombuffer(raw.as_buffer(), np.uint64))] += 1  # slots that a set has twice count once
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["slot", "n"])

    found = sets.select("hashes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def first_shingles(hashes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, those of low counts first.

    A linked set holds ``percent`` in a hundred of the shingles at least. So of those before the first one that both hold
    there are no more than the rest, and that one is among the first of both sets.
    """
    n = (100 - percent) * len(hashes) // 100 + 1
    return hashes[np.lexsort((hashes, counts[_slots(hashes)]))[:n]]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b); a component is named by its smallest id.

    Each round maps every node to the first of itself and its neighbours and contracts the edges along
    that map, until no edge is left. The first round goes by id, so a star around its least node is done;
    later ones go by hashes that change from round to round, which shortens chains by a constant factor.
    Sums and joins only: a node with very many edges is pre-aggregated in the groupBy and split by Spark
    in the joins. Every round is written, so plans stay short and a lost executor costs its tasks only.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "edges")
    found, number = None, 0
    while True:
        if number:
            placed = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("place"), F.col(c).alias("node"))  # noqa: B023, E731
            near = both.groupBy("a").agg(F.min(placed("b")).alias("near")).select(F.col("a").alias("id"), F.least(placed("a"), F.col("near"))["node"].alias("to"))
        else:
            near = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("to"))
        to = written(near, "map")
        one = both.join(to, F.col("a") == F.col("id")).select(F.col("to").alias("a"), "b")
        two = one.join(to, F.col("b") == F.col("id")).select("a", F.col("to").alias("b"))
        left = written(two.where("a <> b").distinct(), "edges")
        discard(both)
        both, number = left, number + 1
        if found is None:
            found = to
        else:
            older = found
            found = written(older.join(to.toDF("at", "next"), F.col("to") == F.col("at"), "left").select("id", F.coalesce("next", "to").alias("to")), "map")
            discard(older, to)
        if both.isEmpty():
            break
    discard(both)
    if number == 1:
        return found.withColumnRenamed("to", "component")
    names = found.groupBy("to").agg(F.min("id").alias("component"))
    return found.join(names, "to").select("id", "component")


def _enough(sizes: np.ndarray, one: int, percent: int) -> np.ndarray:
    """Whether the sizes alone allow the similarity."""
    return 100 * np.minimum(sizes, one) >= percent * np.maximum(sizes, one)


def _least_agreeing(percent: int, n: np.ndarray) -> np.ndarray:
    """The bins on which sketches of linked sets agree, the smaller one of ``n`` shingles.

    Bins of a small set are mostly borrowed: only those that its shingles fill are drawn independently.
    """
    p = percent / 100
    filled = BINS * (1 - (1 - 1 / BINS) ** np.asarray(n, float))
    return np.floor(BINS * (p - DEVIATIONS * np.sqrt(p * (1 - p) / filled)))


def _linked(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int):
    return 100 * common >= percent * (n + m - common)


def confirm(pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` (a, b, text_a, text_b) whose full sets are similar enough."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, of_a, of_b = (column.to_pylist() for column in batch.columns)
            kept = []
            for i in range(batch.num_rows):
                if a[i] not in known:  # the pairs of a star come together
                    known = {a[i]: shingle_set(of_a[i], width)}
                x, y = known[a[i]], shingle_set(of_b[i], width)
                kept.append(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long")


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, root) that join what the symmetric matrix ``links`` joins."""
    label = np.arange(len(links))
    live = np.flatnonzero(links.any(axis=1))
    while True:
        least = label.copy()
        for i in live:
            least[i] = min(label[i], label[links[i]].min())
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(links)))
    return moved, label[moved]


def in_blocks(members: DataFrame, group: str, payload: list[str], links_of) -> DataFrame:
    """Edges (a, b) that ``links_of`` finds between members (``group``, id, component, n, ``payload``) of a group.

    A group is cut into blocks of bounded size by a hash of the id, and each pair of blocks is one task
    group, so that a group of any size is spread over tasks and no task holds more than two blocks.
    """
    sizes = members.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_WORDS)).alias("blocks"))
    sizes = written(sizes, "blocks")  # else the join would need a group's rows in one task before they are spread
    own = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n", *payload)

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        apart = part.component.to_numpy()[:, None] != part.component.to_numpy()
        if key[1] != key[2]:  # pairs within a block have a group of their own
            apart &= part.block.to_numpy()[:, None] != part.block.to_numpy()
        moved, root = _forest(links_of(part, apart)) if apart.any() else ([], [])
        ids = part.id.to_numpy()
        return pd.DataFrame({"a": ids[root], "b": ids[moved]}, dtype="int64")

    found = written(spread.groupBy(group, "i", "j").applyInPandas(compare, "a long, b long").distinct(), "links")
    discard(sizes)
    return found


def grouped(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """``id``, ``mark`` (a hash of the text), ``n`` and ``component_id`` of every row of ``docs``, and ``head_mark``:
    the row that stands for a component has its ``component_id`` and its ``head_mark``. Also the written tables
    that this is made from."""
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("mark"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    rows = written(sketches(keyed, width), "sketches")
    own_row = F.struct("id", "mark")
    classes = rows.where("id IS NOT NULL AND n > 0").groupBy("print").agg(F.min(own_row).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "print", "row", "n", "bands", "sketch"), "classes")
    brief = classes.select(F.col("node").alias("id"), "n", "sketch")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(id, text) of classes, once each."""
        of = nodes.join(classes.select("node", "row.*").toDF("node", "of_id", "of_mark"), nodes.id == F.col("node"))
        found = keyed.join(of.select("node", "of_id", "of_mark"), (F.col("id") == F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
        return found.groupBy("of_id", "of_mark", "node").agg(F.max("text").alias("text")).select(F.col("node").alias("id"), "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The rows (a, b) of ``pairs`` that are links."""
        likely = written(pairs, "likely")
        texts = texts_of(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
        paired = likely.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
        found = written(confirm(paired, percent, width), "confirmed")
        discard(likely)
        return found

    def stars(points: DataFrame) -> DataFrame:
        """The rows (centre, id) of ``points`` as (a, b) whose sketches allow a link."""
        both = points.select("centre", "id").distinct()
        both = both.join(brief.toDF("id", "n_b", "sketch_b"), "id").join(brief.toDF("centre", "n_a", "sketch_a"), "centre")
        return _likely(both, percent).select(F.col("centre").alias("a"), F.col("id").alias("b"))

    def parted(rows: DataFrame, group: str, by: str, once: bool = False) -> DataFrame:
        """``rows`` of the groups that hold several values of ``by``, with ``centre``, the least id of the group (one class is
        that of many groups, so few pairs are stars); with ``once`` of groups with the same members one stays."""
        mark = F.xxhash64("id")
        several = rows.groupBy(group).agg(F.min(by).alias("least"), F.max(by).alias("most"), F.min("id").alias("centre"), F.count("*").alias("size"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor"))
        several = several.where("least <> most").select(group, "centre", "size", "sum", "xor")
        if once:
            several = several.groupBy("size", "sum", "xor").agg(F.min(F.struct(group, "centre")).alias("one")).select("one.*")
        return rows.join(several.select(group, "centre"), group)

    def keyed_by_shingles(open_: DataFrame) -> DataFrame:
        """(key, id, component): the classes of ``open_`` (id, component) by the first shingles of their sets."""
        sets = written(shingle_sets(texts_of(open_.select("id")), width), "sets")
        counts = spark.sparkContext.broadcast(slot_counts(sets))  # a number for each slot

        def keys(ids: pa.Array, hashes: pa.Array) -> list[pa.Array]:
            found = [first_shingles(np.frombuffer(raw.as_buffer(), np.uint64), counts.value, percent).view(np.int64) for raw in hashes]
            return [ids, pa.array(found, pa.list_(pa.int64()))]

        firsts = map_columns(sets, ["id", "hashes"], "id long, keys array<long>", keys)
        found = written(firsts.join(open_, "id").select(F.explode("keys").alias("key"), "id", "component"), "keys")
        discard(sets)
        return found

    # 3. stars
    buckets = classes.select(F.col("node").alias("id"), F.explode("bands").alias("key"))
    centres = buckets.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last").select("key", "centre")
    points = written(buckets.join(centres, "key").where("id <> centre"), "points")
    links = confirmed(stars(points))
    first = written(components(links), "first")
    discard(links)

    # 4. what the stars leave open
    component = F.coalesce("component", "id").alias("component")
    at = points.select("key", "id").join(first, "id", "left").select("key", "id", component)
    several = at.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    open_ = written(at.join(several, "key", "left_semi").select("id", "component").distinct(), "open")
    discard(points)
    by_shingle = keyed_by_shingles(open_)
    shared = written(parted(by_shingle, "key", "component", once=True), "shared")
    discard(open_, by_shingle)
    placed = written(shared.select("id", "component").distinct(), "placed")

    def between(links: DataFrame) -> DataFrame:
        """Edges of components for the rows (a, b) of ``links`` between classes of ``placed``."""
        one = links.join(placed.toDF("a", "one"), "a")
        return one.join(placed.toDF("b", "other"), "b").select(F.col("one").alias("a"), F.col("other").alias("b")).where("a <> b").distinct()

    alike = written(between(stars(shared.where("id <> centre"))), "alike")
    near = written(components(alike), "near").toDF("component", "family")
    left = shared.drop("centre").join(near, "component", "left").select("key", "id", F.coalesce("family", "component").alias("component"))
    left = written(parted(left, "key", "component", once=True).join(brief, "id"), "left")
    more = in_blocks(left, "key", ["sketch"], lambda part, apart: _alike(part, apart, percent))
    alike_more = written(alike.union(between(more)), "alike")
    discard(shared, left, more, alike)
    found = first
    if not alike_more.isEmpty():
        grown = written(components(alike_more), "grown").toDF("component", "family")
        members = written(parted(placed.join(grown, "component"), "family", "component"), "members")
        links = confirmed(stars(members.where("id <> centre")))
        second = written(components(between(links)), "second").toDF("component", "joined")
        rest = members.select("family", "id", "component").join(second, "component", "left").select("family", "id", F.coalesce("joined", "component").alias("component"))
        rest = parted(rest, "family", "component").drop("centre")
        rest = rest.join(texts_of(rest.select("id")), "id").join(classes.select(F.col("node").alias("id"), "n"), "id")
        rest = written(rest, "rest")
        last = in_blocks(rest, "family", ["text"], lambda part, apart: _similar(part, apart, percent, width))
        joined = components(between(links.union(last))).toDF("component", "joined")
        found = first.join(joined, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
        lone = placed.join(first, "id", "left_anti").join(joined, "component").select("id", F.col("joined").alias("component"))
        found = written(found.union(lone), "found")
        discard(members, links, rest, last)
    discard(alike_more, placed)

    heads = found.join(classes.select("node", "row"), F.col("id") == F.col("node")).groupBy("component").agg(F.min("row").alias("head"))
    linked = written(found.join(heads, "component").select(F.col("id").alias("node"), "head"), "linked")
    discard(first)
    class_of = classes.join(linked, "node", "left").select("print", F.coalesce("head", "row").alias("head"))
    named = rows.select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.col("print")).alias("print")).join(class_of, "print", "left")
    found = named.select("id", "mark", "n", F.coalesce("head.id", "id").alias("component_id"), F.coalesce("head.mark", "mark").alias("head_mark"))
    return found, [rows, classes, linked]


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Documents are linked whose sets of ``width``-word shingles have ``100 * common >= percent * union``;
    ``component_id`` is the least id that links reach, ``kept`` whether that is the row's own.
    """
    found, _ = grouped(docs, percent, width, id_col, text_col)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, that with the least id.

    Rows without an id or without words stay. Rows that share an id but are not near copies stay too; of rows
    that share id and text one stays.
    """
    found, tables = grouped(docs, percent, width, id_col, text_col)
    found = written(found.where("id IS NOT NULL AND n > 0"), "groups")
    discard(*tables)
    key = ["_id", "_mark"] if not {"_id", "_mark"} & {*docs.columns} else [f"_{x}_{'_'.join(docs.columns)}" for x in ("id", "mark")]
    own = docs.withColumns({key[0]: F.col(f"`{id_col}`").cast("long"), key[1]: F.xxhash64(f"`{text_col}`")})
    gone = found.where("id <> component_id OR mark <> head_mark").select("id", "mark").distinct().toDF(*key)
    again = found.groupBy("id", "mark").count().where("count > 1").select("id", "mark").toDF(*key)
    left = own.join(gone, key, "left_anti")
    once = left.join(again, key, "left_anti").union(left.join(again, key, "left_semi").dropDuplicates(key))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def _likely(stars: DataFrame, percent: int) -> DataFrame:
    """Stars whose sizes allow a link and whose sketches agree on enough bins."""

    def agree(n_a: pd.Series, n_b: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
        same = (_stacked(one) == _stacked(other)).sum(axis=1)
        return pd.Series(same >= _least_agreeing(percent, np.minimum(n_a, n_b)), dtype=bool)

    alike = F.pandas_udf(agree, "boolean")
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return stars.where(sized).where(alike("n_a", "n_b", "sketch_a", "sketch_b"))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BINS)


def _alike(part: pd.DataFrame, apart: np.ndarray, percent: int) -> np.ndarray:
    sketch, n = _stacked(part.sketch), part.n.to_numpy()
    links = np.zeros_like(apart)
    for i in range(len(part)):
        j = np.flatnonzero(apart[i] & _enough(n, n[i], percent))
        links[i, j] = (sketch[j] == sketch[i]).sum(axis=1) >= _least_agreeing(percent, np.minimum(n[j], n[i]))
    return links


def _similar(part: pd.DataFrame, apart: np.ndarray, percent: int, width: int) -> np.ndarray:
    sets = [shingle_set(text, width) for text in part.text]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(vocabulary), np.int32)
    links = np.zeros_like(apart)
    for i in np.flatnonzero(apart.any(axis=1)):
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        links[i] = apart[i] & _linked(common, sizes[i], sizes, percent)
    return links
