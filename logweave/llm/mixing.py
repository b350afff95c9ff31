"""Mixing sources to target weights by balanced sampling (the cube method).

Sources get targets in proportion to weights, capped at a multiple of their size. A source whose target
is r times its size takes every document floor(r) times and once more with probability r - floor(r).
These probabilities are moved through the null space of the constraints (the number of documents and the
number of words stay what they are) until nearly all are 0 or 1. That is done in blocks of a few hundred
documents, each of which leaves two undecided; what blocks leave is moved on in blocks again, level by
level, until a source has a single block, whose last few documents are landed on the rounding nearest to the
totals. No block, so no source, however large, is more than one task's share.

Sources may be many: their sizes, targets and numbers of blocks stay in tables with a row for each, and
the driver sees sums over these only. Rows with equal id, text and source are one unit with a count, so a hot
group of them is one row of a block; texts take no part in the sampling and are joined with its outcome.

Defined cases: a null text has size 0; a null source is a source of its own, which sorts last; documents
of size 0 are sampled like others and add no words; repeated rows are sampled each; an empty table gives
an empty result; columns are carried as they are, whatever their names, in a struct of their own; reruns
agree, as order, blocks and random numbers depend on hashes of the rows only.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import written

#: Documents of a block, about.
BLOCK = 1000
#: Documents that the last block of a source leaves to the landing phase, besides what the flight leaves.
LAND = 12
WORD = r"[^\x20\x09-\x0D]+"
CLOSE = 1e-9


def fly(p: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """The flight phase: at most two of the probabilities stay fractional; their sum and the sum of
    ``size * p`` stay as they are."""
    p = p.copy()
    window: list[int] = []
    for i in np.flatnonzero((p > CLOSE) & (p < 1 - CLOSE)):
        window.append(int(i))
        if len(window) < 3:
            continue
        x, y, z = (float(size[k]) for k in window)
        way = (z - y, x - z, y - x)  # orthogonal to (1, 1, 1) and to the sizes
        if not any(way):
            way = (1.0, -1.0, 0.0)
        forth = min((1 - p[k]) / w if w > 0 else p[k] / -w for k, w in zip(window, way, strict=True) if w)
        back = min(p[k] / w if w > 0 else (1 - p[k]) / -w for k, w in zip(window, way, strict=True) if w)
        step = forth if rng.random() * (forth + back) < back else -back
        for k, w in zip(window, way, strict=True):
            p[k] += step * w
            if p[k] <= CLOSE:
                p[k] = 0.0
            elif p[k] >= 1 - CLOSE:
                p[k] = 1.0
        window = [k for k in window if 0 < p[k] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """The landing phase of a source's last block: fly all but LAND documents, then take, of all roundings
    of the few that are fractional, the one whose words and number of documents miss their totals least."""
    open_ = np.flatnonzero((p > CLOSE) & (p < 1 - CLOSE))
    out = p.copy()
    first = open_[: max(0, len(open_) - LAND)]
    out[first] = fly(p[first], size[first], rng)
    open_ = np.flatnonzero((out > CLOSE) & (out < 1 - CLOSE))
    if len(open_):
        choices = np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_)) & 1
        words = np.abs((choices - out[open_]) @ size[open_])
        documents = np.abs((choices - out[open_]).sum(axis=1))
        out[open_] = choices[np.argmin(words / max(1.0, size[open_].mean()) + np.maximum(0, documents - 1))]
    return out


def _exact(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: Fraction, most: int) -> DataFrame:
    """``sizes`` (source, size, n), a row for each source, with ``target`` (words to take), ``whole`` and ``p``: how
    often each of its documents is taken for sure, and with which probability once more.

    Targets go by weight, sources in order of their code points and null last; none is above ``most`` times its
    size, the excess is shared again. A round needs two sums over the sources; what is full stays so,
    as the share of a unit of weight grows from round to round.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("string"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    table = written(sizes.withColumn("weight", weight), "sources")
    size, weight = F.col("size").cast("decimal(20,0)"), F.col("weight").cast("decimal(10,0)")
    total = table.agg(F.sum("size")).first()[0] or 0
    full, n_full = F.lit(False), 0
    while True:
        row = table.agg(F.sum(F.when(full, F.col("size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        left, open_, n = share.numerator * total - share.denominator * most * (row[0] or 0), share.denominator * (row[1] or 0), row[2]
        if n == n_full and n or not open_:
            break
        full, n_full = _exact(left) * weight > _exact(open_ * most) * size, n
        if not table.where(full).limit(1).count():
            break
    words = _exact(left) * weight
    sure = F.when(full, F.lit(most)).when(F.col("size") > 0, F.call_function("div", words, _exact(max(1, open_)) * size).cast("int")).otherwise(0)
    target = F.when(full, most * F.col("size").cast("double")).otherwise(words.cast("double") / F.lit(float(max(1, open_))))
    found = table.withColumns({"target": target, "whole": sure})
    rest = words - F.col("whole") * _exact(max(1, open_)) * size
    return found.withColumn("p", F.when(full | (F.col("size") == 0), 0.0).otherwise(rest.cast("double") / (F.lit(float(max(1, open_))) * F.col("size"))))


def sample(units: DataFrame, weights: Sequence[int], share: Fraction, most: int, seed: int) -> DataFrame:
    """``units`` (h1, h2, source, size, m), distinct documents of which there are m, with ``source_size``, ``target``
    and how often they are taken: each ``whole`` times, and ``extra`` of the m once more."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.count("*").alias("n"))
    sources = source_targets(sizes, weights, share, most)
    of = sources.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "whole", F.col("p").alias("rate"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    of = written(of, "targets")
    rows = units.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sure = F.floor(F.col("rate") * F.col("m"))
    rows = rows.withColumns({"sure": sure, "p": F.col("rate") * F.col("m") - sure}).drop("rate")
    fixed = [*units.columns, "source_size", "target", "whole", "sure", "p"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*fixed).schema)

    def level(rows: DataFrame, number: int, last: bool) -> DataFrame:
        def settle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["h1", "h2"], kind="stable", ignore_index=True)
            rng = random.Random(f"{seed} {number} {key[1]} {int(part.h1[0])}")
            part["p"] = (land if last else fly)(part.p.to_numpy(dtype=float), part["size"].to_numpy().astype(float), rng)
            return part[fixed]

        return rows.withColumn("block", F.pmod(F.xxhash64("h1", F.lit(number)), F.col("blocks"))).groupBy("source", "block").applyInPandas(settle, schema)

    number = 0
    single = (of.agg(F.max("blocks")).first()[0] or 0) <= 1
    done = written(level(rows, number, last=single), "mix")
    parts = []
    while not single:
        parts.append(done.where(f"p <= {CLOSE} OR p >= 1 - {CLOSE}"))
        rest = done.where(f"p > {CLOSE} AND p < 1 - {CLOSE}")
        counts = written(rest.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "counts")
        single = (counts.agg(F.max("blocks")).first()[0] or 0) <= 1
        number += 1
        done = written(level(rest.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of"), number, last=single), "mix")
    for part in parts:
        done = done.union(part)
    return done.select("h1", "h2", "m", "size", "source_size", "target", "whole", (F.col("sure") + F.round("p").cast("long")).alias("extra"))


def mix(docs: DataFrame, carry: list[str], source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 7) -> DataFrame:
    """``row``, a struct of the columns ``carry``, of every row of ``docs``, and ``mix``, a struct of its ``size``,
    ``source_size``, ``target`` (its source's) and ``copies``."""
    own = [F.col(f"`{c}`") for c in sorted({*docs.columns} & {"doc_id", text_col, source_col})]
    keys = [F.xxhash64(*own, F.lit(seed)).alias("h1"), F.xxhash64(F.lit(seed), *own).alias("h2")]
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select(*keys, F.col(f"`{source_col}`").alias("source"), size.alias("size")).groupBy("h1", "h2", "source", "size").agg(F.count("*").alias("m"))
    taken = sample(written(units, "units"), weights, share, most, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    joined = docs.select(row, *keys).join(taken, ["h1", "h2"])
    one = joined.where("m = 1").withColumn("copies", F.col("whole") + F.col("extra"))
    several = numbered(written(joined.where("m > 1").withColumn("part", F.spark_partition_id()), "several"), ["h1", "h2"])
    several = several.withColumn("copies", F.col("whole") + (F.col("number") <= F.col("extra")).cast("long"))
    out = F.struct("size", "source_size", "target", F.col("copies").cast("int").alias("copies")).alias("mix")
    return one.select("row", out).union(several.select("row", out))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``number``, from 1 for each key: parts number their own rows of a key and add how many the
    parts before them have, so no task holds more of a key than its part."""
    counts = rows.groupBy(*keys, "part").count()
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("size")))
    return inside.join(base, [*keys, "part"]).withColumn("number", F.col("base") + F.col("inside"))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    mixed = mix(docs, docs.columns, **options)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies")))).select("row.*")
