"""Ordered operators that do not put a whole source into one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 100_000, strict: bool = True) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``value`` of the same keys at a smaller ``order`` (or equal, unless ``strict``).

    A key may hold any share of the rows. Rows are therefore grouped by ranges of ``width`` of the order:
    a window looks back inside the range, and what the earlier ranges end with is carried in from a table
    that has one row for each key and range.
    """
    part = rows.withColumn("_range", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    local = part.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    ends = part.groupBy(*keys, "_range").agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_range"]]
    joined = local.alias("l").join(carried.alias("c"), same, "left")
    kept = [F.col(f"l.{c}").alias(c) for c in rows.columns]
    return joined.select(*kept, F.coalesce("l._local", "c._carried").alias(name))


def dense_index(rows: DataFrame, keys: list[str], order: str, name: str, width: int = 100_000) -> DataFrame:
    """``rows`` with ``name``: the 0-based rank by ``order`` within the keys, by counts of ranges and ranks inside them."""
    part = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = part.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    ranked = part.withColumn("_rank", F.row_number().over(inside) - 1)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_range"]]
    joined = ranked.alias("r").join(base.alias("b"), same)
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], (F.col("_base") + F.col("_rank")).cast("long").alias(name))


def sum_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same keys at a smaller ``order``, by sums of ranges
    and sums inside them."""
    part = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = part.groupBy(*keys, "_range").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_range"]]
    joined = local.alias("r").join(base.alias("b"), same)
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], (F.col("_base") + F.col("_local")).cast("long").alias(name))


def as_of(asked: DataFrame, table: DataFrame, keys: list[str], at: str, by: str, columns: list[str], width: int = 100_000) -> DataFrame:
    """``asked`` with ``columns`` of the last row of ``table`` of the same keys whose ``by`` is not beyond ``at``; null if there is none."""
    left = asked.select(*keys, F.col(at).cast("long").alias("_order"), F.lit(None).cast(table.select(F.struct(*columns)).schema[0].dataType).alias("_known"), F.struct(*asked.columns).alias("_asked"))
    right = table.select(*keys, F.col(by).cast("long").alias("_order"), F.struct(*columns).alias("_known"), F.lit(None).cast(left.schema["_asked"].dataType).alias("_asked"))
    found = last_before(left.union(right), keys, "_order", "_known", "_last", width, strict=False).where("_asked IS NOT NULL")
    return found.select("_asked.*", *[F.col(f"_last.{c}").alias(c) for c in columns])
