"""Quality scores by gradient-boosted trees over document statistics, and quality rules on top of them.

Trees are fitted on the driver to a bounded sample of labelled documents, chosen by a hash of the id;
statistics are counted by Spark tasks over whole texts, and scores follow in the same pass.

Defined cases: a null text counts as empty and gets a score like any text; labels that are null or not 0
or 1, and labels without a document, are left out; repeated rows count each time; without labels, or
with a single class, the score is the share of label 1, or 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import trees
from logweave.llm.common import map_columns
from logweave.llm.docstats import NAMES, Counts

#: Labelled documents to fit the trees to, about.
SAMPLE = 12_000
#: Features by which a document never gets better (-1) or worse (1), for the rules.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "shout_share": -1, "upper_share": -1, "distinct_share": 1}


def labelled_features(docs: DataFrame, labels: DataFrame, label_col: str, where: Column | None, sample: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``sample`` labelled documents, and twice as many rows at most.

    The bound makes the join side small; documents that share a labelled id cannot pass it, as only the
    rows with the smallest hashes reach the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    if where is not None:
        known = known.where(where)
    known = known.groupBy("id").agg((2 * F.sum("y") > F.count("y")).cast("int").alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003)
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("place")).join(F.broadcast(known), "id")

    def count(places: pa.Array, labels: pa.Array, texts: pa.Array) -> list[pa.Array]:
        return [places, labels, pa.array([Counts(text).features() for text in texts.to_pylist()], pa.list_(pa.float64()))]

    rows = map_columns(picked, ["place", "y", "text"], "place long, y int, x array<double>", count).orderBy("place", "y").limit(2 * sample).toPandas()
    if not len(rows):
        return np.zeros((0, len(NAMES))), np.zeros(0)
    return np.stack(rows.x.to_list()), rows.y.to_numpy(float)


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", where: Column | None = None, sample: int = SAMPLE, monotone: dict[str, int] | None = None) -> trees.Forest:
    x, y = labelled_features(docs, labels, label_col, where, sample)
    return trees.fit(x, y, monotone={NAMES.index(name): sign for name, sign in (monotone or {}).items()})


def scored(docs: DataFrame, forest: trees.Forest, schema: str, of: Callable[[Counts], list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the columns of ``schema`` that ``of`` counts, and ``score``, of every document."""

    def score(keys: pa.Array, texts: pa.Array) -> list[pa.Array]:
        counts = [Counts(text) for text in texts.to_pylist()]
        scores = forest.predict(np.array([x.features() for x in counts]))
        own = [pa.array(column, pa.int64()) for column in zip(*map(of, counts), strict=True)]
        return [keys, *own, pa.array(scores, pa.float64())]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"`{id_col}` {kind}, {schema + ', ' if schema else ''}score double", score)


def quality_scores(docs: DataFrame, forest: trees.Forest) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    return scored(docs, forest, "", lambda counts: [])


def quality_rules(docs: DataFrame, forest: trees.Forest, least_words: int = 20, repeat_percent: int = 30, least: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, ``score`` and ``kept`` of every document: the base rules fail texts that are
    short or repeat themselves; of the rest, those are kept whose score is at least ``least``."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = scored(docs, forest, ", ".join(f"{n} long" for n in names), lambda counts: [getattr(counts, n) for n in names])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
