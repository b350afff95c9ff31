"""How filters interact: what each of them removes in every order, alone, and on average.

Documents become cells of (part, mask of failed filters) with counts of all, good and toxic ones; nothing else
of a document matters to the audit. A Gray code then walks the 32 subsets of the filters, so that a step turns
one filter on or off: each cell has a counter of the active filters that it fails, and cells whose counter
leaves or reaches zero leave or join the running survivors. The survivors of each subset are kept, and all
that is asked about an order of filters is a difference of two of these 32 states.

Whether a text is a copy of an earlier one takes a shuffle of digests, not of texts. Rows are counted by digest, id and
labels, then by digest and labels, both before they are shuffled, so a group of copies of any size reaches a task
as a row from each map task, and the least id of a text is looked for among those few.

Defined cases: a null text is empty, and so a copy of other empty ones; without words a text fails A alone of
the filters on words; a null part is the empty one; rows that share id and text are no copies of each other, as none
has a smaller id; a row without an id is no copy, has none and has no labels; labels of an id that is there twice count if any
of them says so; long texts are used whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct ones), C (capitals), D (symbols); ``words`` are split
    from the trimmed text, so only those of an empty one are empty."""
    n = F.when(words[0] == "", 0).otherwise(F.size(words))
    distinct = F.when(words[0] == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, a bit for each filter."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"))
    own = own.withColumn("words", F.split(F.btrim("text", F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    mask = sum(((F.lit(1 << i) * failed.cast("int")) for i, failed in enumerate(failures(F.col("text"), F.col("words")))), F.lit(0))
    own = own.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("print"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = own.join(said, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    rows = known.groupBy("print", "id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    alike = rows.groupBy("print", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first, F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    found = alike.withColumn("least", F.min("first.id").over(Window.partitionBy("print")))  # a row for each part and label of a text
    originals = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - originals).alias("n")))
    each = found.select("part", "good", "toxic", F.explode(split).alias("c")).select("part", "c.mask", "c.n", "good", "toxic").where("n > 0")
    counted = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counted)


def walk(masks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The survivors of each subset of the filters, a row for each: sums of the ``counts`` of the cells that
    fail none of them."""
    failing = np.zeros(len(masks), np.int64)
    survivors = counts.sum(axis=0)
    states = np.zeros((1 << len(FILTERS), counts.shape[1]), np.int64)
    states[0] = survivors
    subset = 0
    for step in range(1, len(states)):
        toggled = step & -step
        subset ^= toggled
        hit = masks & toggled > 0
        if subset & toggled:
            survivors = survivors - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            survivors = survivors + counts[hit & (failing == 0)].sum(axis=0)
        states[subset] = survivors
    return states


def steps(part: str, states: np.ndarray) -> pd.DataFrame:
    """A row for every order of the filters and every step in it, all by differences of states."""
    rows = []
    total, every = states[0, 0], len(states) - 1
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            kept, lost = states[before | bit], states[before] - states[before | bit]
            redundant = total - states[bit, 0] - lost[0]
            unique = states[every ^ bit, 0] - states[every, 0]
            rows.append((part, "".join(FILTERS[i] for i in order), step, kept[0], lost[0], redundant, unique, lost[1], lost[2], f))
            before |= bit
    found = pd.DataFrame(rows, columns=[*(c.split()[0] for c in RESULT.split(", ")[:-1]), "filter"])
    found["shapley"] = found.groupby("filter").removed.transform("sum")
    return found.drop(columns="filter")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For every part, every order of the filters and every step in it: what is kept, removed, redundant, failed by
    nothing else, lost of good and toxic documents, and removed over all orders. A task of the walk has the cells
    of a part, 32 at most."""

    def of_part(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        return steps(key[0], walk(found["mask"].to_numpy(np.int64), found[list(COUNTS)].to_numpy(np.int64)))

    return cells(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(of_part, RESULT)
