"""A Merkle manifest of a dataset: a root over all rows, and for each row the proof that it belongs there.

Rows are leaves, ranked in the order of their ids within their group. The digits of a rank, in base FAN, say
where a leaf stands in the tree. Blocks of FAN ** 2 leaves are rolled up by grouping one digit column away after the
other: the children of a run become an array of structs inside the struct of their parent, which has their digest.
Once leaves are dealt to tasks by block, both groupings stay in the task. The digests of blocks are the leaves of the next tier, in
blocks again, until a group has one: so a struct never holds more than a block, however large a group is, and every tier
has FAN ** 2 times fewer rows than the one below it. The roots of the groups are rolled up in the same way.

Then paths go down. A transform over the nested structs of a block gives each child the digests left and right
of it, level by level, and an explode emits the children: within a block no proof takes a join. The paths of blocks
themselves, a row for each block, meet the blocks in a join on (group, block), 1 / FAN ** 2 of the size of the leaves; Spark
broadcasts it only below its own size bound. A proof is folded by hashing the row's digest, as it is read later, with what
stands left and right of it on each level.

Ranks come from sorted ranges and one count for each range and group, so a group of any size is many tasks.

Defined cases: null fields are a mark of their own; rows without an id come first in their group; rows that share an
id are ordered by their digests, equal rows get any of their places; rows without a group are a group, the first; a group of one
row has that leaf as its root, so does a table of one group have its root; an empty table gives an empty result;
long fields are hashed whole; columns that are no fields are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import discard, written

#: Children of a node, and of a block: two digits.
FAN = 16
BLOCK = FAN * FAN
PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """A field as it is hashed: its number of bytes and itself, or a mark for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, their place in their group by ``order``, and ``n``, the size of the group; written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    own = written(own.withColumn("at", F.monotonically_increasing_id()), "sorted")  # of consecutive rows of a range, consecutive numbers
    range_ = F.shiftright("at", 33).alias("range")
    sizes = own.groupBy(group, range_).agg(F.min("at").alias("low"), F.count("*").alias("here"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "range", "low", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy(group)).alias("n"))
    found = own.withColumn("range", range_).join(starts, [group, "range"])
    found = written(found.withColumn("i", F.col("at") - F.col("low") + F.col("before")).drop("at", "low", "before", "range"), "ranked")
    discard(own)
    return found


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def rolled(nodes: DataFrame) -> DataFrame:
    """(grp, n, block, hash, tree) of nodes (grp, n, i, hash, own): blocks, each with its children nested in it.

    Where a group has so few nodes that a level has one only, that one stands for the level, unhashed.
    """
    high = {"block": F.shiftright("i", 8), "d1": F.shiftright("i", 4).bitwiseAND(FAN - 1)}  # the last digit orders a run's children
    dealt = nodes.withColumns(high).repartition("grp", "block")
    kids = F.sort_array(F.collect_list(F.struct("i", "hash", "own"))).alias("kids")
    runs = dealt.groupBy("grp", "n", "block", "d1").agg(kids)
    above = lambda name, least: F.when(F.col("n") > least, F.sha2(_joined(F.col(f"{name}.hash")), 256)).otherwise(F.col(f"{name}.hash")[0])
    tree = F.sort_array(F.collect_list(F.struct("d1", "hash", "kids"))).alias("tree")
    blocks = runs.withColumn("hash", above("kids", 1)).groupBy("grp", "n", "block").agg(tree)
    return blocks.select("grp", "n", "block", above("tree", FAN).alias("hash"), "tree")


def rise(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of blocks over ``nodes``, written; of the last tier each group has one block."""
    tiers: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while not tiers or most > 1:
        tiers.append(written(rolled(nodes), "blocks"))
        most = -(-most // BLOCK)
        nodes = tiers[-1].select("grp", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("i"), "hash", F.struct(F.lit(0).alias("none")).alias("own"))
    return tiers


def _beside(hashes: Column, at: Column, real: Column) -> Column:
    """The step of a path past a run: what stands left and right of the child ``at``; none where the level is none."""
    step = F.struct(_joined(F.slice(hashes, F.lit(1), at)).alias("left"), _joined(F.slice(hashes, at + 2, F.lit(FAN))).alias("right"))
    return F.when(real, F.array(step)).otherwise(F.array().cast(PATH))


def emitted(blocks: DataFrame, up: DataFrame, give: Callable[[Column, Column], Column]) -> DataFrame:
    """``give`` (child, path) of every child of ``blocks``, and the columns of ``up`` (grp, block, path, ...).

    ``path`` begins inside the block and goes on with that of the block.
    """
    tree = F.transform("tree", lambda run, k: F.struct(run["kids"].alias("kids"), F.concat(_beside(F.col("tree.hash"), k, F.col("n") > FAN), F.col("path")).alias("path")))
    child = lambda run: F.transform(run["kids"], lambda c, j: give(c, F.concat(_beside(run["kids"]["hash"], j, F.col("n") > 1), run["path"])))
    joined = blocks.select("grp", "n", "block", "tree").join(up, ["grp", "block"])
    carried = [c for c in up.columns if c not in ("grp", "block", "path")]
    return joined.select("grp", "block", F.explode(F.flatten(F.transform(tree, child))).alias("child"), *carried)


def descend(tiers: list[DataFrame], up: DataFrame) -> DataFrame:
    """``up`` (grp, block, path, ...) of the last of ``tiers`` as that of the first."""
    carried = [c for c in up.columns if c not in ("grp", "block", "path")]
    for blocks in reversed(tiers[1:]):
        below = emitted(blocks, up, lambda c, path: F.struct(c["i"].alias("i"), path.alias("path")))
        up = below.select("grp", F.col("child.i").alias("block"), "child.path", *carried)
    return up


def fold(value: Column, path: Column) -> Column:
    """What the path makes of a digest: the root, if the digest is the one that the path was taken for."""
    return F.aggregate(path, value, lambda have, p: F.sha2(F.concat(p["left"], have, p["right"]), 256))


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", later: dict[str, Column] | None = None) -> DataFrame:
    """``id_col``, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``later`` has fields as they are read again, by name: the leaf that is folded is made of these. The proof is
    hashed here as the digests beside the row's own, level by level, left to right.
    """
    field = lambda name: F.col(f"`{name}`")
    again = digest([(later or {}).get(name, field(name)) for name in fields])
    grp = F.coalesce(F.concat(F.lit("s"), field(group_col).cast("string")), F.lit(""))
    leaves = written(docs.select(grp.alias("grp"), field(id_col).alias("id"), digest([*map(field, fields)]).alias("hash"), again.alias("later")), "leaves")
    rows = ranked(leaves, "grp", ["id", "hash"])
    discard(leaves)
    tiers = rise(rows.select("grp", "n", "i", "hash", F.struct("id", "later").alias("own")))
    discard(rows)
    roots = tiers[-1].select(F.lit("").alias("all"), F.col("grp").alias("name"), "hash")
    groups = rise(ranked(roots, "all", ["name"]).select(F.col("all").alias("grp"), "n", "i", "hash", F.struct("name").alias("own")))
    top = groups[-1].select("grp", "block", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    named = emitted(groups[0], descend(groups, top), lambda c, path: F.struct(c["own"]["name"].alias("name"), c["hash"].alias("hash"), path.alias("path")))
    up = named.select(F.col("child.name").alias("grp"), F.lit(0).cast("long").alias("block"), "child.path", F.col("child.hash").alias("subroot"), "root")
    up = descend(tiers, written(up, "paths"))

    def proof(c: Column, path: Column) -> Column:
        beside = _joined(F.transform(path, lambda p: F.concat(p["left"], p["right"])))
        return F.struct(c["own"]["id"].alias("id"), c["hash"].alias("leaf"), F.sha2(beside, 256).alias("proof"), fold(c["own"]["later"], path).alias("folded"))

    found = emitted(tiers[0], up, proof)
    return found.select(
        F.col("child.id").alias(id_col), "child.leaf", "subroot", "root", F.col("child.proof").alias("proof_sha256"),
        F.col("child.folded").alias("folded_root"), (F.col("child.folded") == F.col("root")).alias("verified"),
    )
