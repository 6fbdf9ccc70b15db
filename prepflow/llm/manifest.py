"""Merkle manifest of a table: checkpoint and recompute.

Every row is a leaf.  The rows of one tree (a language) ascend by their order
column; while more than one node remains, every ``fanout`` consecutive nodes (the
last run may be shorter, even one node) become the hash of their digests.  What
remains is the tree's subroot, and the subroots, ordered by tree, are the leaves of
one more tree, whose top is the root.

Only the leaves and every ``keep_every``-th level above them are written
(checkpoints).  A stored node is the top of an aligned subtree of ``fanout **
keep_every`` stored descendants.  Building goes upwards, one aggregation per stored
level: a group holds one aligned subtree, hashes the levels in between and keeps
the top alone.  Proofs go downwards: a group gets its subtree and the path of its
top, regenerates the missing levels, gives each of its descendants the siblings on
its way, and discards the levels again.  So no group is larger than one subtree,
however many rows a tree has, and a lost executor costs the subtrees of its tasks.

Places in a tree come from range partitions in order and the counts of rows per
partition and tree, so a tree that holds most of the rows is ranked by many tasks.

Defined results: NULL values hash as ``-``; a NULL tree value is a tree of its own,
before all others; rows with a NULL order value come first in their tree; rows that
share the order value ascend by leaf digest (rows alike in all hashed columns have
equal leaves, and each is a leaf of its own); very long texts are hashed whole;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import frozen, small_side

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_BITS = 33  # of monotonically_increasing_id, below the partition


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if NULL, else its number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The top that follows from a leaf and its path (``before`` and ``after`` of each run, upwards)."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]), 256))


def path_digest(path: Column) -> Column:
    """Hash of all siblings on a path, upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def _placed(leaves: DataFrame) -> DataFrame:
    """``tree, n, place`` and the other columns: places of the rows of each tree, in order, and their number."""
    order = ["tree", F.col("key").asc_nulls_first(), "node"]
    at = F.monotonically_increasing_id()
    rows = frozen(leaves.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("part", F.shiftright(at, ROW_BITS))
                  .withColumn("row", at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
    counts = rows.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = frozen(counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                                  F.sum("rows").over(tree).alias("n")))
    return (rows.join(small_side(counts, counts.count()), ["tree", "part"])
            .withColumn("place", F.col("row") + F.col("shift")).drop("part", "row", "shift"))


class Levels:
    """Expressions over one aligned subtree: arrays of digests of its levels, and paths through them."""

    def __init__(self, fanout: int, keep_every: int):
        self.fanout, self.keep_every, self.span = fanout, keep_every, fanout ** keep_every

    def height(self, n: Column) -> Column:
        """Levels above stored nodes, ``n`` of them in the tree, up to the next stored level or the top."""
        out = F.lit(self.keep_every)
        for level in reversed(range(self.keep_every)):
            out = F.when(n <= self.fanout ** level, F.lit(level)).otherwise(out)
        return out

    def _runs(self, nodes: Column, last: Column) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), last),
                           lambda r: F.slice(nodes, (r * self.fanout + 1).cast("int"), self.fanout))

    def grouped(self, nodes: DataFrame, *payload: str) -> DataFrame:
        """A row per subtree: its nodes in order and the digests of every level, as ``runs`` of each level."""
        member = F.struct("place", "node", *payload)
        subtrees = nodes.groupBy("tree", F.expr(f"place div {self.span}").alias("block")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
        subtrees = subtrees.withColumn("height", self.height(F.col("n")))
        level = F.transform("members", lambda m: m["node"])
        for i in range(self.keep_every):
            last = F.expr(f"(size({f'level{i - 1}' if i else 'members'}) - 1) div {self.fanout}")
            source = F.col(f"level{i - 1}") if i else level
            runs = self._runs(source, last)
            subtrees = subtrees.withColumn(f"runs{i}", F.when(F.col("height") > i, runs))
            subtrees = subtrees.withColumn(f"level{i}", F.coalesce(
                F.transform(f"runs{i}", lambda run: F.sha2(F.array_join(run, ""), 256)), source))
        return subtrees

    def tops(self, nodes: DataFrame) -> DataFrame:
        """The next stored level."""
        top = F.col(f"level{self.keep_every - 1}")
        return self.grouped(nodes).select("tree", F.expr(f"(n + {self.span - 1}) div {self.span}").alias("n"),
                                          F.col("block").alias("place"), F.get(top, F.lit(0)).alias("node"))

    def path(self, slot: Column) -> Column:
        """The runs that node ``slot`` of a subtree meets, without itself, upwards."""
        steps, own = [], slot
        for i in range(self.keep_every):
            run = F.get(F.col(f"runs{i}"), F.floor(own / self.fanout).cast("int"))
            at = (own % self.fanout).cast("int")
            steps.append(F.when(F.col("height") > i, F.struct(
                F.array_join(F.slice(run, 1, at), "").alias("before"),
                F.array_join(F.slice(run, at + 2, self.fanout), "").alias("after"))))
            own = F.floor(own / self.fanout)
        return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _proved(nodes: DataFrame, top: DataFrame | None, levels: Levels, *payload: str) -> DataFrame:
    """``tree, node, subroot, path, root`` and the payload of placed nodes; ``top`` has path and root of each subroot.

    Without ``top``, paths end at the subroots and root is the subroot.
    """
    stored, n = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while n > 1:
        stored.append(frozen(levels.tops(stored[-1])))
        n = -(-n // levels.span)
    above = stored[-1].select("tree", "place", F.col("node").alias("subroot"))
    if top is None:
        above = above.withColumn("path_above", F.array().cast("array<struct<before:string,after:string>>")).withColumn(
            "root", F.col("subroot"))
    else:
        above = above.join(top(above.select("tree", F.col("subroot").alias("node"))), "tree")
    if len(stored) == 1:  # every tree is one leaf
        return nodes.join(above.drop("place"), "tree").withColumnRenamed("path_above", "path")
    for i in range(len(stored) - 2, -1, -1):
        extra = payload if i == 0 else ()
        subtrees = levels.grouped(stored[i], *extra).join(above.withColumnRenamed("place", "block"), ["tree", "block"])
        members = F.transform("members", lambda m, s: F.struct(
            m["place"].alias("place"), m["node"].alias("node"), *(m[p].alias(p) for p in extra),
            F.concat(levels.path(s), F.col("path_above")).alias("path")))
        below = subtrees.select("tree", "subroot", "root", F.inline(members))
        above = below if i == 0 else below.select("tree", "place", "subroot", F.col("path").alias("path_above"), "root")
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree_col: str = "lang", key_col: str = "doc_id",
             fanout: int = 8, keep_every: int = 3, payload: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``key``, ``leaf``, ``subroot``, ``root``, ``path`` and the ``payload`` expressions over ``docs``.

    ``path`` lists, upwards, the siblings before and after the row's node in each
    run, through its subroot to the root: ``fold(leaf, path)`` gives the root.
    """
    payload = payload or {}
    levels = Levels(fanout, keep_every)
    # names that start with v sort after the NULL tree and keep the bytewise order of the values
    tree = F.coalesce(F.concat(F.lit("v"), q(tree_col).cast("string")), F.lit(""))
    leaves = frozen(docs.select(tree.alias("tree"), q(key_col).alias("key"),
                                leaf_digest([q(f) for f in fields]).alias("node"),
                                *(c.alias(name) for name, c in payload.items())))

    def top(subroots: DataFrame) -> DataFrame:
        """Path and root of each tree: the tree over the subroots."""
        nodes = frozen(_placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node")))
        proved = _proved(nodes, None, levels, "key")
        return frozen(proved.select(F.col("key").alias("tree"), F.col("path").alias("path_above"), "root"))

    proved = _proved(frozen(_placed(leaves)), top, levels, "key", *payload)
    return proved.select("key", F.col("node").alias("leaf"), "subroot", "root", "path", *payload)
