"""Merkle manifest of a dataset, with a proof for every row, by cogrouped subtree exchange.

Every row is a leaf; the leaves of a tree (here: of a language) are ordered by
id, and runs of two nodes become their digest until one is left, the subroot.
The subroots, ordered by name, form a tree of their own up to the root.

1. *Numbers.*  Leaves are range-partitioned in order and numbered by place and
   the counts of the ranges before, so no tree, however large, meets in a task.
2. *Up.*  2^``height`` consecutive leaves are a superblock, an aligned subtree.
   Each is reduced in a task of its own; its top is a node of the next stage,
   where superblocks are formed again, until every tree has one node.
3. *Down.*  Every node of a stage carries the siblings inside its superblock;
   joined with those of its parent from above they are the *outer* nodes that a
   superblock of leaves lacks on its way to the root.
4. *Exchange.*  Leaves and outer nodes are cogrouped by superblock in
   ``applyInPandas``, which finishes the local reduction, joins local and outer
   siblings to each leaf's proof and folds the leaf as found now to a root.

A leaf that changed folds to another root than the manifest's; so ``verify``
and the query tell which rows were tampered with.

Edge cases: a null value is ``-``, an empty one ``0:``; null ids come first; rows
that share an id are ordered by their leaves and count each; a tree of one leaf
is its own subroot and its proof lacks local siblings; the proof of the only row
of all is the digest of nothing; a null tree name is a tree and comes first;
very long texts are digested by Spark, only digests travel; an empty table
gives no rows; further columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.llm.common import materialize

#: Levels of a superblock: 4,096 leaves, some 0.5 MB of digests.
HEIGHT = 12
#: Rows of a range when leaves are numbered.
RANGE_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_SIBLINGS = "array<struct<level:int,digest:string,right:boolean>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def tree_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The given number of levels above some consecutive nodes, these first."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([digest(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def siblings_of(levels: list[list[str]], place: int) -> list[tuple[int, str, bool]]:
    """``(level, digest, right)`` of the siblings of a node on its way up; a node alone in its run has none."""
    out = []
    for k, nodes in enumerate(levels[:-1]):
        other = place ^ 1
        if other < len(nodes):
            out.append((k, nodes[other], other > place))
        place >>= 1
    return out


def fold(leaf: str, siblings: list[tuple[int, str, bool]], levels: int) -> str:
    """The digest ``levels`` above a node, by its siblings; ``level`` of a sibling says where it comes in."""
    at = dict((k, (d, right)) for k, d, right in siblings)
    for k in range(levels):
        if k not in at:
            leaf = digest(leaf)
        else:
            other, right = at[k]
            leaf = digest(leaf, other) if right else digest(other, leaf)
    return leaf


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a row in its tree from 0, in ``order`` (nulls first), and ``total``, the tree's rows.

    ``rows`` must be a work table.  Its own row numbers come last in the
    order, so equal rows are dealt to several ranges too.
    """
    spark = rows.sparkSession
    count = rows.count()
    ranges = max(min(spark.sparkContext.defaultParallelism, 1 + count // 10_000), -(-count // RANGE_ROWS))
    own = rows.withColumn("__row", F.monotonically_increasing_id())
    by = [tree, *order, "__row"]
    dealt = own.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    placed = materialize(dealt.drop("__row").withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "placed")
    runs = placed.groupBy(tree, "__part").agg(F.count(F.lit(1)).alias("k"), F.min("__at").alias("__from"))
    each = Window.partitionBy(tree).orderBy("__part")
    runs = runs.withColumn("__before", F.coalesce(F.sum("k").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = materialize(runs.withColumn("total", F.sum("k").over(Window.partitionBy(tree))).drop("k"), "runs")
    both = placed.alias("p").join(runs.alias("r"), F.col(f"p.{tree}").eqNullSafe(F.col(f"r.{tree}")) & (F.col("p.__part") == F.col("r.__part")))
    pos = (F.col("r.__before") + F.col("p.__at") - F.col("r.__from")).alias("pos")
    return both.select(*[F.col(f"p.{c}") for c in rows.columns], pos, F.col("r.total").alias("total"))


def _levels_left(total: Column) -> Column:
    """Levels of a tree of ``total`` leaves: the binary digits of total - 1."""
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0).cast("int")


def _stage(nodes: DataFrame, height: int) -> DataFrame:
    """Superblocks of ``(tree, pos, digest, left)``: one row each, ``tree, block, top, left, members``.

    ``members`` has the places and siblings of the nodes; ``left`` counts the levels still to go.
    """

    def reduce(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        levels = min(height, int(part["left"].iloc[0]))
        built = tree_levels(part["digest"].tolist(), levels)
        members = [{"pos": int(p), "siblings": [{"level": k, "digest": d, "right": r} for k, d, r in siblings_of(built, i)]} for i, p in enumerate(part["pos"])]
        return pd.DataFrame({"tree": [part["tree"].iloc[0]], "block": [key[1]], "top": [built[-1][0]], "left": [int(part["left"].iloc[0]) - levels], "levels": [levels], "members": [members]})

    dealt = nodes.withColumn("block", F.shiftright("pos", height))
    schema = f"tree string, block long, top string, left int, levels int, members array<struct<pos:bigint,siblings:{_SIBLINGS}>>"
    return dealt.groupBy("tree", "block").applyInPandas(reduce, schema)


def outer_nodes(tops: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``(tree, pos, outer, above, subroot)`` for nodes ``(tree, pos, digest, left)``: siblings up to the subroot.

    ``above`` counts the levels from a node to the subroot; siblings' levels count from the node.
    """
    stages = []
    nodes = materialize(tops.select("tree", "pos", "digest", "left"), "nodes")
    while nodes.where("left > 0").limit(1).count():
        stage = materialize(_stage(nodes, height), "stage")
        stages.append(stage)
        nodes = stage.select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"), "left")
    known = nodes.select("tree", "pos", F.array().cast(_SIBLINGS).alias("outer"), F.lit(0).alias("above"), F.col("digest").alias("subroot"))
    for stage in reversed(stages):
        inner = stage.select("tree", "block", "levels", F.explode("members").alias("m"))
        up = known.select("tree", F.col("pos").alias("block"), "outer", "above", "subroot")
        raised = F.transform("outer", lambda s: F.struct((s["level"] + F.col("levels")).cast("int").alias("level"), s["digest"].alias("digest"), s["right"].alias("right")))
        joined = inner.join(up, ["tree", "block"]).select(
            "tree", F.col("m.pos").alias("pos"), F.concat("m.siblings", raised).cast(_SIBLINGS).alias("outer"), (F.col("above") + F.col("levels")).cast("int").alias("above"), "subroot"
        )
        known = materialize(joined, "outer")
    return known


def _tree_name(lang: Column) -> Column:
    """A name that orders like ``lang`` with null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-"))


def manifest(leaves: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves, and one row per superblock with all that is outside it.

    ``leaves`` is a work table with ``tree``, ``doc_id`` and ``leaf``; further
    columns stay.  The second frame is ``tree, block, levels, outer, above,
    subroot, root``: ``above`` counts the levels from the superblock's top to
    the root.
    """
    placed = materialize(numbered(leaves, "tree", ["doc_id", "leaf"]).withColumn("left", _levels_left(F.col("total"))).withColumn("block", F.shiftright("pos", height)), "leaves")

    def top(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        levels = min(height, int(part["left"].iloc[0]))
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "pos": part["block"].iloc[:1], "digest": [tree_levels(part["leaf"].tolist(), levels)[-1][0]], "left": [int(part["left"].iloc[0]) - levels], "levels": [levels]})

    tops = materialize(placed.select("tree", "block", "pos", "leaf", "left").groupBy("tree", "block").applyInPandas(top, "tree string, pos long, digest string, left int, levels int"), "tops")
    within = outer_nodes(tops, height)
    # the subroots are the leaves of one more tree
    roots = materialize(within.where("pos = 0").select(F.lit("root").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), "subroots")
    places = materialize(numbered(roots, "tree", ["name"]).withColumn("left", _levels_left(F.col("total"))), "subroot-places")
    over = outer_nodes(places, height).select(F.col("pos").alias("place"), F.col("outer").alias("high"), F.col("above").alias("more"), F.col("subroot").alias("root"))
    high = materialize(places.select(F.col("name").alias("tree"), F.col("pos").alias("place")).join(over, "place").drop("place"), "high")
    raised = F.transform("high", lambda s: F.struct((s["level"] + F.col("above")).cast("int").alias("level"), s["digest"].alias("digest"), s["right"].alias("right")))
    outer = within.join(tops.select("tree", "pos", "levels"), ["tree", "pos"]).join(high, "tree")
    outer = outer.select("tree", F.col("pos").alias("block"), "levels", F.concat("outer", raised).cast(_SIBLINGS).alias("outer"), (F.col("above") + F.col("more")).cast("int").alias("above"), "subroot", "root")
    return placed, materialize(outer, "superblocks")


def _exchange(found: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Finishes a superblock: proofs from local and outer siblings, and the root that column ``found`` folds to."""

    def finish(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos").reset_index(drop=True)
        far: Any = outer.iloc[0]
        levels, above = int(far["levels"]), int(far["above"])
        beyond = [(int(s["level"]), s["digest"], bool(s["right"])) for s in far["outer"]]
        tail = "".join(d for _, d, _ in beyond)
        built = tree_levels(own["leaf"].tolist(), levels)
        to_root: dict[str, str] = {}
        proofs, folded = [], []
        for i, now in enumerate(own[found].tolist()):
            near = siblings_of(built, i)
            proofs.append(digest(*[d for _, d, _ in near], tail))
            top = fold(now, near, levels)
            if top not in to_root:
                to_root[top] = fold(top, beyond, above)
            folded.append(to_root[top])
        return pd.DataFrame(
            {"doc_id": own["doc_id"].astype("Int64"), "leaf": own["leaf"], "subroot": far["subroot"], "root": far["root"], "proof_sha256": proofs, "folded_root": folded, "verified": [f == far["root"] for f in folded]}
        )

    return finish


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(leaves: DataFrame, found: str = "found", height: int = HEIGHT) -> DataFrame:
    """Manifest of ``leaves`` (``tree, doc_id, leaf``), and whether the leaves in column ``found`` still fold to its root."""
    placed, outer = manifest(materialize(leaves, "leaf-digests"), height)
    left = placed.select("tree", "block", "pos", "doc_id", "leaf", found).groupBy("tree", "block")
    return left.cogroup(outer.groupBy("tree", "block")).applyInPandas(_exchange(found), _RESULT)


def document_leaves(docs: DataFrame, tampered: Column | None = None, change: tuple[str, Column] | None = None) -> DataFrame:
    """``tree, doc_id, leaf, found`` of documents.

    ``found`` is the leaf as it is now: where ``tampered`` holds, with the
    column and value of ``change``.
    """
    values = {c: F.col(c) for c in FIELDS}
    leaf = leaf_of(*values.values())
    if tampered is None or change is None:
        found = leaf
    else:
        name, value = change
        found = F.when(tampered, leaf_of(*(values | {name: value}).values())).otherwise(F.col("leaf"))
    kept = docs.select(*FIELDS).withColumn("leaf", leaf)
    return kept.select(_tree_name(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", found.alias("found"))
