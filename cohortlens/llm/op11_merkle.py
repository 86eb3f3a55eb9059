"""Merkle manifest of a dataset, with inclusion proofs made by pointer jumping.

Every row is a leaf.  Rows of one group (``group_col``) ascend by id and form a tree of
``FANOUT`` children a node; the roots of the groups, in order of the group, form the upper
tree in the same way.  The digest of a node is SHA-256 of its children's digests as
lower-case hex text; the last node of a level may have fewer children, even one.

* Places: rows are dealt out by ranges of (group, id), numbered inside their partition, and
  the counts of the (group, partition) pairs before them are added.  No group meets in one
  task, whatever its share of the rows.
* A run is the up to ``FANOUT`` children of one node.  The leaves of a run stay together in
  one row, since they share every ancestor.
* Proofs: every node starts with the segment of its siblings and a pointer to its parent.
  In each round a node appends the segment its ancestor holds and takes over the ancestor's
  pointer, so the distance doubles until all have reached the root.  Nodes of one block
  (up to 512 consecutive ones) share the ancestor at that distance, so one row a block looks
  it up and the block's nodes meet that row: the few nodes near the root, to which all
  point in the last rounds, are no hot keys.

A leaf is the digest of its fields in the stated order, each as ``-`` where it is null, else
as its UTF-8 byte count, ``:`` and its text.

Defined cases: a null group is a group of its own and comes first; null ids come first in
their group; rows of equal id ascend by their leaf, and wholly equal rows are leaves of
their own with proofs of their own; an empty text is ``0:``; an empty table has no root and no
proofs; the only row of a table is its own root, with an empty proof; texts are hashed whole,
however long; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The name of the upper tree; groups are named "" (null) or "=" and their value.
UPPER = "^"
_STEP = "struct<left:binary,right:binary>"
_NODE = ("tree", "level", "pos")
_UP = ("up_tree", "up_level", "up_pos")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields, each with its length so that none runs into the next."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return _digest(F.concat(*parts))


def fold(leaf: Column, proof: Column) -> Column:
    """The root (binary) that ``leaf`` and the siblings in ``proof`` lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: _digest(
        F.concat(as_hex(s["left"]), as_hex(acc), as_hex(s["right"]))))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (binary) of all siblings of a proof, from the leaf's level to the root's."""
    return _digest(F.array_join(F.transform(
        proof, lambda s: as_hex(F.concat(s["left"], s["right"]))), ""))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Manifest:
    """``runs``: the rows by runs of leaves (tree, pos, single, members); ``nodes``: every node
    above the leaves but the root, with pointer, siblings and, for a group's root, its own
    digest as ``sub``; ``root``: one row (none for an empty table); ``depth``: the longest way
    from a run's node to the root."""
    runs: DataFrame
    nodes: DataFrame
    root: DataFrame
    depth: int


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in their tree (from 0) and the tree's size ``n``."""
    keys = ["tree", *order]
    dealt = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_at", F.monotonically_increasing_id()), "merkle-order")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"),
                                                F.count(F.lit(1)).alias("_held"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "_part", "_first",
                           F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
                           F.sum("_held").over(tree).alias("n"))
    return dealt.join(starts.hint("merge"), ["tree", "_part"]).select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n")


def _runs(placed: DataFrame, member: list[str]) -> DataFrame:
    """One row a run: tree, pos (of the node above it), size (nodes on that level), members."""
    return placed.groupBy(
        "tree", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("size"),
        F.expr(f"pos div {FANOUT}").alias("_run"), (F.col("n") == 1).alias("single")).agg(
        F.sort_array(F.collect_list(F.struct("pos", *member))).alias("members")) \
        .withColumnRenamed("_run", "pos")


def _above(runs: DataFrame, digest: str) -> DataFrame:
    """``runs`` with the digest of the node above; a tree's only leaf is its own root."""
    return runs.withColumn("digest", F.when(F.col("single"), F.col("members")[0][digest]).otherwise(
        _digest(F.array_join(F.transform("members", lambda m: as_hex(m[digest])), ""))))


def _siblings(members: Column, at: Column, digest: str) -> Column:
    """Left and right siblings of the member at (0-based) ``at``."""
    every = F.transform(members, lambda m: m[digest])
    joined = lambda part: F.aggregate(
        part, F.lit(b""), lambda acc, d: F.concat(acc, d))
    at = at.cast("int")
    return F.struct(joined(F.slice(every, F.lit(1), at)).alias("left"),
                    joined(F.slice(every, at + 2, F.lit(FANOUT))).alias("right")).cast(_STEP)


def _grown(level: DataFrame, widest: int, first: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Levels above ``level`` (tree, pos, size, digest) until every tree has its root.

    Returns the tables of roots, of nodes below a root with their siblings, and the number
    of levels added.  ``widest`` is the size of the largest tree's ``level``.
    """
    roots, below, number = [], [], first
    while True:
        roots.append(level.where("size = 1").select("tree", F.lit(number).alias("level"), "digest"))
        if widest <= 1:
            return roots, below, number - first
        runs = stage(_above(_runs(level.where("size > 1").withColumnRenamed("size", "n"),
                                  ["digest"]), "digest"), "merkle-level")
        below.append(runs.select("tree", F.lit(number).alias("level"), F.col("pos").alias("_above"),
                                 "members", F.posexplode("members").alias("_i", "_m")).select(
            "tree", "level", F.col("_m.pos").alias("pos"), F.col("tree").alias("up_tree"),
            F.lit(number + 1).alias("up_level"), F.col("_above").alias("up_pos"),
            F.array(_siblings(F.col("members"), F.col("_i"), "digest")).alias("path"),
            F.lit(None).cast("binary").alias("sub")))
        level = runs.select("tree", "pos", "size", "digest")
        widest, number = -(-widest // FANOUT), number + 1


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
                   group_col: str = "lang", carry: tuple[str, ...] = ()) -> Manifest:
    """The trees over ``docs``; ``carry`` names further columns kept beside the leaves."""
    group = F.col(group_col).cast("string")
    rows = stage(docs.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("tree"),
        F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        F.struct(*carry, F.lit(0).alias("_")).alias("kept")).withColumn(
        "row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = _placed(rows, ["id", "leaf", "row"])
    runs = stage(_above(_runs(placed, ["id", "leaf", "kept"]), "leaf"), "merkle-runs")
    most = runs.agg(F.max("size")).first()[0] or 0
    roots, below, high = _grown(runs.select("tree", "pos", "size", "digest"), most, 1)

    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    subroots = stage(every, "merkle-subroots")
    top = _placed(subroots.select(F.lit(UPPER).alias("tree"), F.col("tree").alias("of"), "level",
                                  "digest"), ["of"])
    top = stage(_above(_runs(top, ["of", "level", "digest"]), "digest"), "merkle-top")
    most = top.agg(F.max("size")).first()[0] or 0
    upper, over, higher = _grown(top.select("tree", "pos", "size", "digest"), most, 1)
    root = upper[0]
    for more in upper[1:]:
        root = root.unionByName(more)

    # a group's root is a leaf of the upper tree: the two join here
    nodes = top.where("not single").select(
        "pos", "members", F.posexplode("members").alias("_i", "_m")).select(
        F.col("_m.of").alias("tree"), F.col("_m.level").alias("level"),
        F.lit(0).cast("long").alias("pos"), F.lit(UPPER).alias("up_tree"), F.lit(1).alias("up_level"),
        F.col("pos").alias("up_pos"),
        F.array(_siblings(F.col("members"), F.col("_i"), "digest")).alias("path"),
        F.col("_m.digest").alias("sub"))
    for more in below + over:
        nodes = nodes.unionByName(more)
    return Manifest(runs, stage(nodes, "merkle-nodes"),
                    stage(root.select(F.col("digest").alias("root")), "merkle-root"),
                    high + higher + 1)


def _jump(nodes: DataFrame, distance: int) -> DataFrame:
    """One round: from pointers at ``distance`` to twice that, segments concatenated."""
    wide = FANOUT ** min(distance, 3)  # so many consecutive nodes share that ancestor
    block = F.expr(f"pos div {wide}").alias("block")
    asked = nodes.select("tree", "level", block, *_UP).distinct()
    far = nodes.select(*[F.col(k).alias(u) for k, u in zip(_NODE, _UP, strict=True)],
                       *[F.col(u).alias(f"far_{u}") for u in _UP], F.col("path").alias("tail"),
                       F.col("sub").alias("far_sub"))
    found = stage(asked.join(far.hint("merge"), list(_UP)).drop(*_UP), "merkle-found")
    met = nodes.withColumn("block", block).join(found.hint("merge"), ["tree", "level", "block"],
                                                "left")
    return met.select(
        *_NODE, *[F.coalesce(f"far_{u}", u).alias(u) for u in _UP],
        F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", "tail")).alias("path"),
        F.coalesce("sub", "far_sub").alias("sub"))


def proofs(manifest: Manifest) -> DataFrame:
    """One row a leaf: id, leaf, subroot, root (binary), proof (left and right siblings of
    each level, from the leaf up) and the columns that were carried."""
    nodes, distance = manifest.nodes, 1
    while distance < manifest.depth:
        nodes = stage(_jump(nodes, distance), "merkle-jump")
        distance *= 2
    ways = nodes.where("level = 1").where(F.col("tree") != UPPER).select("tree", "pos", "path", "sub")
    found = manifest.runs.hint("merge").join(ways, ["tree", "pos"], "left").crossJoin(
        F.broadcast(manifest.root))  # one row
    none = F.array().cast(f"array<{_STEP}>")
    found = found.select(
        "single", "members", "root", F.coalesce("sub", "root").alias("subroot"),
        F.coalesce("path", none).alias("path"), F.posexplode("members").alias("_i", "_m"))
    own = F.when(F.col("single"), none).otherwise(
        F.array(_siblings(F.col("members"), F.col("_i"), "leaf")))
    return found.select("_m.id", "_m.leaf", "subroot", "root",
                        F.concat(own, F.col("path")).alias("proof"), "_m.kept.*").drop("_")
