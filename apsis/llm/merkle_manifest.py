"""Merkle manifest of a dataset: one tree for each value of a column, and one over their roots.

Only every few levels of a tree are written (checkpoints). Proofs recompute the levels between: an aligned subtree of stored
nodes is one row of fanout ** every digests, from which the missing nodes above them are made, the siblings of each stored
node are emitted, and the made nodes are dropped with the row. What stands above a subtree is handed down once for all of it.

Cases: nulls are leaves' "-" marks and, in the column of trees, a tree of their own that comes first; empty and very long texts
are hashed like others; rows that tie in the order follow by digest, so repeated rows change nothing but each other's place;
an empty table has no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ordering import numbered

FANOUT, EVERY = 8, 2
#: Siblings of a node on each level up to the root: those before it and those after it in its run.
PATH = "array<struct<left: array<string>, right: array<string>>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of fields: "-" where null, else the number of UTF-8 bytes, a colon and the value."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*shown), 256)


@dataclass(frozen=True)
class Forest:
    """Stored levels 0, every, 2 * every and so on: rows (tree, depth, position, digest); level 0 also has what leaves carry.
    The last one has one node of each tree, its root."""

    levels: list[DataFrame]
    fanout: int
    every: int
    carried: tuple[str, ...]

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "digest")


def _depth(size: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree."""
    out, reach = F.lit(0), 1
    while reach < 1 << 62:
        out, reach = out + (size > reach).cast("int"), reach * fanout
    return out


def _subtrees(level: DataFrame, at: int, fanout: int, every: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Aligned subtrees of the stored level `at`: tree, depth, subtree, members (in order), and _0 .. _every, the digests of the
    stored level and of the regenerated ones above it. A tree that ends lower keeps its root on the levels beyond."""
    members = F.array_sort(F.collect_list(F.struct("position", "digest", *carried))).alias("members")
    rows = level.groupBy("tree", "depth", F.expr(f"position div {fanout**every}").alias("subtree")).agg(members).withColumn("_0", F.col("members.digest"))
    for k in range(1, every + 1):
        below = F.col(f"_{k - 1}")
        runs = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(_{k - 1}) - 1) div {fanout} as int)")), lambda i: F.sha2(F.array_join(F.slice(below, i * fanout + 1, fanout), ""), 256))
        rows = rows.withColumn(f"_{k}", F.when(F.col("depth") >= at + k, runs).otherwise(below))
    return rows


def grow(leaves: DataFrame, tree: str, order: list[str], carried: tuple[str, ...] = (), fanout: int = FANOUT, every: int = EVERY) -> Forest:
    """One tree for each value of `tree` over rows with a digest, in the given order (ties: by digest)."""
    named = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(order)], "digest", *carried)
    placed = numbered(named, [*[f"_by{k}" for k in range(len(order))], "digest"], "tree")
    levels = [placed.select("tree", _depth(F.col("_size"), fanout).alias("depth"), F.col("_position").alias("position"), "digest", *carried)]
    deepest = levels[0].agg(F.max("depth")).first()[0] or 0
    for at in range(0, deepest, every):
        above = _subtrees(levels[-1], at, fanout, every).select("tree", "depth", F.col("subtree").alias("position"), F.col(f"_{every}")[0].alias("digest"))
        levels.append(materialize(above, f"merkle-{at + every}"))
    return Forest(levels, fanout, every, carried)


def _descend(forest: Forest, above: DataFrame, handed: list[str]) -> DataFrame:
    """Leaves (tree, digest, carried columns) with path and the handed columns. above: tree, path, handed, for each root."""
    known = forest.levels[-1].select("tree", "position", *([] if len(forest.levels) > 1 else ["digest", *forest.carried])).join(above, "tree")
    for k in range(len(forest.levels) - 2, -1, -1):
        at, fanout, carried = k * forest.every, forest.fanout, forest.carried if k == 0 else ()
        rows = _subtrees(forest.levels[k], at, fanout, forest.every, carried).join(known.withColumnRenamed("position", "subtree"), ["tree", "subtree"])

        def step(m: Column, i: Column) -> Column:  # noqa: B023  called at once
            parts, digit = [], i
            for j in range(forest.every):
                nodes, place = F.col(f"_{j}"), F.pmod(digit, F.lit(fanout))
                beside = F.struct(F.slice(nodes, digit - place + 1, place).alias("left"), F.slice(nodes, digit + 2, F.lit(fanout - 1) - place).alias("right"))
                parts.append(F.when(F.col("depth") > at + j, F.array(beside)).otherwise(F.array().cast(PATH)))
                digit = F.floor(digit / fanout).cast("int")
            return F.struct(m["position"].alias("position"), *([m["digest"].alias("digest")] if at == 0 else []), *[m[c].alias(c) for c in carried], F.concat(*parts, F.col("path")).alias("path"))

        made = rows.select("tree", *handed, F.inline(F.transform("members", step)))
        known = made if k == 0 else materialize(made, f"merkle-paths-{at}")
    return known


def manifest(rows: DataFrame, tree: str, order: list[str], carried: tuple[str, ...] = (), fanout: int = FANOUT, every: int = EVERY) -> tuple[Forest, Forest]:
    """(the trees of the rows, the tree over their roots in the order of `tree`: null first, then by UTF-8 bytes). rows have a
    digest; every tree and level is written but those between the checkpoints."""
    forest = grow(rows, tree, order, carried, fanout, every)
    roots = forest.roots.select(F.lit("all").alias("_one"), F.col("tree").alias("of"), "digest")
    return forest, grow(roots, "_one", ["of"], ("of",), fanout, every)


def proofs(made: tuple[Forest, Forest]) -> DataFrame:
    """Every leaf with its digest and carried columns, path (to the root over all trees), subroot and root."""
    forest, top = made
    ends = top.roots.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = _descend(top, ends, ["root"]).select(F.col("of").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
    return _descend(forest, above, ["subroot", "root"]).select("digest", *forest.carried, "path", "subroot", "root")


def siblings(path: Column) -> Column:
    """All siblings of a path, in order, joined."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.concat(s["left"], s["right"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(F.array_join(s["left"], ""), node, F.array_join(s["right"], "")), 256))
