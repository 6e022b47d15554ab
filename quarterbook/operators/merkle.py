"""Digests of builds as trees: two builds are compared from the root down, and only below nodes that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, staged

SEPARATOR = "/"


def spread(name: Column) -> tuple[Column, Column]:
    """Two levels above a name, of 256 branches each, so that no node has a number of children that grows without bound."""
    digest = F.sha2(name, 256)
    return F.substring(digest, 1, 2), F.substring(digest, 1, 4)


def by_fund(artifacts: DataFrame) -> DataFrame:
    """Leaves (path, digest) of artifacts (cik, period_end, digest): a fund's quarters below the fund."""
    return artifacts.select(F.array(*spread(F.col("cik")), "cik", F.col("period_end").cast("string")).alias("path"), "digest")


def by_quarter(artifacts: DataFrame) -> DataFrame:
    """Leaves of the same artifacts: a quarter's funds below the quarter."""
    return artifacts.select(F.array(F.col("period_end").cast("string"), *spread(F.col("cik")), "cik").alias("path"), "digest")


def tree(leaves: DataFrame, depth: int = 4) -> DataFrame:
    """level (0: the root), path (joined by a slash), digest and leaves of each node; all leaves lie at `depth`.

    A node's digest is the SHA-256 of a line for each child, in order: its name, a zero character, its digest. So it depends on nothing but the
    leaves below, whatever order they came in.
    """
    level = leaves.select("path", "digest", F.lit(1).cast("long").alias("leaves"))
    found, kept = [], []
    for n in range(depth, -1, -1):
        level = staged(level, "tree")
        kept.append(level)
        found.append(level.select(F.lit(n).alias("level"), F.array_join("path", SEPARATOR).alias("path"), "digest", "leaves"))
        if n:
            line = F.concat(F.element_at("path", -1), F.lit("\0"), "digest", F.lit("\n"))
            parent = F.slice("path", 1, n - 1).alias("path")
            level = level.groupBy(parent).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("digest"), F.sum("leaves").alias("leaves"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    whole = staged(out, "nodes")
    discard(*kept)
    return whole


def changed_leaves(before: DataFrame, after: DataFrame, depth: int = 4) -> DataFrame:
    """path and verdict ('added', 'lost' or 'changed') of leaves of two trees that differ, by a descent that leaves out equal subtrees."""
    above: DataFrame | None = None
    for n in range(depth + 1):
        sides = []
        for side, name in ((before, "_before"), (after, "_after")):
            nodes = side.where(F.col("level") == n).select("path", F.col("digest").alias(name))
            if above is not None:
                parent = F.substring_index("path", SEPARATOR, n - 1) if n > 1 else F.lit("")
                nodes = nodes.withColumn("parent", parent).join(above.select(F.col("path").alias("parent")), "parent", "left_semi").drop("parent")
            sides.append(nodes)
        differ = sides[0].join(sides[1], "path", "full").where(~F.col("_before").eqNullSafe(F.col("_after")))
        previous, above = above, staged(differ, "differ")
        if previous is not None:
            discard(previous)
    return above.select("path", F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "lost").otherwise("changed").alias("verdict"))


def losses(before: DataFrame, after: DataFrame, changed: DataFrame, level: int = 3) -> DataFrame:
    """path, leaves before and after of nodes at a level (funds, of trees by_fund) that have lost leaves; a node that is gone has none after. changed: of changed_leaves."""
    held = changed.where("verdict = 'lost'").select(F.substring_index("path", SEPARATOR, level).alias("path")).distinct()
    now = after.where(F.col("level") == level).select("path", F.col("leaves").alias("after"))
    return before.where(F.col("level") == level).select("path", F.col("leaves").alias("before")).join(held, "path").join(now, "path", "left").withColumn("after", F.coalesce("after", F.lit(0)))


def unmet(tree: DataFrame, expected: DataFrame) -> DataFrame:
    """path, fewest, leaves of named expectations (path, fewest) that a tree doesn't meet."""
    found = expected.join(tree.select("path", "leaves"), "path", "left").withColumn("leaves", F.coalesce("leaves", F.lit(0)))
    return found.where(F.col("leaves") < F.col("fewest")).select("path", "fewest", "leaves")
