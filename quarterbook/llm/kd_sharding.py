"""K-d tree partitioning of documents into shards of near-equal bytes, in DataFrame operations only.

The tree starts with one node that owns all shards. On each level every node that owns more than one shard
is cut along its widest metadata dimension at the weighted quantile that matches the shards on either side
(the weighted median where their number is even), until each leaf owns one shard of the target bytes.

A cut is found from two bounded histograms: the bytes by value of the widest dimension (1024 values), then,
inside the one value in which the cut falls, the bytes by a hash of the row (4096 values). So a source that
holds a third of all rows is cut inside its own rows. Only these histograms (at most 24 nodes times 4096 rows) reach the
driver; rows stay where they are, and each level is a pass over a narrow staged table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, ranked, staged

GRID = 1024
FINE = 4096


def measured(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    """id, size, crc and one integer coordinate from 0 to GRID - 1 for each metadata dimension."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = (F.length(text) + 8).cast("long")
    # a string's place is the hash of its value; a size's place is its logarithm, 32 steps for each doubling
    coords = [F.least(F.lit(GRID - 1), F.floor(F.log2(size) * 32)).cast("int").alias("_d0")]
    coords += [F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(GRID)).cast("int").alias(f"_d{i}") for i, c in enumerate(dims, 1)]
    return docs.select(F.col(id_col), size.alias("size"), F.crc32(text).cast("long").alias("text_crc32"), *coords)


def _cuts(table: DataFrame, node, wanted: dict[int, tuple[int, int]], n_dims: int) -> dict[int, tuple[int, int, int]]:
    """node -> (dimension, value, fine): rows below (value, fine) along the dimension go left. wanted: node -> (shards left, shards)."""
    at = node.alias("node")
    names = [f"_d{i}" for i in range(n_dims)]
    spans = table.select(at, *names).where(F.col("node").isin(list(wanted))).groupBy("node").agg(*[(F.max(c) - F.min(c)).alias(c) for c in names]).collect()
    widest = {r["node"]: max(range(n_dims), key=lambda i: (r[f"_d{i}"], -i)) for r in spans}
    if not widest:
        return {}
    along = F.coalesce(*[F.when(F.col("node") == n, F.col(f"_d{d}")) for n, d in widest.items()], F.lit(0))
    rows = table.select(at, "size", "_fine", *names).where(F.col("node").isin(list(widest))).withColumn("value", along)
    totals: dict[int, int] = {}
    values: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("node", "value").agg(F.sum("size").alias("w")).collect():
        values.setdefault(r["node"], []).append((r["value"], r["w"]))
        totals[r["node"]] = totals.get(r["node"], 0) + r["w"]
    rest, at_value = {}, {}
    for n, held in values.items():
        left, shards = wanted[n]
        goal = totals[n] * left / shards
        for v, w in sorted(held):
            if goal <= w or v == max(held)[0]:
                at_value[n], rest[n] = v, goal
                break
            goal -= w
    inside = reduce(lambda a, b: a | b, [(F.col("node") == n) & (F.col("value") == v) for n, v in at_value.items()])
    fine: dict[int, list[tuple[int, int]]] = {}
    for r in rows.where(inside).groupBy("node", "_fine").agg(F.sum("size").alias("w")).collect():
        fine.setdefault(r["node"], []).append((r["_fine"], r["w"]))
    cuts = {}
    for n, held in fine.items():
        goal, at_fine = rest[n], 0
        for f, w in sorted(held):
            if goal < w / 2:
                break
            goal, at_fine = goal - w, f + 1
        cuts[n] = (widest[n], at_value[n], at_fine)
    return cuts


def kd_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in the shard) of every row.

    Size is the text's UTF-8 bytes plus 8. Null text counts as empty; null metadata is a value of its own;
    repeated rows each get their slot; an empty table gives no rows; further columns are left out. Rows that are
    equal in every measure (repeated rows) stand in any order among themselves.
    """
    # the hash in which a cut inside one value falls; it holds the row's number, so that repeated rows can be parted too
    fine = F.pmod(F.xxhash64(F.lit("fine"), F.col(id_col), F.col("text_crc32"), F.monotonically_increasing_id()), F.lit(FINE)).cast("int").alias("_fine")
    table = staged(measured(docs, id_col, text_col, list(dims)).select("*", fine), "kd")
    n_dims = 1 + len(dims)
    node = F.lit(0)
    owned = {0: (0, shards)}  # node -> first shard, number of shards
    while any(k > 1 for _, k in owned.values()):
        wanted = {n: (k // 2, k) for n, (_, k) in owned.items() if k > 1}
        cuts = _cuts(table, node, wanted, n_dims)
        grown = {}
        step = node
        for n, (first, k) in owned.items():
            if k == 1:
                grown[first] = (first, 1)
                step = F.when(node == n, F.lit(first)).otherwise(step)
                continue
            left, right = first, first + k // 2
            grown[left], grown[right] = (left, k // 2), (right, k - k // 2)
            d, v, f = cuts.get(n, (0, 0, 0))
            below = (F.col(f"_d{d}") < v) | ((F.col(f"_d{d}") == v) & (F.col("_fine") < f))
            step = F.when((node == n) & below, F.lit(left)).when(node == n, F.lit(right)).otherwise(step)
        owned = grown
        before, table = table, staged(table.select("*", step.alias("_next")).drop("_node").withColumnRenamed("_next", "_node"), "kd")
        discard(before)
        node = F.col("_node")
    placed = table.select(id_col, "size", "text_crc32", node.cast("int").alias("shard"))
    return ranked(placed, ["shard"], [id_col, "text_crc32", "size"], "slot")
