"""Exact top-k by inner product: a Voronoi join.

Data and queries are grouped by their nearest pivot. Small summaries (pivots, and from each cell a few members and a
histogram of distances) bound each query's k-th best score from below, by true products with those members, and the
score that any member of a cell can reach from above: q.v <= q.p + |q| d(v, p), and q.v <= |q| |v|. From these follows, for
each cell's queries and each cell of data, the least distance to the pivot and the least length at which a vector can
still matter; only such vectors are sent to the queries. Cells whose queries want much the same vectors ask together.
Each group's vectors are dealt out in chunks, and each chunk is solved by a matrix product. Scores are whole
numbers throughout, so ties are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, staged

PIVOTS = 128
SAMPLE = 8192  # vectors that the pivots are picked from; every vector is indexed
SEEDS = 32  # members of each cell whose products bound the k-th score from below
BINS = 64  # of a cell's histogram of distances
BLOCK = 4096  # queries that are solved together at most
CHUNK = 16_384  # vectors of a group that are solved together, about
ALIKE = 1.25  # groups ask together if that sends at most so many times the vectors that the larger one wants
EXACT = float(1 << 52)  # products of doubles are exact below
LIMB = 60  # bits of the parts that larger ones are compared by
HAIR = 1e-6  # for rounding, of the longest vector's length; far more than the error of a distance


def quantised(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * component) as whole doubles; rows with a null id, vector or component, or one that is not finite, are left out."""
    x = F.col(vector_col)
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(scaled(c)) == F.lit(float("inf"))))
    # doubles from 2**53 on are whole numbers
    whole = lambda c: F.when(F.abs(scaled(c)) < F.lit(2.0**53), F.floor(scaled(c)).cast("double")).otherwise(scaled(c))
    return table.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~odd).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def _rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of float64; shorter ones end in zeros."""
    out = np.zeros((len(column), width))
    for row, v in zip(out, column.to_pylist(), strict=True):
        row[: len(v)] = v
    return out


def _centres(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n pivots: rows picked one by one, each the farthest from those before, then moved to the means of what is nearest to them."""
    if len(sample) <= n:
        return sample
    picked, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    centres = sample[picked]
    for _ in range(rounds):
        near = (((centres**2).sum(1) - 2 * sample @ centres.T)).argmin(1)
        number = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
    return centres


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, ties to the first column."""
    n = scores.shape[1]
    if n <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    # above the k-th score all, and of those equal to it the first columns
    above = scores > floor
    room = k - above.sum(1, keepdims=True)
    level = scores == floor
    take = above | (level & (np.cumsum(level, axis=1) <= room))
    cols = np.nonzero(take)[1].reshape(len(scores), k)
    order = np.argsort(-np.take_along_axis(scores, cols, 1), axis=1, kind="stable")
    return np.take_along_axis(cols, order, 1)


def best_scores(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of at least the k best of each query; ids are in order. Products that doubles can't hold are made of Python's whole numbers."""
    limit = (EXACT / q.shape[1]) ** 0.5
    small_q, small_x = np.abs(q).max(1, initial=0) <= limit, np.abs(x).max(1, initial=0) <= limit
    near = np.flatnonzero(small_x)
    for at in np.array_split(np.flatnonzero(small_q), max(1, ceil(small_q.sum() / 256))):
        if not len(at) or not len(near):
            continue
        scores = q[at] @ x[near].T
        scores[own[at][:, None] == ids[near]] = -np.inf
        cols = _top(scores, min(k, len(near)))
        best = np.take_along_axis(scores, cols, 1)
        row, col = np.nonzero(best > -np.inf)
        yield from zip(own[at][row].tolist(), ids[near][cols[row, col]].tolist(), best[row, col].astype(np.int64).tolist(), strict=True)
    whole = lambda v: [int(c) for c in v]
    for queries, members in ((np.flatnonzero(small_q), np.flatnonzero(~small_x)), (np.flatnonzero(~small_q), np.arange(len(x)))):
        if len(queries) and len(members):
            held = [(ids[j].item(), whole(x[j])) for j in members]
            for i in queries:
                mine, asks = own[i].item(), whole(q[i])
                scores = ((-sum(map(mul, asks, v)), j) for j, v in held if j != mine)
                yield from ((mine, j, -s) for s, j in heapq.nsmallest(k, scores))


class Join:
    """The cells of a table, its queries in groups, and the bounds of what each group is sent."""

    def __init__(self, table: DataFrame, k: int, every: int, scale: int, id_col: str, vector_col: str):
        self.k, self.spark = k, table.sparkSession
        data = quantised(table, id_col, vector_col, scale)
        facts = data.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("largest")).first()
        self.width, self.largest = max(1, facts["width"] or 1), facts["largest"] or 1.0
        self.id_kind = data.schema["vec_id"].dataType.simpleString()
        self._assign(data)
        asked = self.placed.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q"))
        self.queries = staged(asked.select(F.col("vec_id").alias("query_id"), F.col("q.v").alias("qv"), F.col("q.cell").alias("qcell")), "queries")
        self._group()

    def _assign(self, data: DataFrame) -> None:
        """placed: each vector with its cell, its distance to the pivot and its length; these are of vectors over the largest component."""
        width, unit = self.width, self.largest
        seen = data.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
        self.pivots = pivots = _centres(_rows(seen.column("v"), width) / unit, PIVOTS) if seen.num_rows else np.zeros((1, width))
        norms = (pivots**2).sum(1)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _rows(batch.column("v"), width) / unit
                square = (x**2).sum(1)
                d = np.maximum(norms - 2 * x @ pivots.T + square[:, None], 0)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(np.sqrt(d[np.arange(len(x)), near])), pa.array(np.sqrt(square))], names=["vec_id", "v", "cell", "far", "norm"])

        self.placed = staged(data.mapInArrow(assign, f"vec_id {self.id_kind}, v array<double>, cell int, far double, norm double"), "cells")

    def _reach(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For the queries of a cell, and each cell of data, the least distance and the least length at which a vector may be among the best."""
        width, unit, pivots, k = self.width, self.largest, self.pivots, self.k
        hair = HAIR * width**0.5
        longest = Window.partitionBy("cell").orderBy(F.desc("norm"), "vec_id", "v")
        picked = self.placed.withColumn("_n", F.row_number().over(longest)).where(F.col("_n") <= SEEDS).select("vec_id", "v").toArrow()  # at most PIVOTS * SEEDS rows
        seeds, seed_ids = _rows(picked.column("v"), width) / unit, picked.column("vec_id").to_numpy()

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, n = ["qcell", "cell", "far", "norm"], len(pivots)
            for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
                q, cells = _rows(batch.column("qv"), width) / unit, batch.column("qcell").to_numpy()
                size = np.sqrt((q**2).sum(1))
                # products with real vectors; a query's own rows promise nothing
                sure = np.where(batch.column("query_id").to_numpy()[:, None] == seed_ids, -np.inf, q @ seeds.T)
                sure = np.concatenate([np.full((len(q), k), -np.inf), sure], 1)
                floor = -np.partition(-sure, k - 1, axis=1)[:, k - 1] - hair * HAIR
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = np.where(size[:, None] > 0, (floor[:, None] - q @ pivots.T) / size[:, None], -np.inf) - hair
                    norm = np.where(size > 0, floor / size, -np.inf) - hair
                for c in np.unique(cells):
                    yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(far[cells == c].min(0)), pa.array([norm[cells == c].min()] * n)], names=names)

        least = self.queries.mapInArrow(reach, "qcell int, cell int, far double, norm double").groupBy("qcell", "cell").agg(F.min("far").alias("far"), F.min("norm").alias("norm"))
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in least.collect():  # at most PIVOTS squared
            far, norm = out.setdefault(r["qcell"], (np.zeros(len(pivots)), np.zeros(len(pivots))))
            far[r["cell"]], norm[r["cell"]] = r["far"], r["norm"]
        return out

    def _group(self) -> None:
        """bounds: cell, group, far, norm, parts, chunks; lots: qcell, group, parts, chunks. Neighbouring cells ask together if they want much the same."""
        bounds, n = self._reach(), len(self.pivots)
        asking = {r["qcell"]: r["count"] for r in self.queries.groupBy("qcell").count().collect()}
        top = self.placed.agg(F.max("far")).first()[0] or 1.0
        held = np.zeros((n, BINS))
        for r in self.placed.groupBy("cell", F.least(F.floor(F.col("far") / F.lit(top) * BINS), F.lit(BINS - 1)).alias("bin")).count().collect():
            held[r["cell"], r["bin"]] = r["count"]
        ends = (np.arange(BINS) + 1) * top / BINS
        wants = lambda far: (held * (ends >= far[:, None] - top * 1e-9)).sum()
        groups: list[list] = []  # cells, far, norm, queries, vectors wanted
        for c in sorted(asking, key=lambda c: tuple(self.pivots[c])):
            far, norm = bounds[c]
            own = wants(far)
            if groups and groups[-1][3] + asking[c] <= BLOCK:
                last = groups[-1]
                both = np.minimum(last[1], far), np.minimum(last[2], norm)
                together = wants(both[0])
                if together <= ALIKE * max(own, last[4]):
                    groups[-1] = [[*last[0], c], *both, last[3] + asking[c], together]
                    continue
            groups.append([[c], far, norm, asking[c], own])
        self.groups = len(groups)
        parts = [ceil(g[3] / BLOCK) for g in groups]
        chunks = [max(1, ceil(g[4] / CHUNK)) for g in groups]
        self.lots = self.spark.createDataFrame([(c, i, parts[i], chunks[i]) for i, g in enumerate(groups) for c in g[0]], "qcell int, group int, parts int, chunks int")
        rows = [(c, i, float(g[1][c]), float(g[2][c]), parts[i], chunks[i]) for i, g in enumerate(groups) for c in range(n)]
        self.bounds = self.spark.createDataFrame(rows, "cell int, group int, least_far double, least_norm double, parts int, chunks int")

    def sent(self) -> DataFrame:
        """group, part, chunk, vec_id, v of every vector that a group's queries may want."""
        # at most PIVOTS squared bounds
        met = self.placed.join(F.broadcast(self.bounds), "cell").where((F.col("far") >= F.col("least_far")) & (F.col("norm") >= F.col("least_norm")))
        chunk = F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int").alias("chunk")
        return met.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), chunk, "vec_id", "v")

    def solved(self) -> DataFrame:
        """query_id, vec_id, score and its key of the best of each chunk."""
        k, width = self.k, self.width
        limbs = int((log2(width) + 2 * log2(self.largest + 1) + 2) // LIMB) + 1
        asking = self.queries.join(F.broadcast(self.lots), "qcell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        asking = asking.select("query_id", "qv", "group", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        most = (1 << 63) - 1

        def key(score: int) -> list[int]:
            """Numbers below 2**60, the first of which has the sign: they order as the scores do."""
            return [score] if limbs == 1 else [score >> LIMB * (limbs - 1), *((score >> LIMB * i) & ((1 << LIMB) - 1) for i in reversed(range(limbs - 1)))]

        def solve(_: tuple, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            have = have.sort_values("vec_id", kind="stable")
            found = []
            if len(ask) and len(have):
                found = list(best_scores(ask["query_id"].to_numpy(), _rows(pa.array(ask["qv"]), width), have["vec_id"].to_numpy(), _rows(pa.array(have["v"]), width), k))
            told = [(a, b, max(-most - 1, min(most, s)), key(s)) for a, b, s in found]
            return pd.DataFrame(told, columns=["query_id", "vec_id", "score", "key"])

        by = ["group", "part", "chunk"]
        schema = f"query_id {self.id_kind}, vec_id {self.id_kind}, score long, key array<long>"
        return asking.groupBy(*by).cogroup(self.sent().groupBy(*by)).applyInPandas(solve, schema)


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    Queries are rows whose id is divisible by `every`, candidates all rows of another id. Vectors shorter than the
    longest count as ending in zeros. Of repeated rows of one query id the least vector asks; repeated candidates
    stand each. Components may be of any finite size (scale times a component must be finite too): products
    beyond doubles are exact, and scores beyond 64 bits rank by their true value and are told as the nearest
    one of 64 bits. An empty table gives no rows; further columns are left out.
    """
    join = Join(table, k, every, scale, id_col, vector_col)
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    ranked = staged(join.solved().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
    discard(join.placed, join.queries)
    return ranked


def share_sent(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[int, float]:
    """The number of groups of queries, and the share of all vectors that a group is sent on average."""
    join = Join(table, k, every, scale, id_col, vector_col)
    rows = join.placed.count()
    return join.groups, join.sent().where("part = 0").count() / max(1, join.groups * rows)
