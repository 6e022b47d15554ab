"""Periodic runs: stretches of words that repeat with a period, by divide and conquer over word numbers as Main and Lorentz do.

A stretch of at least four periods that crosses the midpoint of the smallest node that holds it has two periods at least on one
side: the right half then begins with a square, or the left one ends with one. All nodes of a level, of all texts of a
slice, are probed for that at once in numpy; only where some probes fit does a Z-function of the half tell which squares
there are. A square is extended as far as its period goes; stretches found twice are kept once, with their smallest period.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, words_of

PERIODS = 4
WORDS = 6
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
PROBED = 4_000_000  # probes held at once


def z_function(s: list[int]) -> list[int]:
    """How far the sequence from each place on agrees with its beginning (0 at the first place)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agree(s: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many places from a and b on, in steps of 1 or -1, agree, up to `most`."""
    done, size = 0, 64
    if most <= 0 or s[a] != s[b]:
        return 0
    while done < most:
        n = min(size, most - done)
        x, y = (s[a + done : a + done + n], s[b + done : b + done + n]) if step > 0 else (s[a - done - n + 1 : a - done + 1][::-1], s[b - done - n + 1 : b - done + 1][::-1])
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, size = done + n, size * 2
    return done


def _levels(counts: np.ndarray, fewest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """low, mid and high of the nodes of each level of texts of so many words in a row."""
    high = np.cumsum(counts)
    low = high - counts
    while True:
        on = high - low >= fewest
        low, high = low[on], high[on]
        if not len(low):
            return
        mid = (low + high) // 2
        yield low, mid, high
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])


def _likely(s: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of nodes whose right half may begin with a square, and of those whose left half may end with one."""
    out = []
    for side in (1, -1):
        half = ((high - mid) if side > 0 else (mid - low)) // 2
        origin = mid if side > 0 else mid - 1
        found, ends, done = [], np.cumsum(half), 0
        while done < len(half):
            until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PROBED, side="right")))
            own = half[done:until]
            node = np.repeat(np.arange(done, until), own)
            q = np.arange(len(node)) - np.repeat(np.cumsum(own) - own, own) + 1
            for at in (lambda q: 0 * q, lambda q: q - 1, lambda q: q >> 1, lambda q: q >> 2, lambda q: (3 * q) >> 2):
                place = origin[node] + side * at(q)
                fits = s[place] == s[place + side * q]
                node, q = node[fits], q[fits]
            found.append(np.unique(node))
            done = until
        out.append(np.concatenate(found))
    return out[0], out[1]


def runs_of(s: np.ndarray, counts: np.ndarray, periods: int = PERIODS, fewest: int = WORDS) -> list[dict[tuple[int, int], int]]:
    """For each text of so many words in a row: the smallest period of each stretch (start, end) of `periods` periods and `fewest` words at least that can't be longer."""
    ends = np.cumsum(counts)
    out: list[dict[tuple[int, int], int]] = [{} for _ in counts]
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by text and period: stretches so far in order; they overlap by less than a period
    for low, mid, high in _levels(counts, fewest):
        for side, nodes in zip((1, -1), _likely(s, low, mid, high), strict=True):
            texts = np.searchsorted(ends, mid[nodes], side="right")
            for k, i in zip(nodes.tolist(), texts.tolist(), strict=True):
                a, m, b = int(low[k]), int(mid[k]), int(high[k])
                z = np.array(z_function((s[m:b] if side > 0 else s[a:m][::-1]).tolist()))
                q = np.arange(len(z))
                left = [int(x) for x in np.flatnonzero((z >= q) & (q > 0))]
                begin, end = int(ends[i] - counts[i]), int(ends[i])
                while left:
                    p = left[0]
                    x, y = (m, m + 2 * p) if side > 0 else (m - 2 * p, m)
                    known = held.setdefault((i, p), [])
                    at = bisect_right(known, (x, len(s)))
                    run = known[at - 1] if at else None
                    if run is None or run[1] < y:
                        run = x - _agree(s, x - 1, x - 1 + p, -1, x - begin), y + _agree(s, y, y - p, 1, end - y)
                        insort(known, run)
                        if run[1] - run[0] >= max(fewest, periods * p):
                            place = run[0] - begin, run[1] - begin
                            out[i][place] = min(p, out[i].get(place, p))
                    # squares of several such periods inside the stretch lie in the same one
                    reach = run[1] - m if side > 0 else m - run[0]
                    left = [o for o in left[1:] if o % p or 2 * o > reach]
    return out


def best_run(found: dict[tuple[int, int], int]) -> tuple[int, int, int] | None:
    """start, length and period of the stretch of most periods, exactly; then of the smallest start and period."""
    best = None
    for (a, b), p in found.items():
        if best is None or (more := (b - a) * best[2] - best[1] * p) > 0 or (more == 0 and (a, p) < (best[0], best[2])):
            best = a, b - a, p
    return best


def periodic_runs(docs: DataFrame, periods: int = PERIODS, fewest: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (start, length, period in words, by start and period), best (the run of most periods; null without any) and collapsed of every row.

    A run is a stretch of consecutive words [^\\x20\\x09-\\x0D]+ with smallest period q, of `fewest` words and `periods` times q at least, that
    no neighbouring word extends with period q. `collapsed` has the words, joined by one blank, without those that stand in a run
    after its first q words. A null or empty text has no words, no runs and an empty `collapsed`. Ids play no part: rows with null or
    repeated ids each get what their text has. An empty table gives no rows; further columns, of whatever name, are left out.
    """
    if periods < PERIODS:
        raise ValueError(f"at least {PERIODS} periods: with fewer, two of them needn't lie on one side of a midpoint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 21):
            texts = [words_of(t) for t in batch.column("_text").to_pylist()]
            counts, numbers = np.fromiter(map(len, texts), np.int64, len(texts)), {}
            s = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int32, int(counts.sum()))
            spans, best, kept = [], [], []
            for words, found in zip(texts, runs_of(s, counts, periods, fewest), strict=True):
                inside = np.zeros(len(words) + 1, np.int64)
                for (a, b), p in found.items():
                    inside[a + p] += 1
                    inside[b] -= 1
                if found:
                    gone = np.cumsum(inside)[:-1] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                spans.append([{"start": a, "length": b - a, "period": p} for (a, b), p in sorted(found.items(), key=lambda r: (r[0][0], r[1]))])
                first = best_run(found)
                best.append(first and dict(zip(("start", "length", "period"), first, strict=True)))
                kept.append(b" ".join(words))
            made = [pa.array(counts), pa.array(spans, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *made], names=["_id", "n_words", "runs", "best", "collapsed"])

    kind, span = docs.schema[id_col].dataType.simpleString(), "struct<start:bigint,length:bigint,period:bigint>"
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = rows.mapInArrow(run, f"_id {kind}, n_words bigint, runs array<{span}>, best {span}, collapsed string")
    return found.withColumnRenamed("_id", id_col)
