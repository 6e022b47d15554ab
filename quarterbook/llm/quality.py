"""Quality scores: a kernel ridge classifier by random Fourier features over document statistics.

Statistics of every text are staged once. Ridge regression on cosine features of them (a Gaussian kernel) is fitted
by normal equations that Spark sums over partitions; an isotonic fit on other labelled rows turns the
scores into probabilities. Only sums of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import key_crc, slices, staged

STATISTICS = ("log_chars", "log_words", "word_length", "letters", "digits", "upper", "blanks", "stops", "symbols", "lines", "distinct_words", "top_word", "repeated_lines", "word_spread", "distinct_letters")
FOURIER = 192
BINS = 400
UNIT = 1 << 24  # sums of partitions are whole numbers of these parts, so their order doesn't matter


def statistics_of(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; all zeros for an empty one."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        n = len(text)
        raw = text.encode()
        c = np.frombuffer(raw, np.uint8)
        seen = np.bincount(c, minlength=256)
        small, large, digits = seen[97:123].sum(), seen[65:91].sum(), seen[48:58].sum()
        blanks, lines, stops = seen[32] + seen[9:14].sum(), seen[10], seen[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
        high, size = seen[128:].sum(), len(c)
        words = raw.split()
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        k = max(1, len(words))
        lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
        rows = [x for x in raw.split(b"\n") if x.strip()]
        letters = (seen[97:123] + seen[65:91]) / max(1, small + large)
        row[:] = (
            np.log1p(n), np.log1p(len(words)), lengths.mean(), (small + large + high) / size, digits / size, large / size, blanks / size, stops / size,
            (seen[33:127].sum() - small - large - digits - stops) / size, lines / size, len(counts) / k, max(counts.values(), default=0) / k,
            1 - len(set(rows)) / max(1, len(rows)), lengths.std(), (letters**2).sum(),
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the cosines, and last the constant
    knots: np.ndarray | None = None  # isotonic: scores and their probabilities
    values: np.ndarray | None = None
    seed: int = 7

    def features(self, x: np.ndarray) -> np.ndarray:
        """sqrt(2/D) cos(x W + b), and a constant; W and b come from the seed, for a kernel as wide as the statistics are many."""
        draw = np.random.default_rng(self.seed)
        w = draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], FOURIER))
        b = draw.uniform(0, 2 * np.pi, FOURIER)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ w + b
        return np.concatenate([np.sqrt(2 / FOURIER) * np.cos(z), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None or not len(self.knots):
            return np.clip(self.raw(x), 0, 1)
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(position: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in order: places and nondecreasing means of the pools."""
    pools: list[list[float]] = []  # weight, sum, sum of weight times place
    for p, t, w in zip(position, total, weight, strict=True):
        pools.append([w, t, w * p])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([x / w for w, _, x in pools]), np.array([t / w for w, t, _ in pools])


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, what `keep` names, and the array of STATISTICS of every whole text (null: empty)."""
    carried = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            x = statistics_of([t or "" for t in batch.column(text_col).to_pylist()])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), flat], names=[*carried, "stats"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return docs.select(*carried, text_col).mapInArrow(run, f"{kinds}stats array<double>")


def fit(train: DataFrame, hold: Column, ridge: float = 1e-3) -> Model | None:
    """train: stats and label (0 or 1). Rows where `hold` is true calibrate, the others fit the ridge; None without rows."""
    d = len(STATISTICS)
    fitting, calibrating = train.where(~hold), train.where(hold)
    moments = fitting.agg(F.count("*").alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]).first()
    if not moments["n"]:
        return None
    # nine decimals: sums of doubles end in digits that follow their order
    model = Model(np.round([moments[f"m{i}"] for i in range(d)], 9), np.round([moments[f"s{i}"] or 1.0 for i in range(d)], 9), np.zeros(FOURIER + 1))
    size = FOURIER + 1

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(_matrix(batch))
            total += z.T @ np.concatenate([z, batch.column("label").to_numpy()[:, None]], 1)
        at = np.triu_indices(size, 0, size + 1)
        parts = np.round(total[at] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(parts)], names=["i", "j", "v"])

    sums = fitting.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(gram, "i int, j int, v long").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v")).toArrow()
    full = np.zeros((size, size + 1))
    full[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy() / UNIT
    square = full[:, :size] + np.triu(full[:, :size], 1).T
    model.weights = np.linalg.solve(square + ridge * moments["n"] * np.eye(size), full[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)), pa.array(raw), batch.column("label")], names=["bin", "raw", "label"])

    bins = calibrating.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(binned, "bin int, raw double, label double")
    held = bins.groupBy("bin").agg(F.round(F.avg("raw"), 9).alias("at"), F.sum("label").alias("t"), F.count("*").alias("w")).orderBy("bin").toPandas()
    if len(held):
        model.knots, model.values = isotonic(held["at"].to_numpy(), held["t"].to_numpy(float), held["w"].to_numpy(float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, what `keep` names, held_out, score (probability of label 1) and predicted of every row, from the whole text alone.

    Labels of ids whose crc32 mod 4 is 2 are never learned from; of the others, those with remainder 3
    calibrate. Null text is empty and gets a score as any text; null labels and labels of other ids are left out;
    without labels every score is 0.5. Repeated rows are scored each; an empty table gives no rows; further
    columns are left out.
    """
    carried = [id_col, *keep]
    stats = staged(statistics(docs, id_col, text_col, keep), "quality")
    fold = F.pmod(key_crc(id_col), F.lit(4))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(fold != 2)
    model = fit(stats.join(known, id_col).select("stats", "label", fold.alias("fold")), F.col("fold") == 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(_matrix(batch)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(np.clip(score, 0, 1))], names=[*carried, "score"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carried)
    scored = stats.mapInArrow(run, f"{kinds}score double")
    return scored.select(*carried, (fold == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

