"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are made in numpy over all characters of an Arrow slice at once and summed by Spark; the matrix of
log-probabilities (languages times 2**bits, whatever the corpus) goes to every task, which scores its slice
by a gather and a sum between document borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices

BITS = 15
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 1024  # the matrix is at most 1024 x 32768 doubles; more languages are an error
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def codes_of(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(codes for each order by position, where each text starts, whether each has a letter).

    Runs other than letters count as a blank at either side of a word. Positions whose n-gram would cross a
    border, or that start at a blank in a row of blanks, have code 2**bits (a column of zeros).
    """
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) + 2 for t in low], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    held = np.add.reduceat(letter, starts, dtype=np.int64) > 0
    points = np.where(letter, points, np.uint32(32))
    none = np.uint32(1 << bits)
    out = []
    for n in orders:
        code = np.full(len(points), none, np.uint32)
        if len(points) >= n:
            last = len(points) - n + 1
            h, any_letter, inner = np.zeros(last, np.uint32), np.zeros(last, bool), np.zeros(last, bool)
            for k in range(n):
                h = (h ^ points[k : k + last]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                any_letter |= letter[k : k + last]
                if 0 < k < n - 1:
                    inner |= ~letter[k : k + last]  # an n-gram over two words
            code[:last] = np.where(any_letter & ~inner, (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits), none)
        out.append(code)
    return out, starts, held


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # languages x (2**bits + 1); the last column is zero
    log_prior: np.ndarray
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS

    def scores(self, texts: list[str]) -> tuple[list[str], list[float]]:
        codes, starts, held = codes_of(texts, self.bits, self.orders)
        total = np.repeat(self.log_prior[:, None], len(texts), 1)
        for row, of in zip(total, self.log_prob, strict=True):
            for code in codes:
                row += np.add.reduceat(of[code], starts)
        best = total.argmax(0)
        share = 1 / np.exp(total - total.max(0)).sum(0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, held, strict=True)], [float(s) if h else 0.0 for s, h in zip(share, held, strict=True)]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.5, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Model:
    """Counts over every document with a language; null texts count as documents without n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in slices(batches, text_col):
            langs = batch.column(lang_col).to_pylist()
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                into = sums.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                for code in codes_of(own, bits, orders)[0]:
                    into += np.bincount(code, minlength=(1 << bits) + 1)
                seen[lang] = seen.get(lang, 0) + len(own)
        for lang, into in sums.items():
            into[-1] = seen[lang]  # the last bucket tells the documents
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(into[at], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string").alias(lang_col))
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # as arrays, so that the driver gets a row for each language
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("held")).orderBy("lang").limit(MOST_LANGUAGES + 1).toArrow()
    languages = table.column("lang").to_pylist()
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    width = 1 << bits
    log_prob, log_prior = np.zeros((len(languages), width + 1)), np.zeros(len(languages))
    for i, held in enumerate(table.column("held")):
        flat = held.values
        at, n = flat.field("bucket").to_numpy(), flat.field("n").to_numpy()
        full = np.zeros(width + 1)
        full[at] = n
        log_prior[i] = np.log(full[-1])
        log_prob[i, :-1] = np.log((full[:-1] + alpha) / (full[:-1].sum() + alpha * width))
    if languages:
        log_prior -= np.log(np.exp(log_prior).sum())
    return Model(languages, log_prob, log_prior, bits, orders)


def identify(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, `keep` columns, lang_pred and score (the posterior) of every row.

    Only rows for which `training` holds and whose language is not null are learned from. Null text and text
    without a letter is `und` with score 0, as is everything if nothing could be learned. Ties go to the first
    language by name; repeated rows are scored each; an empty table gives no rows; further columns are left out.
    """
    model = fit(docs.where(training) if training is not None else docs, text_col, lang_col)
    keep = keep or {}
    picked = docs.select(F.col(id_col), *[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("_text"))
    names = [id_col, *keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "_text"):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            lang, p = own.scores(texts) if own.languages else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = picked.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return picked.mapInArrow(score, schema)
