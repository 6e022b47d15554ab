"""Phrase collocations by pivot partitioning, as MG-FSM does: every n-gram is counted where its rarest word is at home.

A first pass counts words by language. Their counts fill a table of fixed size (a counter for each of 2**BITS residues of a
word's hash), which says how rare a word is; the table never decides a count, only which word of an n-gram is its pivot: the
leftmost of those with the least counter. Words with an empty counter are too rare to stand in any phrase and part the text.

A second pass rewrites the text: around each word, as a pivot, a fragment of at most two words before and after it, up to the
first word that would be the pivot instead. Equal fragments of a slice become one with a count, and go, by language and
pivot, to buckets; fragments of frequent pivots are dealt over several buckets by what they hold. A bucket is mined by itself, and emits n-grams
that its pivots own. Those of a pivot that is in one bucket are complete there; the rest are summed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import slices, staged
from .word_hashes import PRIME, _of_words, mixed

BITS = 20
BUCKET_WORDS = 1_000_000  # words of the corpus for each bucket, more or less
SLICE = 4 << 20
BLANK, BREAK = 1, 2
#: What each byte is: in a word (0), a blank (1), or an end of a piece (2).
KIND = np.array([BREAK if bytes([c]) in b".,;:!?\n\x0b\x0c\r" else BLANK if c in (32, 9) else 0 for c in range(256)], np.uint8)
FOLD = bytes(32 if KIND[c] else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Sliced:
    """The words of texts in a row: numbers of words in the order of `words`, whether a word is in one piece with the one before it, and a hash of each of `words`."""

    def __init__(self, texts: list[str]):
        whole = b"\n".join([b"", *(t.encode() for t in texts), b""])
        kind = KIND[np.frombuffer(whole, np.uint8)]
        inside = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        ends = np.cumsum(kind == BREAK, dtype=np.int32)[start]
        self.joins = np.concatenate([[False], ends[1:] == ends[:-1]])[: len(start)]
        whole = whole.translate(FOLD)
        numbers: dict[bytes, int] = {}
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in whole.split()), np.int32, len(start))
        self.words = list(numbers)
        first = np.zeros(len(self.words), np.int64)
        first[self.ids[::-1]] = np.arange(len(start))[::-1]
        self.hashes = _of_words(whole, start[first], end[first]) if len(start) else np.zeros(0, np.uint64)


def _within(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of words of one language."""
    own = int.from_bytes(lang.encode()[-8:], "little") * int(PRIME) % (1 << 64)
    return mixed(hashes ^ np.uint64(own))


def _slots(hashes: np.ndarray, lang: str) -> np.ndarray:
    return (_within(hashes, lang) >> np.uint64(64 - BITS)).astype(np.int32)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    for batch in slices(batches, "_text", SLICE):
        langs = np.array(batch.column("_lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            yield lang, batch.column("_text").filter(pa.array(langs == lang)).to_pylist()


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """lang, word, slot and n of the words that occur `least` times, and with a null word the number of all words of a language; rows: _lang, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            s = Sliced(texts)
            n = np.bincount(s.ids, minlength=len(s.words))
            words = pa.array([*s.words, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), words, pa.array(np.append(_slots(s.hashes, lang), -1).astype(np.int32)), pa.array(np.append(n, len(s.ids)))], names=["lang", "word", "slot", "n"])

    each = rows.mapInArrow(run, "lang string, word string, slot int, n long")
    return each.groupBy("lang", "word", "slot").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least))


def _fragments(ids: np.ndarray, joins: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """For each pivot that has a neighbour: two numbers of words before it, its own and two after it (-1: none); counter: of each word's number."""
    n, c = len(ids), counter[ids]
    out = np.full((n, 5), -1, np.int32)
    out[:, 2] = ids
    live = c > 0
    before = after = live
    for k in (1, 2):
        if n <= k:
            break
        link = np.zeros(n, bool)  # whether the k-th word before goes along
        link[k:] = before[k:] & joins[1 : n - k + 1] & (c[:-k] > c[k:])
        out[link, 2 - k] = ids[np.flatnonzero(link) - k]
        before = link
        link = np.zeros(n, bool)
        link[:-k] = after[:-k] & joins[k:] & (c[k:] >= c[:-k]) & live[k:]
        out[link, 2 + k] = ids[np.flatnonzero(link) + k]
        after = link
    return out[(out[:, 1] >= 0) | (out[:, 3] >= 0)]


def _packed(s: Sliced, lang: str, counter: np.ndarray, copies: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: lang, bucket, whether its pivots are in other buckets too, its words, fragments (five numbers of those words each) and their counts."""
    found = _fragments(s.ids, s.joins, counter)
    key = np.zeros(len(found), np.uint64)
    for k in range(5):
        key = mixed((key ^ (found[:, k].astype(np.int64) + 1).view(np.uint64)) * PRIME)
    order = np.argsort(key)
    found, key = found[order], key[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]).any(1)])[: len(found)]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(found))).astype(np.int32)
    found = found[first]
    pivot = found[:, 2]
    # where a fragment goes follows from its language and words alone, in any slice
    content = np.zeros(len(found), np.uint64)
    hashes = np.append(s.hashes, np.uint64(0))
    for k in range(5):
        content = mixed((content ^ hashes[found[:, k]]) * PRIME)
    salt = (content >> np.uint64(11)) % copies[pivot].astype(np.uint64)
    home = _within(hashes[pivot], lang) + salt * PRIME
    bucket = (mixed(home) % np.uint64(buckets)).astype(np.int64) * 2 + (copies[pivot] > 1)
    order = np.argsort(bucket, kind="stable")
    found, n, bucket = found[order], n[order], bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    held = np.append(begin, len(bucket))
    row = np.repeat(np.arange(len(begin)), np.diff(held))
    # each bucket's own numbers of its words
    at = np.flatnonzero(found.ravel() >= 0)
    pairs = np.repeat(row, 5)[at] * np.int64(len(s.words) + 1) + found.ravel()[at]
    own, where = np.unique(pairs, return_inverse=True)
    opens = np.searchsorted(own, np.arange(len(begin) + 1) * np.int64(len(s.words) + 1))
    local = np.full(found.size, -1, np.int32)
    local[at] = where - opens[np.repeat(row, 5)[at]]
    words = pa.array(s.words, pa.binary()).cast(pa.string()).take(pa.array(own % (len(s.words) + 1)))
    listed = pc.binary_join(pa.ListArray.from_arrays(pa.array(opens, pa.int32()), words), " ")
    blob = lambda a, width: pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((held * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])
    place = bucket[begin]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(begin), pa.string()), pa.array((place >> 1).astype(np.int32)), pa.array(place % 2 == 1), listed, blob(local, 20), blob(n, 4)], names=["lang", "bucket", "parted", "words", "fragments", "n"])


PACKED = "lang string, bucket int, parted boolean, words string, fragments binary, n binary"


def mined(rows: list[tuple[str, bytes, bytes]], least: int) -> tuple[list[bytes], np.ndarray]:
    """N-grams (words joined by one blank) of one language and bucket that occur `least` times, and how often; rows: words, fragments, n."""
    numbers: dict[str, int] = {}
    parts = []
    for words, fragments, _ in rows:
        own = np.array([*(numbers.setdefault(w, len(numbers)) for w in words.split(" ")), -1], np.int64)
        parts.append(own[np.frombuffer(fragments, np.int32)].reshape(-1, 5))
    f = np.concatenate(parts)
    n = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows]).astype(np.int64)
    size = len(numbers) + 1
    names, grams, counts = list(numbers), [], []
    for length, places in ((2, ((1, 2), (2, 3))), (3, ((0, 1, 2), (1, 2, 3), (2, 3, 4)))):
        keys, weights = [], []
        for place in places:
            on = np.flatnonzero((f[:, place] >= 0).all(1))
            key = np.zeros(len(on), np.int64)
            for p in place:
                key = key * size + f[on, p]
            keys.append(key), weights.append(n[on])
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        total = np.add.reduceat(weight, first) if len(first) else weight
        first, total = first[total >= least], total[total >= least]
        left, own = key[first], []
        for _ in range(length):
            left, word = np.divmod(left, size)
            own.append(word.tolist())
        grams += [" ".join(map(names.__getitem__, w)) for w in zip(*own[::-1], strict=True)]
        counts.append(total)
    return grams, np.concatenate(counts)


MINED_ROWS = 3_000_000  # fragments mined at once; what is left of a bucket is then summed with the rest


def _grams(packed: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n and whether that is its whole count, from rows that come by bucket and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes, bytes]] = []
        size, last, cut = 0, None, False

        def solve(whole: bool) -> pa.RecordBatch:
            grams, n = mined(held, least if whole else 1)
            return pa.RecordBatch.from_arrays([pa.array([last[1]] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n), pa.array([whole] * len(grams), pa.bool_())], names=["lang", "phrase", "n", "whole"])

        for batch in slices(batches, "fragments", 16 << 20):
            columns = [batch.column(c).to_pylist() for c in ("bucket", "lang", "parted", "words", "fragments", "n")]
            for bucket, lang, parted, *row in zip(*columns, strict=True):
                if held and ((bucket, lang, parted) != last or size >= MINED_ROWS):
                    cut = cut or (bucket, lang, parted) == last
                    yield solve(not (cut or last[2]))
                    held, size, cut = [], 0, (bucket, lang, parted) == last
                held.append(tuple(row))
                size, last = size + len(row[2]) // 4, (bucket, lang, parted)
        if held:
            yield solve(not (cut or last[2]))

    return packed.mapInArrow(run, "lang string, phrase string, n long, whole boolean")


def phrase_counts(rows: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """lang, phrase (2 to 3 words joined by one blank) and a, of all phrases that occur `least` times; rows: _lang, _text, counts: as of word_counts."""
    spark = rows.sparkSession
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    filled = counts.where("word is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2**BITS rows
    table = np.zeros(1 << BITS, np.int64)
    table[filled.column("slot").to_numpy()] = filled.column("n").to_numpy()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, -(-total // BUCKET_WORDS))
    shared, by_chance = spark.sparkContext.broadcast(table), 2 * total >> BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            s = Sliced(texts)
            counter = shared.value[_slots(s.hashes, lang)]
            # so many buckets that a part of a pivot's fragments is a fraction of a bucket's; what any counter has by chance doesn't count
            copies = 1 + np.maximum(counter - by_chance, 0) * 8 // BUCKET_WORDS
            made = _packed(s, lang, counter, copies, buckets)
            if made.num_rows:
                yield made

    packed = rows.mapInArrow(run, PACKED).repartition(max(partitions, buckets // 4), "bucket").sortWithinPartitions("bucket", "lang", "parted")
    found = staged(_grams(packed, least), "grams")
    whole = found.where("whole").select("lang", "phrase", F.col("n").alias("a"))
    parted = found.where("not whole").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return whole.unionAll(parted)


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of the first `most` collocations of each language.

    ASCII letters in lower case; texts are split at [.,;:!?\\x0A-\\x0D] into pieces, those into words [^\\x20\\x09]+. Candidates are phrases of 2 to
    3 words in one piece that occur a >= `least` times, overlaps included. A cut parts one into phrases of l and r occurrences, its score is
    floor(1000000 a a / (l r)), exact; the lowest one counts, of equal ones that after the fewest words. A candidate whose words stand in a row in
    a longer one of at least `percent` % of its occurrences goes. Ranks are by score and a, descending, and phrase (by its bytes).
    n counts all words of a language. A null language is 'und', a null text has no words; ids play no part, so repeated rows
    count each time. An empty table gives no rows; further columns are left out.
    """
    if least < 1:
        raise ValueError("phrases occur once at least")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counts = staged(word_counts(rows, least), "words")
    found = staged(phrase_counts(rows, counts, least), "phrases")
    parts = counts.where("word is not null").select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")).unionAll(found)
    words = F.split("phrase", " ")
    spelled = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), spelled(F.lit(1), k).alias("left"), spelled(k + 1, F.size(words) - k).alias("right")))
    cut = found.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    left = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    both = left.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  all products stay below 10**38 up to 10**15 occurrences
    score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (exact("a") * exact("a")).cast("decimal(31,0)"), exact("l") * exact("r"))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # what a phrase of two words stands in: at most two phrases of each of three
    longer = found.where(F.size(words) == 3).select("lang", F.explode(F.array_distinct(F.array(spelled(F.lit(1), F.lit(2)), spelled(F.lit(2), F.lit(2))))).alias("phrase"), F.col("a").alias("in"))
    kept = scored.join(longer.groupBy("lang", "phrase").agg(F.max("in").alias("in")), ["lang", "phrase"], "left").where(F.col("in").isNull() | (F.col("in") * 100 < F.col("a") * percent))
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    totals = counts.where("word is null").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", F.col("s.score").cast("long").alias("score"))
