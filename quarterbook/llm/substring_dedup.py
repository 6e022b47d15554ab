"""Substring dedup: passages of a document that also stand in a document of a smaller id, by FM-indexes of shards.

A shard must hold all windows that can be equal. So a window (of `min_words` words) goes by its anchor, the least hash of
its runs of four words; windows in a row with one anchor travel together as a segment. Anchors found in one document
only are left out first, and exact copies of a whole text are settled by its digest. The distinct
segments of a shard, each with the smallest id that holds it, make a compressed FM-index; segments stream past it in
backward search, and for each window that matches at full length the smallest id over its interval of suffixes is reported. A shard
numbers its words themselves, and its answers go back to the documents by a digest of each segment's words: hashes only
decide which windows meet, never which are equal.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, discard, hot_join, hot_keys, slices, staged, words_of
from .fm_index import FMIndex
from .word_hashes import PRIME, anchored, digests, joined, mixed, runs, word_hashes

RUN = 4
HOT = 2_000  # documents with one anchor from which its windows go each by their own hash
SHARD_BYTES = 1_500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEYS = ["_id", "_text_hash"]


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    """anchor and the document's key, once for each anchor of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            h, counts, *_ = word_hashes(batch.column("_text").to_pylist())
            anchor, text, _, _ = anchored(h, counts, window, RUN)
            order = np.lexsort([anchor, text])
            anchor, text = anchor[order], text[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[: len(anchor)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), batch.column("_key").take(pa.array(text[new]))], names=["anchor", "_key"])

    return rows.mapInArrow(run, "anchor long, _key long")


def _segments(candidates: DataFrame, window: int, words_too: bool) -> DataFrame:
    """Segments under shared anchors. words_too: route, segment (words joined by one blank) and the document's id; else key, first window and the document's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            h, counts, whole, opens, closes = word_hashes(batch.column("_text").to_pylist())
            anchor, text, first, n = anchored(h, counts, window, RUN)
            # whether an anchor is in its text's list: by one hash of both (a chance match only sends a segment in vain)
            tagged = lambda a, t: mixed(a.view(np.uint64) + t.astype(np.uint64) * PRIME)
            own, lists = tagged(anchor, text), {}
            for c in ("plain", "hot"):
                column = batch.column(c)
                lists[c] = np.isin(own, tagged(column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())))
            hot = np.flatnonzero(lists["hot"])
            plain = np.flatnonzero(lists["plain"] & ~lists["hot"])
            start = first + (np.cumsum(counts) - counts)[text]
            # under a hot anchor each window goes alone, by its own hash
            single = np.repeat(start[hot], n[hot]) + np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            begin = np.concatenate([start[plain], single])
            end = np.concatenate([start[plain] + n[plain], single + 1]) + window - 1
            text = np.concatenate([text[plain], np.repeat(text[hot], n[hot])])
            row = pa.array(text)
            segments = joined(whole, opens, closes, begin, end)
            if words_too:
                route = np.concatenate([anchor[plain], runs(h, window)[single].view(np.int64)]) if len(single) else anchor[plain]
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(segments, pa.binary()).cast(pa.string()), batch.column("_id").take(row)], names=["route", "segment", "_id"])
            else:
                place = pa.array((begin - (np.cumsum(counts) - counts)[text]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([digests(segments), place, *(batch.column(k).take(row) for k in KEYS)], names=["key", "first", *KEYS])

    return candidates.mapInArrow(run, "route long, segment string, _id long" if words_too else "key binary, first int, _id long, _text_hash long")


class Numbered(dict):
    """A number, from 1, for each word of a shard."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def smallest_owners(segments: list[bytes], owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment (words joined by one blank) the smallest owner of a segment that holds it, by one FM-index; and the number of windows of each."""
    words = [s.split() for s in segments]
    counts, number = np.fromiter(map(len, words), np.int64, len(words)), Numbered()
    stream = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    index = FMIndex(stream, counts)
    windows = counts - window + 1
    of = np.repeat(np.arange(len(counts)), windows)
    ends = window + (np.cumsum(counts) - counts)[of] + np.arange(len(of)) - (np.cumsum(windows) - windows)[of]
    # each window is in the index as itself: one that stands in no second place is its own segment's
    length, low, high = index.matches(stream, ends, window, fewest=2)
    out, again = owners[of], np.flatnonzero(length == window)
    if len(again):
        # intervals of equal length are the same or apart
        lows, first, at = np.unique(low[again], return_index=True, return_inverse=True)
        borders = np.stack([lows, high[again][first]], 1).ravel()
        held = np.append(owners[index.owner], np.iinfo(np.int64).max)
        out[again] = np.minimum.reduceat(held, borders)[::2][at]
    return out, windows


def _owned(distinct: DataFrame, window: int) -> DataFrame:
    """key, n and the smallest owner of each window, for segments (with their number of places n) that come by route, all of one route in a row."""

    def solve(segments: list[str], owners: list[int], places: list[int]) -> pa.RecordBatch:
        raw = [s.encode() for s in segments]
        least, windows = smallest_owners(raw, np.array(owners, np.int64), window)
        return pa.RecordBatch.from_arrays([digests(raw), pa.array(places, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows)]), pa.int32()), pa.array(least))], names=["key", "n", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: list[str] = []
        owners: list[int] = []
        places: list[int] = []
        size, last = 0, None
        for batch in batches:
            for route, segment, owner, n in zip(*(batch.column(c).to_pylist() for c in ("route", "segment", "owner", "n")), strict=True):
                if size >= SHARD_BYTES and route != last:
                    yield solve(segments, owners, places)
                    segments, owners, places, size = [], [], [], 0
                segments.append(segment)
                owners.append(owner)
                places.append(n)
                size, last = size + len(segment), route
        if segments:
            yield solve(segments, owners, places)

    return distinct.mapInArrow(run, "key binary, n bigint, least array<bigint>")


def _kept(rows: DataFrame, window: int) -> DataFrame:
    """Keys, n_removed, spans and kept_sha256 of texts with the starts of windows to remove."""
    schema = pa.schema([("_id", pa.int64()), ("_text_hash", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for i, t, text, starts in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "_text", "starts")), strict=True):
                places = [m.span() for m in WORD.finditer(text)]
                gone = np.zeros(len(places) + 1, np.int64)
                for s in {x for part in starts for x in part}:
                    gone[s] += 1
                    gone[s + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = " ".join(text[a:b] for (a, b), g in zip(places, gone, strict=True) if not g)
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                # a span goes up to the next word that stays
                spans = [{"start": places[a][0], "end": places[b][0] if b < len(places) else len(text)} for a, b in turns.reshape(-1, 2)]
                out.append((i, t, int(gone.sum()), spans, hashlib.sha256(kept.encode()).hexdigest()))
            yield arrow_rows(out, schema)

    return rows.mapInArrow(run, "_id long, _text_hash long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def repeated_passages(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _text_hash, n_words, n_removed, spans (code points, end exclusive) and kept_sha256 (of the kept words, joined by a blank) of every row.

    A word is removed if a window of `min_words` words over it also starts in a document with a smaller id; windows
    are judged on the input. Ids are whole numbers. Null text has no words. A row with a null id neither
    loses words nor takes them. Repeated rows get the same result each; rows of one id with other texts are judged each
    by its own. An empty table gives no rows; further columns are left out.
    """
    if min_words < RUN:
        raise ValueError(f"at least {RUN} words")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_text_hash", F.xxhash64("_text"))
    named = rows.where(F.col("_id").isNotNull())
    key = F.xxhash64(*KEYS).alias("_key")  # of two documents with one key each gets the other's anchors too, in vain
    anchors = _anchors(named.select("_text", key), min_words)
    shared = staged(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "n", (F.col("n") > HOT).alias("hot")), "anchors")
    digest = F.unhex(F.sha2("_text", 256))
    firsts = staged(named.groupBy(digest.alias("_digest")).agg(F.min(F.struct(*KEYS)).alias("f")).select("f.*"), "firsts")
    lists = hot_join(anchors, shared.drop("n"), ["anchor"], hot_keys(shared, ["anchor"]), by="_key").groupBy("_key").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("plain"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    wanted = firsts.select("*", key).join(lists, "_key").drop("_key")
    candidates = staged(named.join(wanted, KEYS), "candidates")
    discard(shared)
    distinct = _segments(candidates, min_words, True).groupBy("route", "segment").agg(F.min("_id").alias("owner"), F.count("*").alias("n"))
    shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    owned = staged(_owned(distinct.repartition(shards, "route").sortWithinPartitions("route"), min_words), "owned")
    # a passage in a third of all documents is one key: its places are dealt out
    places = hot_join(_segments(candidates, min_words, False), owned.drop("n"), ["key"], hot_keys(owned, ["key"]), by="_id")
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("_id"), i + F.col("first"))), lambda x: x.isNotNull())
    cut = places.select(*KEYS, starts.alias("starts")).where(F.size("starts") > 0).groupBy(*KEYS).agg(F.collect_list("starts").alias("starts"))
    cut = staged(cut, "cut")  # so that the segments' shuffles are over before texts move again
    discard(owned)
    removed = _kept(candidates.select(*KEYS, "_text").dropDuplicates(KEYS).join(cut, KEYS), min_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = [words_of(t) for t in batch.column("_text").to_pylist()]
            made = [pa.array(map(len, words), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary()), pa.array(map(len, batch.column("_text").to_pylist()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), *made], names=[*KEYS, "n_words", "_whole", "_length"])

    every = rows.mapInArrow(count, "_id long, _text_hash long, n_words long, _whole binary, _length long")
    joined = every.join(firsts.withColumn("_first", F.lit(True)), KEYS, "left").join(removed, KEYS, "left")
    copy = F.col("_first").isNull() & F.col("_id").isNotNull() & (F.col("n_words") >= min_words)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_length").alias("end")))
    return joined.select(
        F.col("_id").alias(id_col), "_text_hash", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, everything).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("_whole")))).alias("kept_sha256"),
    )


def remove_passages(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of docs, all columns, without their repeated passages and with the length corrected; rows left without any word go."""
    found = repeated_passages(docs, min_words, id_col, text_col).where("n_removed > 0").select(F.col(id_col).alias("_id"), "_text_hash", "n_words", "n_removed", "spans").dropDuplicates(KEYS)
    # rows travel as one column, so that no name of theirs can clash
    text = F.col(f"row.{text_col}")
    keyed = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.col(f"row.{id_col}").cast("long").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_hash"))
    both = keyed.join(found, KEYS, "left").where(F.coalesce(F.col("n_words") > F.col("n_removed"), F.lit(True))).withColumn("whole", text)
    # what stays lies between the spans
    kept = F.expr("aggregate(spans, struct(0L as at, '' as kept), (a, s) -> struct(s.end as at, concat(a.kept, substring(whole, int(a.at) + 1, int(s.start - a.at))) as kept), a -> concat(a.kept, substring(whole, int(a.at) + 1)))")
    uncut = F.col("spans").isNull()
    row = F.col("row").withField(text_col, F.when(uncut, text).otherwise(kept))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        row = row.withField(length_col, F.when(uncut, F.col(f"row.{length_col}")).otherwise(F.length(kept).cast(kind)))
    return both.select(row.alias("row")).select("row.*")
