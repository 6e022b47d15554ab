"""Best-fit packing of token sequences, planned on a histogram of lengths.

Documents become pieces of at most `length` ids. The number of pieces of each length (at most `length`
numbers, whatever the size of the corpus) goes to the driver, where best-fit-decreasing places counts rather
than documents: all open sequences with the same room form one run, and a run takes as many equal pieces as
fit before the next run is touched. The plan is a table of slot ranges; pieces take their slots by joining on
their rank within their length.
"""

from __future__ import annotations

import array
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ranked, slices, staged

END_OF_TEXT = "<|endoftext|>"
_ENCODERS: dict = {}


def _encoder(rank_file: str):
    import base64

    import public_tokenizers
    import tiktoken

    if rank_file not in _ENCODERS:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the rank file leaves out the end-of-text string, which the tokenizer has as the id after the ranks
        _ENCODERS[rank_file] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
    return _ENCODERS[rank_file]


def token_bytes(text: str, rank_file: str) -> bytes:
    """The text's ids, each as an unsigned 32-bit integer; they are those of the tokenizer of the same vocabulary (byte_bpe_50k.json)."""
    return _encoder(rank_file).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % length or length
    return [(0, first)] + [(s, length) for s in range(first, n, length)] if n > length else [(0, n)]


def pieces(docs: DataFrame, rank_file: str, length: int = 2048, end_id: int = 0, payload: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, and ids (array) or, with payload="crc32", ids_crc32 (of little-endian 32-bit ids)."""
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, piece int, start long, length long, " + ("ids array<int>" if payload == "ids" else "ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = array.array("I", [end_id]).tobytes()
        for batch in slices(batches, text_col):
            keys, piece, start, size, last, rows = batch.column(id_col), [], [], [], [], []
            for row, text in enumerate(batch.column(text_col).to_pylist()):
                ids = token_bytes(text or "", rank_file) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, length)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append(row), piece.append(k), start.append(s), size.append(n)
                    last.append(array.array("I", own).tolist() if payload == "ids" else zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(last, pa.list_(pa.int32()) if payload == "ids" else pa.int64())],
                names=[id_col, "piece", "start", "length", "ids" if payload == "ids" else "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: (length, first rank, end rank, pieces in each sequence, first sequence, offset of the first) ranges."""
    ranges: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # the rooms that open sequences have, in order
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first sequence, number)
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append((first, n))

    for length in sorted((k for k, n in counts.items() if n and k), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # nothing has room: open as many sequences as the rest needs
                first, n, room = opened, -(-left // (capacity // length)), capacity
                opened += n
            else:
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                ranges.append((length, rank, rank + full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and 0 < left < each:
                ranges.append((length, rank, rank + left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return ranges


def best_fit_pack(docs: DataFrame, rank_file: str, length: int = 2048, end_id: int = 0, payload: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence_id and offset; sequences are gapless from offset 0.

    A document is its ids and then `end_id`; only one longer than `length` is cut, its first piece being the
    shorter. Null and empty text is the end id alone. Repeated rows are packed each; an empty table gives no
    rows; further columns are left out. `payload` as in pieces().
    """
    spark = docs.sparkSession
    held = staged(pieces(docs, rank_file, length, end_id, payload, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}
    # one row for each range of slots: bounded by the lengths and the runs they meet, not by the documents
    slots = spark.createDataFrame(plan(counts, length), "length long, _from long, _to long, _each long, _sequence long, _offset long")
    placed = ranked(held, ["length"], ["_row"], "_rank").join(F.broadcast(slots), "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        id_col, "piece", "start", "length", "ids" if payload == "ids" else "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )
