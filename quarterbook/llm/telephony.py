"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM by blocks, resampled to linear PCM.

Media are WAV files of one channel in a binary column. Companded bytes are expanded by tables of 256 entries; the
blocks of all ADPCM files of an Arrow slice are decoded side by side, one nibble position of every block at a time. The
resampled PCM is a column like any other: it is written, and figures of it come from the samples read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import slices

CODECS = ("mulaw", "alaw", "adpcm")
RATE = 8000
BLOCK = 64  # bytes of an ADPCM block, and the unit to which payloads are filled up
# Fixed values of the formats: format tags of WAV files, and IMA's step sizes and index changes.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    part, low = (code >> 4) & 7, (code & 15).astype(np.int32) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part.astype(np.int32) - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (rows of bytes): the header's sample, then one for each nibble, low ones first."""
    head = blocks[:, :2].copy().view("<i2").astype(np.int32)[:, 0]
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = value = head
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k, column in enumerate(body):
        for nibble, at in ((column & 15, 1 + 2 * k), (column >> 4, 2 + 2 * k)):
            step = STEPS[index]
            change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
            value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + MOVES[nibble], 0, len(STEPS) - 1)
            out[:, at] = value
    return out


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample holds to its end."""
    if rate == target or not len(samples):
        return samples
    at = np.arange(len(samples) * target // rate, dtype=np.int64) * rate
    left, part = at // target, at % target
    x = samples.astype(np.int64)
    right = np.minimum(left + 1, len(x) - 1)
    return (x[left] + (x[right] - x[left]) * part // target).astype(np.int16)


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file whose data are the payload, unchanged."""
    if codec == "adpcm":
        each = 1 + 2 * (BLOCK - 4)
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // each, BLOCK, 4, 2, each)
        samples = len(payload) // BLOCK * each
    else:
        form, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0), len(payload)
    chunks = b"".join(struct.pack("<4sI", n, len(b)) + b + b"\0" * (len(b) % 2) for n, b in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data of a WAV file; chunks of other names are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((c for c, t in TAGS.items() if t == tag), "")
            if not codec or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels")
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def padded(raw: bytes) -> bytes:
    """Zeros up to a positive multiple of BLOCK."""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, codec and media: each text's UTF-8 bytes, filled up with zeros, as the samples of a WAV file.

    The codec follows from the payload's crc32, so equal texts give equal files. Null text counts as empty
    (64 zeros); repeated rows come each; an empty table gives no rows; further columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            raw = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            full = [padded(r) for r in raw]
            codecs = [CODECS[zlib.crc32(p) % len(CODECS)] for p in full]
            files = list(map(wav, full, codecs))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, raw), pa.int64()), pa.array(codecs, pa.string()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "codec", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, codec string, media binary")


def decoded_files(files: list[bytes], target: int) -> list[tuple[str, bytes, np.ndarray]]:
    """Codec, payload and resampled PCM of each file; ADPCM blocks of all of them are decoded together."""
    read = [read_wav(f) for f in files]
    blocks = [np.frombuffer(p, np.uint8).reshape(-1, BLOCK) for c, _, p in read if c == "adpcm"]
    ready = iter(np.split(adpcm_blocks(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1]) if blocks else [])
    return [(c, p, resampled(next(ready).ravel() if c == "adpcm" else TABLES[c][np.frombuffer(p, np.uint8)], rate, target)) for c, rate, p in read]


_SPELLED = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _made(table: DataFrame, carried: tuple[str, ...], by: str, outputs: dict[str, pa.DataType], rows_of: Callable[[pa.RecordBatch], list[tuple]]) -> DataFrame:
    """`carried` columns and what rows_of makes of each slice, cut by the bytes of column `by`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, by, 2 << 20):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows_of(batch), strict=True), outputs.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], names=[*carried, *outputs])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), *(f"{n} {_SPELLED[t]}" for n, t in outputs.items())])
    return table.mapInArrow(run, schema)


def decode_audio(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", target: int = 16000, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep` columns, codec, payload_bytes, payload_sha256, tail_crc32 (of the data read back), media_bytes, media_sha256 and pcm
    (16-bit little-endian samples at `target` a second).

    Files are those of store_audio, or any WAV file of one channel of these codecs with blocks of 64 bytes. Null
    media give nulls; a file that can't be read is an error; further columns are left out.
    """
    outputs = {"codec": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "pcm": pa.binary()}

    def rows_of(batch: pa.RecordBatch) -> list[tuple]:
        files = batch.column(media_col).to_pylist()
        done = iter(decoded_files([f for f in files if f is not None], target))
        rows = [(f, *next(done)) if f is not None else None for f in files]
        told = lambda f, c, p, x: (c, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), x.astype("<i2").tobytes())
        return [(None,) * len(outputs) if r is None else told(*r) for r in rows]

    return _made(media.select(id_col, *keep, media_col), (id_col, *keep), media_col, outputs, rows_of)


def features(audio: DataFrame, pcm_col: str = "pcm", codec_col: str = "codec") -> DataFrame:
    """All columns but pcm, and `feature`: the codec, and samples, peak, mean energy, changes of sign and crc32 of the stored PCM; null for null PCM."""

    def figures(codec: str, raw: bytes) -> str:
        x = np.frombuffer(raw, "<i2").astype(np.int32)
        energy = int(np.dot(x.astype(np.int64), x)) // max(1, len(x))
        turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        return f"{codec} samples={len(x)} peak={int(np.abs(x).max(initial=0))} energy={energy} turns={turns} pcm_crc32={zlib.crc32(raw)}"

    def rows_of(batch: pa.RecordBatch) -> list[tuple]:
        both = zip(batch.column(codec_col).to_pylist(), batch.column(pcm_col).to_pylist(), strict=True)
        return [(None if raw is None else figures(codec, raw),) for codec, raw in both]

    return _made(audio, tuple(c for c in audio.columns if c != pcm_col), pcm_col, {"feature": pa.string()}, rows_of)
