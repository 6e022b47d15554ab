"""Hashes of words, runs of words and the least run in a window, in numpy; digests of stretches of words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

PRIME = np.uint64(0x9E3779B185EBCA87)
LONG = 256  # bytes; longer words are hashed one by one
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _step(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A state of 64 bits with one more part: no sum of the parts, so parts that change places or signs don't cancel out."""
    return mixed((h ^ part) * PRIME)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; of all words together if they are fewer."""
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _step(out, h[k : k + len(out)])
    return out


def _of_words(whole: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, eight at a time, all words side by side."""
    size = end - start
    parts = np.ndarray(len(whole) + 1, "<u8", whole + bytes(8), strides=(1,))  # the eight bytes from each place on
    h = _step(size.astype(np.uint64) * PRIME, parts[start] & _MASKS[np.minimum(size, 8)])
    live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        left = size[live] - at
        h[live] = _step(h[live], parts[start[live] + at] & _MASKS[np.minimum(left, 8)])
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(blake2b(whole[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(texts: list[str | bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts in a row, the number of words of each text; the texts' bytes with each word's start and end in them.

    Hashes serve to find what may be equal; what is reported is compared by its words or by digests of them.
    """
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode() for t in texts]
    whole = b"\n".join([b"", *raw, b""])  # a blank before the first word and after the last one
    if lower:
        whole = whole.lower()
    b = np.frombuffer(whole, np.uint8)
    blank = (b - np.uint8(9) <= 4) | (b == 32)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # turns: start, end, start, ...
    start, end = edge[::2], edge[1::2]
    borders = 1 + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, borders)]))
    return _of_words(whole, start, end), counts, whole, start, end


def least_of(g: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` values in a row, by doubling."""
    reach = 1
    while reach * 2 <= span:
        g = np.minimum(g[:-reach], g[reach:])
        reach *= 2
    return np.minimum(g[: len(g) - (span - reach)], g[span - reach :]) if reach < span else g


def anchored(h: np.ndarray, counts: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, text, first window and number of windows: windows in a row whose least run of `size` words is the same.

    h has the words of texts of `counts` words. The anchor is that run's hash: it depends on a window's words
    alone, so equal windows have equal anchors.
    """
    if len(h) < window:
        return np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3
    least = least_of(runs(h, size), window - size + 1)
    text = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    ends = np.cumsum(counts)
    at = np.flatnonzero(np.arange(len(least)) + window <= ends[text])
    least, text = least[at], text[at]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
    n = np.diff(np.concatenate([first, [len(at)]]))
    text = text[first]
    return least[first].view(np.int64), text, at[first] - (ends - counts)[text], n


def joined(whole: bytes, opens: np.ndarray, closes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words of each stretch, joined by one blank."""
    return [b" ".join(whole[a:b].split()) for a, b in zip(opens[begin].tolist(), closes[end - 1].tolist(), strict=True)]


def digests(stretches: list[bytes]) -> pa.Array:
    """16 bytes of a cryptographic digest of each stretch: equal for equal words only."""
    return pa.array([blake2b(s, digest_size=16).digest() for s in stretches], pa.binary())
