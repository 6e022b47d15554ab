"""SentencePiece encoding and decoding with merge-type vocabularies.

Symbols of a word are merged by an agenda of adjacent pairs ordered by score, then by place. No piece holds a
word mark after anything else or a line break, so a text falls into words that merge on their own; their ids
are kept for later words. The new words of an Arrow slice are merged together in numpy, one agenda entry of every
word in each round; words of over SHORT symbols have a heap each. Every word that is merged is checked in its
slice against the sentencepiece library, and so is the first whole text of each slice, encoding and decoding.
"""

from __future__ import annotations

import array
import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import slices

MARK = "▁"
CACHED = 400_000
SHORT = 64
NEVER = 1 << 30
_CODECS: dict[str, Codec] = {}
# the library has one replacement character for each byte that is not text
codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


class Codec:
    """Encoding and decoding by one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.of = {p: i for i, p in enumerate(pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        self.score = {p: lib.get_score(i) for p, i in self.of.items()}
        self.ends = lib.bos_id(), lib.eos_id()
        # words are cut before a mark and around line breaks; the vocabulary must never join over such a cut
        inner = [p for p in self.of if re.search(f"[^{MARK}]{MARK}|\n.|.\n", p, re.S)]
        if inner or not all(lib.is_byte(i) for i in self.bytes_ids):
            raise ValueError(f"not a merge vocabulary of words with byte fallback: {inner[:3]}")
        self.plain = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.marked = {i for p, i in self.of.items() if p[0] == MARK}
        for b, i in enumerate(self.bytes_ids):
            self.plain[i] = bytes([b])
        self.split = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.known: dict[str, bytes] = {}
        self._pairs()

    def _pairs(self) -> None:
        """The table of pairs that merge, as sorted keys: symbol numbers of both sides -> rank by score, number of the whole."""
        self.symbol = {c: k for k, c in enumerate(dict.fromkeys([*self.of, *(c for p in self.of for c in p)]))}
        order = {s: k for k, s in enumerate(sorted({*self.score.values()}, reverse=True))}
        rows = [((self.symbol[p[:k]] << 20) | self.symbol[p[k:]], order[self.score[p]], self.symbol[p]) for p in self.of for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        rows.sort()
        keys, ranks, wholes = zip(*rows, strict=True)
        self.pair_key, self.pair_rank, self.pair_whole = np.array(keys, np.int64), np.array(ranks, np.int64), np.array(wholes, np.int64)
        # ids of a symbol that is left: a piece's own, or bytes
        self.spelled = [[self.of[c]] if c in self.of else self._as_bytes(c) for c in self.symbol]

    def _as_bytes(self, symbol: str) -> list[int]:
        return [self.bytes_ids[b] for b in symbol.encode()]

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_whole[at]

    def merged_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merged() of many short words, (all ids, number of each word's): in each round every word takes its best pair, the leftmost of equal ones."""
        symbol = self.symbol
        odd: dict[str, int] = {}  # characters outside the vocabulary, numbered after it
        flat = [symbol[c] if c in symbol else odd.setdefault(c, len(symbol) + len(odd)) for c in "".join(words)]
        sym = np.array(flat, np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, whole = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
        joined = word[:-1] == word[1:]
        r, w = self._found(sym[:-1], sym[1:])
        rank[:-1], whole[:-1] = np.where(joined, r, NEVER), w
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.concatenate([starts, [len(sym)]]))
            live = best < NEVER
            if not live.all():  # words without a pair left are ready
                on = np.repeat(live, size)
                done_word.append(word[~on])
                done_sym.append(sym[~on])
                sym, word, rank, whole = sym[on], word[on], rank[on], whole[on]
                if not len(sym):
                    break
                best, size = best[live], size[live]
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            hits = np.flatnonzero(rank == np.repeat(best, size))
            at = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            sym[at] = whole[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one symbol of each word before it went
            sym, word, rank, whole = sym[stay], word[stay], rank[stay], whole[stay]
            for k in (at - 1, at):  # the pairs that the new symbol is in
                k = k[(k >= 0)]
                new, new_whole = np.full(len(k), NEVER), np.zeros(len(k), np.int64)
                inside = np.flatnonzero(k + 1 < len(sym))
                inside = inside[word[k[inside]] == word[k[inside] + 1]]
                new[inside], new_whole[inside] = self._found(sym[k[inside]], sym[k[inside] + 1])
                rank[k], whole[k] = new, new_whole
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        word, sym = word[order], np.concatenate(done_sym)[order]
        spelled = self.spelled + [self._as_bytes(c) for c in odd]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        flat = np.fromiter((i for ids in spelled for i in ids), np.int64, size.sum())
        first, size = (np.cumsum(size) - size)[sym], size[sym]
        ids = flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return ids, np.bincount(word, size, len(words)).astype(np.int64)

    def merged(self, word: str) -> list[int]:
        """The ids of one word, by the agenda."""
        score, symbols = self.score, list(word)
        if len(symbols) > 1:
            after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
            agenda = []
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None:
                    agenda.append((-s, i, len(symbols[i]), i + 1))
            # equal scores: the left pair first; the size tells whether the pair is still what it was
            agenda = [(s, i, len(symbols[i]) + len(symbols[j]), j) for s, i, _, j in agenda]
            heapq.heapify(agenda)
            n = len(symbols)
            while agenda:
                _, i, size, j = heapq.heappop(agenda)
                if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size or after[i] != j:
                    continue
                symbols[i] += symbols[j]
                symbols[j] = ""
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    s = score.get(symbols[i] + symbols[k])
                    if s is not None:
                        heapq.heappush(agenda, (-s, i, len(symbols[i]) + len(symbols[k]), k))
                k = before[i]
                if k >= 0:
                    s = score.get(symbols[k] + symbols[i])
                    if s is not None:
                        heapq.heappush(agenda, (-s, k, len(symbols[k]) + len(symbols[i]), i))
        ids = []
        for s in symbols:
            if s:
                at = self.of.get(s)
                ids.extend([at] if at is not None else self._as_bytes(s))
        return ids

    def _learn(self, new: set[str]) -> None:
        """Merges new words and holds them against the library, 64 at a time with line breaks around them."""
        words = [w for w in new if len(w) <= SHORT]
        ids, size = self.merged_together(words)
        if len(words) < len(new):
            long = [w for w in new if len(w) > SHORT]
            own = [self.merged(w) for w in long]
            words, ids = words + long, np.concatenate([ids, *map(np.array, own)]).astype(np.int64)
            size = np.concatenate([size, [len(i) for i in own]])
        ends = np.cumsum(size)
        # the library's answer opens each lot with a mark, and then has a line break before each word
        lots = self.library.encode(["\n" + "\n".join(words[i : i + 64]) for i in range(0, len(words), 64)], num_threads=1)
        theirs = np.fromiter((i for lot in lots for i in lot[1:]), np.int64)
        if not np.array_equal(theirs, np.insert(ids, ends - size, self.bytes_ids[10])):
            bad = next(w for w, e, n in zip(words, ends, size, strict=True) if self.library.encode("\n" + w)[2:] != ids[e - n : e].tolist())
            raise ValueError(f"other ids than the library's for {bad[:100]!r}")
        packed = ids.astype("<u4").tobytes()
        self.known.update(zip(words, map(packed.__getitem__, map(slice, (4 * (ends - size)).tolist(), (4 * ends).tolist()))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, with begin and end, as native unsigned 32-bit integers."""
        parts = [self.split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        new = set().union(*parts).difference(self.known) if parts else set()
        if new:
            self._learn(new)
        first, last = (array.array("I", [i]).tobytes() for i in self.ends)
        get = self.known.__getitem__
        out = [first + b"".join(map(get, p)) + last for p in parts]
        for w in [w for w in new if len(w) > SHORT]:
            del self.known[w]  # long ones seldom come again
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one blank before the first piece is the mark that encoding puts there. Byte ids that aren't text
        become replacement characters, not always as many as the library has; encoding gives no such ids."""
        text = b"".join(map(self.plain.__getitem__, ids))
        first = next((i for i in ids if self.plain[i]), None)
        return (text[1:] if first in self.marked else text).decode("utf-8", "each_byte")


def codec(model_file: str) -> Codec:
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_decode(docs: DataFrame, model_file: str, output: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and ids (array) with decoded (string), or with output="sha256" their digests.

    ids have begin and end; null text counts as empty. An id outside the library's answer is an error that
    names the word. Repeated rows come each; an empty table gives no rows; further columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["ids", "decoded"] if output == "ids" else ["ids_sha256", "decoded_sha256"]
    kinds = [pa.list_(pa.int32()), pa.string()] if output == "ids" else [pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in slices(batches, text_col):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            packed = own.encode(texts)
            ids = [array.array("I", p).tolist() for p in packed]
            decoded = [own.decode(i) for i in ids]
            if own.library.encode(texts[0], add_bos=True, add_eos=True) != ids[0] or own.library.decode(ids[0]) != decoded[0]:
                raise ValueError(f"other ids or text than the library's for {texts[0][:100]!r}")
            if output == "ids":
                last = [ids, decoded]
            else:
                last = [[hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(d.encode()).hexdigest() for d in decoded]]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(i) for i in ids], pa.int64()), *map(pa.array, last, kinds)], names=[id_col, "n_tokens", *names])

    spelled = "ids array<int>, decoded string" if output == "ids" else "ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, {spelled}")
