"""Benchmark decontamination: a generalised suffix automaton of the test items, past which the words of documents stream.

Items are dealt to blocks of about BLOCK_WORDS words, so an automaton has a bounded size however large the benchmark is; each
block is one more pass, within a task, over the rows it has anyway. A document goes through the automaton only where pairs of neighbouring words all stand
in some item; there the longest match that ends at each word is tracked. A match of `window` words or more is a hit over all
its words, and so is a whole item that has fewer words than that.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import slices, staged

BLOCK_WORDS = 50_000  # words of items in one automaton (two states and three edges a word at most)
PART_WORDS = 4_096  # longer items are held in parts that overlap by a window less one word
PASSES = 8  # blocks in one stage; beyond that the rows are staged
PAIR_BITS = 22
#: Lower-cases A-Z, and turns all that is in no word ([^\x00-\x2F\x3A-\x60\x7B-\x7F]+) into blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def folded_words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Automaton:
    """All substrings of some sequences of words: state 0 is empty; the longest of a state, its suffix link, edges by (state << 32 | word)."""

    def __init__(self, sequences: Sequence[Sequence[bytes]], names: Sequence[str], whole: Sequence[bool], window: int):
        self.window, self.words = window, {}
        self.longest, self.link = [0], [-1]
        after: list[dict[int, int]] = [{}]
        numbered = [[self.words.setdefault(w, len(self.words)) for w in s] for s in sequences]
        for s in numbered:
            last = 0
            for w in s:
                last = self._extended(after, last, w)
        self.edges = {state << 32 | w: to for state, own in enumerate(after) for w, to in own.items()}
        del after
        self.fewest = min([window, *(len(s) for s, w in zip(numbered, whole, strict=True) if w and s)])
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for s in numbered:
            self.pairs[self._pair(np.array(s[:-1], np.uint64), np.array(s[1:], np.uint64))] = True
        # the state of the last `window` words of a longer match
        self.at_window, order = [-1] * len(self.link), sorted(range(1, len(self.link)), key=self.longest.__getitem__)
        for i in order:
            if self.longest[i] >= window:
                self.at_window[i] = i if self.longest[self.link[i]] < window else self.at_window[self.link[i]]
        self.items: dict[int, set[str]] = defaultdict(set)  # by the state of a window
        short: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))  # by state and length: whole items
        for s, name, w in zip(numbered, names, whole, strict=True):
            state = 0
            for n, word in enumerate(s, 1):
                state = self.edges[state << 32 | word]
                if n >= window:
                    self.items[self.at_window[state]].add(name)
            if w and 0 < len(s) < window:
                short[state][len(s)].add(name)
        self.short = {state: sorted(own.items()) for state, own in short.items()}
        # the next state by suffix links, itself included, that is a whole item
        self.near = [-1] * len(self.link)
        for i in order:
            self.near[i] = i if i in self.short else self.near[self.link[i]]
        self.items = dict(self.items)

    def _extended(self, after: list[dict[int, int]], last: int, word: int) -> int:
        """The state of `last` with one more word."""
        longest, link = self.longest, self.link

        def split(state: int, to: int) -> int:
            """The part of state `to` that is no longer than `state` and one word, as a state of its own."""
            if longest[to] == longest[state] + 1:
                return to
            part = len(link)
            longest.append(longest[state] + 1), link.append(link[to]), after.append(dict(after[to]))
            link[to] = part
            while state >= 0 and after[state].get(word) == to:
                after[state][word] = part
                state = link[state]
            return part

        if word in after[last]:
            return split(last, after[last][word])
        new = len(link)
        longest.append(longest[last] + 1), link.append(0), after.append({})
        while last >= 0 and word not in after[last]:
            after[last][word] = new
            last = link[last]
        if last >= 0:
            link[new] = split(last, after[last][word])
        return new

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((a << np.uint64(32) | b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def hits(self, texts: Sequence[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Stretches of words (start, end) inside occurring windows and the items that have those, of each text that has any."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        get = self.words.get
        ids = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, int(counts.sum()))
        if not len(ids):
            return {}
        known = ids >= 0
        on = known[:-1] & known[1:] & self.pairs[self._pair(ids[:-1].view(np.uint64), ids[1:].view(np.uint64))]
        ends = np.cumsum(counts)
        on[(ends[(ends > 0) & (ends < len(ids))] - 1)] = False
        first = np.flatnonzero(known & np.concatenate([[True], ~on]))
        last = np.flatnonzero(known & np.concatenate([~on, [True]])) + 1
        likely = np.flatnonzero(last - first >= self.fewest)
        of = np.searchsorted(ends, first[likely], side="right")
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for k, i in zip(likely.tolist(), of.tolist(), strict=True):
            begin = int(first[k] - (ends[i] - counts[i]))
            stretches, items = self._streamed(ids[first[k] : last[k]].tolist())
            if stretches:
                held = out.setdefault(i, ([], set()))
                held[0].extend((a + begin, b + begin) for a, b in stretches)
                held[1].update(items)
        return out

    def _streamed(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        edges, link, longest, window = self.edges, self.link, self.longest, self.window
        state = length = 0
        stretches: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, word in enumerate(ids, 1):
            to = edges.get(state << 32 | word)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = edges.get(state << 32 | word)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= window:
                stretches.append((end - length, end))
                items |= self.items[self.at_window[state]]
            at = self.near[state]
            while at > 0:
                for n, names in self.short[at]:
                    if n <= length:
                        stretches.append((end - n, end))
                        items |= names
                at = self.near[link[at]]
        return stretches, items


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> list[Automaton]:
    """An automaton for each block of items."""
    schema = pa.schema([("item", pa.string()), ("whole", pa.bool_()), ("words", pa.int64()), ("text", pa.string())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = folded_words(text)
                for k in range(0, max(1, len(words) - window + 1), PART_WORDS):
                    own = words[k : k + PART_WORDS + window - 1]
                    rows += [(item, len(words) < window, len(own), b" ".join(own).decode())] * bool(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, schema, strict=True)], schema=schema)

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = staged(rows.mapInArrow(parts, "item string, whole boolean, words long, text string").distinct(), "items")
    n = max(1, -(-(held.agg(F.sum("words")).first()[0] or 0) // BLOCK_WORDS))
    out = []
    for block in range(n):
        own = held.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == block).toArrow()  # about BLOCK_WORDS words
        texts = [t.encode().split() for t in own.column("text").to_pylist()]
        out.append(Automaton(texts, own.column("item").to_pylist(), own.column("whole").to_pylist(), window))
    return out


def _marked(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """row (all columns of docs), _text, n_words, spans and items of every row of docs."""
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.coalesce(F.col(f"row.{text_col}"), F.lit("")).alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    sc = docs.sparkSession.sparkContext

    def scan(automaton):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                texts = [folded_words(t) for t in batch.column("_text").to_pylist()]
                spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for i, (found, names) in automaton.value.hits(texts).items():
                    whole = _marked([*((s["start"], s["end"]) for s in spans[i]), *found])
                    spans[i] = [{"start": a, "end": b} for a, b in whole]
                    items[i] = sorted({*items[i], *names})
                made = [pa.array(map(len, texts), pa.int64()), pa.array(spans, SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_text"), *made], names=["row", "_text", "n_words", "spans", "items"])

        return run

    for k, automaton in enumerate(_blocks(benchmark, window, item_col, item_text_col), 1):
        rows = rows.mapInArrow(scan(sc.broadcast(automaton)), rows.schema)
        if k % PASSES == 0:
            rows = staged(rows, "scanned")
    return rows


def _covered(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, spans (word numbers from 0, end exclusive) and items (ids as strings, sorted) of every row of docs.

    A window is `window` consecutive words of an item, or a whole item of fewer words; a document's word inside any occurrence of
    a window is hit. A null or empty text has no words and is never hit; null or empty items have no window. An item with a null id is listed as an
    empty string, items of one id as one. Repeated rows get the same result each, rows of one id with other texts each its own; an empty
    benchmark hits nothing, an empty table gives no rows. Further columns, of whatever name, are left out.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    found = _scanned(docs, benchmark, window, text_col, item_col, item_text_col)
    return found.select(F.col(f"row.{id_col}").alias(id_col), "n_words", _covered().alias("n_hit"), "spans", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_covered: float = 0.5, text_col: str = "text", length_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the stretches that contamination() finds and with the length corrected.

    A stretch goes up to the next word that stays. Rows of which more than `most_covered` of all words are hit go altogether. Rows without
    hits, those of null texts too, are unchanged.
    """
    found = _scanned(docs, benchmark, window, text_col, item_col, item_text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if spans:
                    raw = text.encode()
                    blank = np.frombuffer(b" " + raw.translate(FOLD) + b" ", np.uint8) == 32
                    start = np.flatnonzero(blank[:-1] & ~blank[1:])
                    start = np.append(start, len(raw)).tolist()
                    at, kept = 0, []
                    for s in spans:
                        kept.append(raw[at : start[s["start"]]])
                        at = start[s["end"]]
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), batch.column("spans")], names=["row", "kept", "spans"])

    held = found.where(_covered() <= F.col("n_words") * F.lit(float(most_covered))).select("row", "_text", "spans")
    schema = T.StructType([held.schema["row"], T.StructField("kept", T.StringType()), held.schema["spans"]])
    both, uncut = held.mapInArrow(cut, schema), F.size("spans") == 0
    row = F.col("row").withField(text_col, F.when(uncut, F.col(f"row.{text_col}")).otherwise(F.col("kept")))
    if length_col in docs.columns:
        row = row.withField(length_col, F.when(uncut, F.col(f"row.{length_col}")).otherwise(F.length("kept").cast(docs.schema[length_col].dataType)))
    return both.select(row.alias("row")).select("row.*")
