"""Secret scans over a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams that every match must hold. Texts are indexed
segment by segment (a slice of an Arrow batch): sorted pairs of trigram and text, in which a trigram's postings are a
range. A query's candidates come from intersecting and joining postings, and are verified by the expression; a
rule whose expression has no mandatory trigram scans all texts of the segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import slices

MOST_STRINGS = 64
SHIFT = 20  # bits of a text's number in its segment; slices() gives at most 2**16 texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # ASCII rules; what (?i:...) holds is in either case
    holds: Callable[[re.Match], bool] = lambda m: True


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of [0-9a-f] of 24 or more: no match starts inside a run, so short runs need no visit
)
#: From the header through the END line if that is the next line of dashes; else over header fields and base64 lines, of
#: which the last ones (a rest and a checksum) can be short.
PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*(?:-(?!----)[^-]*)*-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): [^\n\\]*)*"
    r"(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,}(?![A-Za-z0-9+/=]))*"
    r"(?:(?<=[A-Za-z0-9+/=]{16})(?:\s|\\[nr])+(?:[A-Za-z0-9+/]{4}){0,3}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|(?<=[A-Za-z0-9+/]{4}))(?![^\s\\]))?"
    r"(?:(?<=[A-Za-z0-9+/=]{4})(?:\s|\\[nr])+=[A-Za-z0-9+/]{4}(?![^\s\\]))?)"
)
MORE = (
    Rule("pem", PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE


# A query is True (any text), a trigram's code, or ("and" | "or", queries).
def _all(queries: list) -> object:
    kept = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any(queries: list) -> object:
    kept = list(dict.fromkeys(queries))
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_string(s: str) -> object:
    raw = s.encode()
    return _all([raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)])


def _class(items: list) -> set[str] | None:
    """The characters of a class in lower case; None if they are many or not listed."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 16:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 16 and all(c.isascii() for c in out) else None


def _strings(nodes) -> set[str] | None:
    """All strings that the nodes match, in lower case; None if they are many."""
    have = {""}
    for node in nodes:
        own = _node_strings(node)
        if own is None or len(have) * len(own) > MOST_STRINGS:
            return None
        have = {a + b for a in have for b in own}
    return have


def _node_strings(node) -> set[str] | None:
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        return _class(arg)
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}
    if op is C.SUBPATTERN:
        return _strings(arg[3])
    if op is C.BRANCH:
        own = [_strings(b) for b in arg[1]]
        return None if None in own or sum(map(len, own)) > MOST_STRINGS else set().union(*own)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4:
        once = _strings(arg[2])
        if once is not None and sum(len(once) ** k for k in range(arg[0], arg[1] + 1)) <= MOST_STRINGS:
            have, out = {""}, set()
            for k in range(arg[1] + 1):
                out |= have if k >= arg[0] else set()
                have = {a + b for a in have for b in once}
            return out
    return None


def _query(nodes) -> object:
    run, parts = {""}, []
    for node in [*nodes, None]:
        own = _node_strings(node) if node else None
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        parts.append(_any([_of_string(s) for s in sorted(run)]))
        run = own if own is not None else {""}
        if node and own is None:
            op, arg = node
            if op is C.SUBPATTERN:
                parts.append(_query(arg[3]))
            elif op is C.BRANCH:
                parts.append(_any([_query(b) for b in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
                parts.append(_query(arg[2]))
    return _all(parts)


def trigram_query(pattern: str) -> object:
    """The Boolean query over trigrams of lower-case bytes that holds for every text in which the pattern matches."""
    return _query(_parser.parse(pattern, re.A))


class Segment:
    """The inverted index of some texts: sorted (trigram, text) pairs of their bytes, ASCII letters in lower case."""

    def __init__(self, texts: list[str]):
        raw = [t.encode().lower() for t in texts]
        self.n = len(raw)
        b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        text = np.repeat(np.arange(self.n, dtype=np.int64), [len(r) for r in raw])
        if len(b) < 3:
            self.pairs = np.zeros(0, np.int64)
            return
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        pairs = (code << SHIFT | text[:-2])[text[:-2] == text[2:]]
        pairs.sort()
        self.pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs

    def find(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, int):
            a, b = np.searchsorted(self.pairs, [query << SHIFT, (query + 1) << SHIFT])
            return self.pairs[a:b] & ((1 << SHIFT) - 1)
        own = None
        for q in query[1]:
            if own is None:
                own = self.find(q)
            elif query[0] == "or":
                own = np.union1d(own, self.find(q))
            elif len(own):
                own = np.intersect1d(own, self.find(q), assume_unique=True)
        return own


def found_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of every text, by start and then by the order of rules."""
    compiled = [(r, re.compile(r.pattern, re.A), trigram_query(r.pattern)) for r in rules]
    index = Segment(texts)
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    for k, (rule, pattern, query) in enumerate(compiled):
        for i in index.find(query):
            out[i] += [(m.start(), k, rule.kind, m.end()) for m in pattern.finditer(texts[i]) if rule.holds(m)]
    return [[(kind, s, e) for s, _, kind, e in sorted(x)] for x in out]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, array<struct<kind, start, end>> in code points, end exclusive, of every row.

    Null text counts as empty; spans of one rule never overlap, those of different rules may. Repeated rows come
    each; an empty table gives no rows; further columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            spans = found_spans([t or "" for t in batch.column(text_col).to_pylist()], rules)
            made = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], span)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), made], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a note of the kind in place of each span, overlapping ones as one."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, all columns, with secrets taken out of the text (a null stays null) and its length corrected."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            done = [None if t is None else without(t, x) for t, x in zip(texts, found_spans([t or "" for t in texts], rules), strict=True)]
            columns = {n: batch.column(n) for n in names}
            columns[text_col] = pa.array(done, pa.string())
            if length_col in columns:
                old = columns[length_col]
                columns[length_col] = pa.array([n if d == t else len(d) for n, d, t in zip(old.to_pylist(), done, texts, strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)
