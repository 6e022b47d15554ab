"""Each stage of the pipeline against a plain version, on planted and odd rows; and on tables with nothing in them."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import WORD, rows_of

import corpus_pipeline as p
from quarterbook.llm import queries
from quarterbook.llm._common import read_table
from quarterbook.llm.quality import score_quality
from quarterbook.llm.secret_scan import RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, row string, spans string"


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rnd = np.random.default_rng(12)
    fresh = lambda n, c: " ".join(f"{c}{k}" for k in rnd.integers(0, 10**7, n))
    passage = fresh(60, "p")
    out = rows_of(spark, sf_dir)
    for k in range(6):  # a passage of 60 words in documents that differ otherwise, and one of 40, which stays
        out.append((400_000 + k, f"{fresh(80, 'a')}\n{passage} {fresh(30, 'b')}  {' '.join(passage.split()[:40])} {fresh(5, 'c')}", "en", "s", 1))
    out += [(400_010, passage, "en", "s", 1), (400_011, f"password = hunter2222 {fresh(20, 'd')}", "en", "s", None), (None, f"{fresh(50, 'e')} {passage}", None, None, None)]
    return [(*r, "x", "y", "z") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def shingles(text):
    w = [x.encode().lower() for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates(spark, docs, rows, sf_dir):
    one = list({(r[0], r[1]): None for r in rows})
    sets = [shingles(t) for _, t in one]
    parent = list(range(len(one)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(one)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(one):
        g = root(k) if sets[k] else ("alone", k)
        groups.setdefault(g, []).append((i is None, i or 0, k))
    got = p.ngram_jaccard_join(spark, docs, sf_dir)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert max(kept.values()) == 1 and len(kept) == len(groups)
    firsts = {g: min(m)[:2] for g, m in groups.items()}
    of = {x: root(k) if sets[k] else ("alone", k) for k, x in enumerate(one)}
    assert {of[x] for x in kept} == set(groups) and all((x[0] is None, x[0] or 0) == firsts[of[x]] for x in kept)


def test_passages(spark, docs, rows, sf_dir):
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {x for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        if len(gone) < len(w) or not w:
            want[i, " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = p.substring_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in got.collect()) == want
    planted = [r for r in got.collect() if r.doc_id in range(400_001, 400_006)]
    assert len(planted) == 5 and all(len(WORD.findall(r.text)) == 80 + 30 + 40 + 5 and r.n_chars == len(r.text) for r in planted)


def without(t):
    """A text with a note in place of each secret."""
    spans = sorted((m.start(), k, m.end()) for k, r in enumerate(RULES) for m in re.finditer(r.pattern, t, re.A) if r.holds(m))
    out, at = "", 0
    for s, k, e in spans:
        if s >= at:
            out += t[at:s] + f"[{RULES[k].kind}]"
        at = max(at, e)
    return out + t[at:]


def test_secrets(spark, docs, rows, sf_dir):
    got = p.secret_scans(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, None if t is None else without(t)) for i, t, *_ in rows)


def test_packing(spark, docs, rows, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = p.best_fit_packing(spark, docs, sf_dir).collect()
    want = Counter((i, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t, *_ in rows)
    whole, parts = Counter(), {}
    for r in got:
        parts.setdefault((r.sequence_id, r.offset), r)
        if r.length < 2048 and r.piece == 0 and not any(x.doc_id == r.doc_id and x.piece for x in got):
            whole[r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())] += 1
    assert len(parts) == len(got) and not whole - want


def test_run_from_end_to_end(spark, sf_dir):
    """All five stages, each in plain Python over what the plain one before it kept; only the classifier's scores are its own."""
    from tokenizers import Tokenizer

    docs = read_table(spark, sf_dir, "documents")
    scores = {r.doc_id: r.score for r in score_quality(docs, read_table(spark, sf_dir, "labels")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= 0.5}
    assert 0 < len(texts) < docs.count()

    sets, first = {i: shingles(t) for i, t in texts.items()}, {}
    for i in sorted(texts):
        near = {first[j] for j in first if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        least = min(near, default=i)
        first = {j: least if f in near else f for j, f in first.items()} | {i: least}
    texts = {i: t for i, t in texts.items() if first[i] == i}

    owner = {}
    for i in sorted(texts):
        w = WORD.findall(texts[i])
        for k in range(len(w) - 49):
            owner.setdefault(tuple(w[k : k + 50]), i)
    cut = {}
    for i, t in texts.items():
        spans = [m.span() for m in WORD.finditer(t)]
        w = [t[a:b] for a, b in spans]
        gone = {x for k in range(len(w) - 49) if owner[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        kept = t[: spans[0][0]] if spans else t
        for k, (a, _) in enumerate(spans):
            if k not in gone:
                kept += t[a : spans[k + 1][0] if k + 1 < len(spans) else len(t)]
        if not w or len(gone) < len(w):
            cut[i] = kept

    tokenizer, want = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), Counter()
    for i, t in cut.items():
        ids = [*tokenizer.encode(without(t), add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)] if len(ids) > 2048 else [0]
        want.update((i, k, s, tuple(ids[s : cuts[k + 1] if k + 1 < len(cuts) else None])) for k, s in enumerate(cuts))
    got = p.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in slots.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_nothing_in_and_nothing_out(spark, docs, sf_dir):
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
