"""Words that a sum of powers can't tell apart, and hashes that say too much: what is reported follows from the words."""

import numpy as np
import pytest
from test_llm_operators import brute_components, near_copies

from quarterbook.llm import jaccard_join, substring_dedup, word_hashes
from quarterbook.llm.jaccard_join import similar_components
from quarterbook.llm.substring_dedup import repeated_passages

A = "".join("ab"[i.bit_count() % 2] for i in range(1024))
B = A.translate(str.maketrans("ab", "ba"))


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize("letters", [64, 1024, 8192])
def test_letters_that_change_places(spark, letters):
    long = [(w * 8)[:letters] if letters > 1024 else w[:letters] for w in (A, B)]
    tail = " ".join(f"w{i}" for i in range(12))
    assert {r.n_removed for r in repeated_passages(table(spark, *(f"{w} {tail}" for w in long))).collect()} == {0}
    four = " ".join(f"w{i}" for i in range(4))
    assert {(r.doc_id, r.component_id) for r in similar_components(table(spark, *(f"{w} {four}" for w in long))).collect()} == {(1, 1), (2, 2)}


def test_words_that_change_places(spark):
    a, b = (" ".join(w) for w in (A, B))  # two words in an order that sums of powers can't tell
    h, *_ = word_hashes.word_hashes([a, b])
    assert len(np.unique(word_hashes.runs(h[:1024], 1024))) == 1 and word_hashes.runs(h[:1024], 1024) != word_hashes.runs(h[1024:], 1024)
    got = {r.doc_id: r.n_removed for r in repeated_passages(table(spark, a, b)).collect()}
    windows = {tuple(A[k : k + 13]) for k in range(1012)}
    gone = {x for k in range(1012) if tuple(B[k : k + 13]) in windows for x in range(k, k + 13)}
    assert got == {1: 0, 2: len(gone)}


def test_weak_hashes_change_no_result(spark, monkeypatch):
    """With hashes of one bit everything meets, and nothing is reported that differs."""
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    texts += [texts[0].replace("a39", "other"), texts[1] + " more"]
    weak = lambda f: lambda *a: f(*a) & np.uint64(1)
    monkeypatch.setattr(word_hashes, "_of_words", weak(word_hashes._of_words))
    h, *_ = word_hashes.word_hashes(texts)
    assert set(h.tolist()) == {0, 1}
    windows = [" ".join(f"w{k}" for k in range(13)), " ".join(f"v{k}" for k in range(13))]
    least, n = substring_dedup.smallest_owners([w.encode() for w in windows], np.array([1, 2]), 13)
    assert least.tolist() == [1, 2] and n.tolist() == [1, 1]
    sets = [np.arange(10), np.arange(10)]
    assert jaccard_join.joining_links(sets, lambda i, j: False) == [] and len(jaccard_join.joining_links(sets)) == 1


W1, W2 = "tf]35#&\":nf7^w^#", "af;?c9y6*$$d0`5b"  # two words with one hash


def test_words_with_one_hash(spark):
    h, *_ = word_hashes.word_hashes([W1, W2])
    assert len(set(h.tolist())) == 1
    tail = "a b c d"
    rows = [(1, W1), (2, W2), (3, f"{W1} {tail} e"), (4, f"{W2} {tail} e"), (5, f"{W1} {tail} {W2} {tail}"), (6, f"{W2} {tail} {W1} {tail}")]
    got = {tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and (5, 6, 5) in got


@pytest.mark.parametrize("bits", [1, 3])
def test_components_by_very_short_hashes(spark, sf_dir, bits):
    """The whole operator with two or eight hashes for all shingles: every set meets every other, and the result is that of the words."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 3000").collect()][:90]
    rows += [(1000 + i, t) for i, t in near_copies(40, 5, 9)] + [(2000, rows[0][1]), (2001, rows[0][1].upper()), (2002, ""), (2003, None), (2004, "one two"), (2005, "two one")]
    got = {tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()}
    assert got == brute_components(rows)


def test_ids_that_are_joined_give_the_same(spark, sf_dir, monkeypatch):
    from quarterbook.llm._common import read_table

    docs = read_table(spark, sf_dir, "documents")
    few = {tuple(r) for r in similar_components(docs).collect()}
    monkeypatch.setattr(jaccard_join, "FEW_IDS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2000)
    assert {tuple(r) for r in similar_components(docs).collect()} == few
