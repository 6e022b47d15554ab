"""The pipeline's stages on null and repeated ids: what is found out about a text holds for its rows alone."""

import pytest

import corpus_pipeline as p
from quarterbook.llm._common import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def big(sf_dir):
    return sf_dir.replace("0.001", "0.01")


def test_a_rejected_text_takes_no_other_row_along(spark, big):
    docs = read_table(spark, big, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    plain = {r.doc_id for r in p.quality_classifier(spark, docs, big).collect()}
    assert 0 < len(plain) < len(rows)
    # ids without labels leave the model as it is: texts again under a null id, and under one id for all
    again = [(i, text, lang, str(doc_id), n) for doc_id, text, lang, _, n in rows for i in (None, 10_000_000)]
    kept = p.quality_classifier(spark, spark.createDataFrame(rows + again, SCHEMA), big).collect()
    for i in (None, 10_000_000):
        assert {int(r.source) for r in kept if r.doc_id == i} == plain


def test_a_near_copy_takes_no_other_row_along(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = b.replace("b39", "other")
    rows = [(3, b, "x", "", 1), (5, a, "x", "", 1), (5, near, "x", "", 1), (5, b, "x", "", 1), (5, a, "x", "", 1), (5, a, "y", "", 1)]
    rows += [(None, c, "x", "", 1), (None, c, "x", "", 1), (None, a, "x", "", 1), (7, "", "x", "", 0), (8, "", "x", "", 0), (8, None, "x", "", 0)]
    kept = p.ngram_jaccard_join(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    want = [(3, b, "x"), (5, a, "x"), (None, c, "x"), (7, "", "x"), (8, "", "x"), (8, None, "x")]
    assert sorted(map(str, ((r.doc_id, r.text, r.lang) for r in kept))) == sorted(map(str, want))


def test_only_what_is_likelier_bad_is_rejected(spark, big, monkeypatch):
    docs, labels = read_table(spark, big, "documents"), read_table(spark, big, "labels")
    scores = {r.doc_id: r.score for r in p.score_quality(docs, labels).collect()}
    between = {i for i, s in scores.items() if 0.5 <= s < 0.7}
    kept = {r.doc_id for r in p.quality_classifier(spark, docs, big).collect()}
    assert between and kept == {i for i, s in scores.items() if s >= 0.5} and len(kept) < len(scores)
    # nothing to fit on: no rows, null labels, or only ids that are never learned from
    for none in (labels.limit(0), labels.selectExpr("doc_id", "cast(null as int) as quality"), labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2")):
        monkeypatch.setattr(p, "read_table", lambda *_, none=none: none)
        assert p.quality_classifier(spark, docs, big).count() == docs.count()
