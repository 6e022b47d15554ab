"""A large group of near copies: links that are passed on grow with its documents, not with its pairs."""

import random

from test_llm_operators import brute_components

from quarterbook.llm import jaccard_join as j


def test_links_between_two_components_are_one(spark, monkeypatch):
    rng, base = random.Random(5), [f"w{k}" for k in range(200)]
    texts = []
    for i in range(240):  # with one, two or three words of 200 changed: many pairs link, and some centres reach few
        words = list(base)
        for k in range(1 + (i < 60) * 2 + (i % 3 == 0)):
            words[rng.randrange(5, 195)] = f"x{i}_{k}"
        texts.append(" ".join(words))
    given = []
    whole = j.components
    monkeypatch.setattr(j, "components", lambda links: given.append(links.distinct().count()) or whole(links))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {tuple(r) for r in j.similar_components(docs).collect()}
    assert found == brute_components(list(enumerate(texts)))
    assert sum(given) <= 2 * len(texts), given


def test_first_centres_that_reach_none_of_a_group(spark, monkeypatch):
    rng, base = random.Random(7), [f"w{k}" for k in range(200)]
    # the smallest ids, so the first centres: each shares half of what the group has, and is alike to none of it
    texts = [" ".join(base[k : k + 100]) for k in (0, 50, 100)]
    for i in range(240):
        words = list(base)
        words[rng.randrange(5, 195)] = f"x{i}"
        texts.append(" ".join(words))
    given = []
    whole = j.components
    monkeypatch.setattr(j, "components", lambda links: given.append(links.distinct().count()) or whole(links))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {tuple(r) for r in j.similar_components(docs).collect()}
    assert found == brute_components(list(enumerate(texts)))
    assert sum(given) <= 4 * len(texts), given
