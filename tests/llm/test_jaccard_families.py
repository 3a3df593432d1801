"""The Jaccard join on families of a base, its supersets and its excerpts, against a comparison of all pairs."""

import random

import pytest

from tests.llm import brute
from weftgraph.llm import jaccard


def _families(percent, n_families=120):
    """Sets of single words: excerpts are the smallest sets of most words, so that supersets rarely meet their base as a column's smallest."""
    rng = random.Random(percent)
    texts = []
    for f in range(n_families):
        words = [f"f{f}w{i}" for i in range(rng.randint(40, 120))]
        texts.append(words)
        room = len(words) * (100 - percent) // percent
        for s in range(rng.randint(1, 3)):
            texts.append(words + [f"f{f}s{s}x{i}" for i in range(rng.randint(max(1, room // 2), max(1, room)))])
        texts += [rng.sample(words, rng.randint(8, max(9, len(words) // 2))) for _ in range(rng.randint(0, 3))]
    rng.shuffle(texts)
    return [(i, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [70, 80, 85])
def test_families(spark, percent):
    docs = _families(percent)
    found = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), 1, percent)
    assert sorted(map(tuple, found.collect())) == sorted(brute.components(docs, 1, percent))


def test_place_bound_of_a_contained_set():
    # percent 80: 90 n-grams inside 100 whose 10 own ones sort first; 13 n-grams lie in both prefixes
    cap = {n: jaccard.needed(n, 80) - jaccard.shared(80) + 13 for n in (90, 100)}
    assert all(jaccard._may_link(90, cap[90], pos, 100, cap[100], pos, 80) for pos in range(13))
