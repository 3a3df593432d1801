"""Near-duplicate removal by rows, and the join on families that are close to the bound."""

import random

from tests.llm import brute
from weftgraph.llm import jaccard

WORDS = [f"w{i}" for i in range(400)]


def text(*parts):
    return " ".join(parts)


def test_decides_by_rows(spark):
    x, y, z = (text(*WORDS[i:i + 40]) for i in (0, 50, 100))
    near = text(*WORDS[0:39], "other")
    rows = [(5, x, "a"), (5, y, "a"), (1, z, "b"), (2, z, "b"), (2, near, "c"), (3, near, "c"), (None, z, "d"), (None, text(*WORDS[200:240]), "e"), (None, text(*WORDS[200:240]), "f"),
            (7, None, "g"), (7, None, "g"), (8, "", "h"), (7, "", "i"), (9, text(*WORDS[300:340]), "j"), (9, text(*WORDS[300:340]), "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    found = sorted(map(tuple, jaccard.without_copies(docs).collect()), key=str)
    kept = [(5, y, "a"), (1, z, "b"), (2, near, "c"), (8, "", "h"), (9, text(*WORDS[300:340]), "j")]
    assert [r for r in found if r[0] in (1, 2, 3, 5, 8, 9)] == sorted(kept, key=str)  # x (5) is a near copy of near (2)
    assert len([r for r in found if r[0] is None]) == 1 and len([r for r in found if r[0] == 7]) == 1
    assert jaccard.without_copies(docs.limit(0)).collect() == []
    assert jaccard.without_copies(docs).columns == docs.columns


def family(seed, size, changed):
    """Copies of one text with some words replaced."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(200)]
    out = []
    for i in range(size):
        words = list(base)
        for at in r.sample(range(200), r.choice(changed)):
            words[at] = f"n{seed}x{i}x{at}"
        out.append(" ".join(words))
    return out


def test_large_family_gives_few_pairs(spark, monkeypatch):
    made = []
    plain = jaccard._links

    def counted(pairs, *more):
        made.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(jaccard, "_links", counted)
    texts = family(1, 600, [2, 3, 4]) + family(2, 150, [9, 10])  # the second one's links are few or none
    docs = list(enumerate(texts))
    found = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 4, 85)
    assert sorted(map(tuple, found.collect())) == sorted(brute.components(docs, 4, 85))
    assert sum(made) < 30 * len(texts)
