"""Blocks and interval search in this process, where their sizes can be made small."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import lexical, phrases
from weftgraph.llm.words import ALNUM, words_of


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


@pytest.mark.parametrize("seed", range(6))
def test_search_of_a_block(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(lexical, "STEP", r.choice([1, 3, 128]))
    n, terms = r.randrange(1, 120), 8
    impact = {(t, d): r.choice([5, 9, 100, 1000]) for t in range(terms) for d in range(n) if r.random() < 0.4}
    keys = np.array(sorted(t * n + d for t, d in impact), np.int64)
    block = lexical.Block(list(range(n)), keys, np.array([impact[k // n, k % n] for k in keys.tolist()], np.int64))
    for _ in range(20):
        asked = np.array(sorted(r.sample(range(terms), r.randrange(1, terms))), np.int64)
        weights = np.array([r.choice([0, 1, 3, 50]) for _ in asked], np.int64)
        k, least, tie = r.randrange(1, 12), r.choice([0, 0, 40, 5000]), r.randrange(0, n + 1)
        scores = [(sum(impact.get((t, d), 0) * w for t, w in zip(asked.tolist(), weights.tolist(), strict=True)), d) for d in range(n)]
        want = sorted(((s, d) for s, d in scores if s > 0 and (s > least or (s == least and d < tie))), key=lambda x: (-x[0], x[1]))[:k]
        found = sorted((x for x in block.search(asked, weights, k, least, tie) if x[0] > 0 and (x[0] > least or (x[0] == least and x[1] < tie))), key=lambda x: (-x[0], x[1]))[:k]
        assert found == want


def test_blocks_hold_every_posting_once(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randrange(0, 40))) if i % 5 else None for i in range(60)]
    lexicon = np.unique(words_of("a c e", ALNUM))
    number = {int(h): w for w in "ace" for h in words_of(w, ALNUM)}
    seen = {}
    for ids, n, doc, term, tf in lexical._blocks(iter([batch(texts[:31]), batch(texts[31:])]), lexicon):
        assert len(ids) <= 7 and len(n) == len(ids)
        names = ids.to_pylist()
        for d, t, c in zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True):
            seen[len(seen)] = (names[d], number[int(lexicon[t])], c)
    want = [(i, w, (t or "").split().count(w)) for part in (texts[:31], texts[31:]) for i, t in enumerate(part) for w in "ace" if w in (t or "").split()]
    assert sorted(seen.values()) == sorted(want)


def test_small_shards_give_the_same_counts(monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "b.", "Cc", "d\n"]) for _ in range(r.randrange(0, 60))) for _ in range(50)]
    rows = pa.RecordBatch.from_arrays([pa.array([r.choice(["x", "y"]) for _ in texts]), pa.array(texts)], names=["lang", "text"])
    totals = []
    for size in (100, 1 << 20):
        monkeypatch.setattr(phrases, "SHARD", size)
        count = {}
        for part in phrases._words(iter([rows])):
            for lang, word, a in zip(*(c.to_pylist() for c in part.columns), strict=True):
                count[lang, word] = count.get((lang, word), 0) + a
        totals.append(count)
    assert totals[0] == totals[1] and len(totals[0]) == 8
