"""Collocations and ranked search against plain versions: indexes, nulls, empty tables, repeats, ties, clashing columns."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm import brute
from weftgraph.llm import lexical, phrases, queries
from weftgraph.llm.fmindex import WordIndex

SF = "/root/testdata/sf0.001"


def compare(spark, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(cursor.fetchall())


@pytest.mark.parametrize("seed", range(20))
def test_index_counts_every_pattern(seed):
    r = random.Random(seed)
    ids = [r.randrange(0, 5) for _ in range(r.randrange(0, 60))] + [0]
    index = WordIndex(np.array(ids), 5)
    left = right = index.words()
    for length in range(1, 6):
        if length > 1:
            left, right = index.extend_left(left), index.extend_right(right, length - 1)
        want = Counter(tuple(ids[i:i + length]) for i in range(len(ids) - length + 1) if 0 not in ids[i:i + length])
        for intervals in (left, right):
            places, counts = index.patterns(intervals)
            assert dict(zip((tuple(ids[p:p + length]) for p in places.tolist()), counts.tolist(), strict=True)) == want


def plain_counts(rows, max_words):
    counts = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lower(text)):
            words = re.findall("[^ \t]+", piece)
            counts.update((lang or "und", " ".join(words[i:i + k])) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    return counts


def plain_collocations(rows, min_count, max_words, top):
    counts = plain_counts(rows, max_words)
    n = Counter()
    for (lang, phrase), a in counts.items():
        n[lang] += a if " " not in phrase else 0
    often = {k: a for k, a in counts.items() if a >= min_count}
    found = {}
    for (lang, phrase), a in often.items():
        words = phrase.split(" ")
        if len(words) == 1 or any(l2 == lang and len(p2) > len(phrase) and b >= a and f" {phrase} " in f" {p2} " for (l2, p2), b in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (often[lang, " ".join(words[:k])] * often[lang, " ".join(words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, phrase.encode(), often[lang, " ".join(words[:k])], often[lang, " ".join(words[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def test_collocations_of_varied_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 400)
    r = random.Random(1)
    words = ["a", "B", "ß", "of", "the", "x y", "\x00"]
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice([" ", "\t", " ", " ", ".", "\r\n", "  "]) for _ in range(r.randrange(0, 40)))) for _ in range(150)]
    rows += [(None, None), ("en", ""), ("en", " \t.,"), ("en", "q " * 3000), ("xx", "once")]
    rows += rows[:20]
    docs = spark.createDataFrame([(lang, text, 1, "p") for lang, text in rows], "lang string, text string, a int, phrase string")
    found = phrases.collocations(docs, min_count=5, max_words=4, top=30)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x[c] for c in columns) for x in found.collect()) == plain_collocations(rows, 5, 4, 30)
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_collocations_match_sql(spark):
    compare(spark, "op11_phrase_collocations", ["documents"])


def test_bits_keep_every_key():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    table = np.zeros(1 << 8, np.uint64)
    for places in phrases.bit_places(keys, np.uint64((1 << 14) - 1)):
        np.bitwise_or.at(table, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    assert phrases.BitTable(table).has(keys).all()
    assert phrases.BitTable(table).has(keys + np.uint64(1)).mean() < 0.1


def plain_search(docs, items, k):
    bags = [(d, Counter(brute.ALNUM.findall(brute.lower(t)))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for d, b, n in bags:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                        for t in set(brute.ALNUM.findall(brute.lower(text))) if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 4096])
def test_search_of_varied_texts(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "STEP", 4)
    r = random.Random(block)
    words = [f"w{i}" for i in range(12)] + ["Ünder", "W1", "x-y"]
    docs = [(i if i % 9 else None, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 30, 200])))) for i in range(300)]
    docs += [(5, None), (7, "w1 w2"), (7, "w1 w2"), (400, "same same"), (399, "same same"), (2, "same same"), (8, "w3 " * 50_000)]
    items = [("a", "w1 w2 w2 W3"), ("b", None), ("c", ""), ("d", "nowhere"), ("e", "same"), ("e", "same"), ("f", " ".join(words)), (None, "w5")]
    left = spark.createDataFrame([(d, t, 1, "q") for d, t in docs], "doc_id long, text string, rank int, query string").repartition(5)
    right = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id string, text string, score int")
    want = plain_search(docs, items, 7)
    for max_terms in (1 << 20, 4):
        found = lexical.search(left, right, k=7, max_terms=max_terms).collect()
        assert sorted(map(tuple, found), key=str) == want
    assert lexical.search(left.limit(0), right).collect() == [] == lexical.search(left, right.limit(0)).collect()


def test_search_matches_sql(spark):
    compare(spark, "op12_ranked_lexical_search", ["documents", "benchmark"])
