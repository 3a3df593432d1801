"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text):
    words = NONSPACE.findall(text or "")
    counts = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if counts[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if NONSPACE.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def base_places(text):
    words = ALNUM.findall(lower(text))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), found


def base_secrets(text):
    text = text or ""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    counts = Counter(k for _, k, _ in found)
    return counts[0], counts[1], counts[2], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)))


def contamination(text, items, window=10):
    words = ALNUM.findall(lower(text))
    hit, ids = set(), set()
    for key, item in items:
        size = min(window, len(item))
        if not size:
            continue
        windows = {tuple(item[i:i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                ids.add(str(key))
    return len(words), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def shingles(text, k):
    words = NONSPACE.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def components(docs, k, percent):
    """{row: (shingles, component)} for (doc_id, text) rows, by comparing every pair that shares a shingle."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = {(a, b) for rows in holders.values() for x, a in enumerate(rows) for b in rows[x + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(docs)]


def repeated(docs, size):
    """{doc_id: merged spans} of windows of ``size`` words that a text with other words, or another id with the same words, has too."""
    words = [(d, tuple(NONSPACE.findall(lower(t)))) for d, t in docs]
    holders = defaultdict(set)
    for d, w in words:
        for i in range(len(w) - size + 1):
            holders[w[i:i + size]].add(w)
    same = defaultdict(set)
    for d, w in words:
        same[w].add(d)
    out = defaultdict(set)
    for d, w in words:
        if len(w) < size:
            continue
        if len(same[w]) > 1:
            out[d].add((0, len(w)))
            continue
        spans = []
        for i in range(len(w) - size + 1):
            if len(holders[w[i:i + size]]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        out[d].update(map(tuple, spans))
    return {d: s for d, s in out.items() if s}


def crc(text):
    return zlib.crc32((text or "").encode())
