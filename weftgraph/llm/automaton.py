"""Generalised suffix automaton over token sequences, built once and streamed over documents."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """Automaton of all substrings of the added sequences.

    ``lengths[s]`` is the longest substring of state s, ``links[s]`` its suffix link. ``ends[s]`` lists (sequence, end
    position) of the prefixes that created the state; a state's occurrences are those of its whole link subtree.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.links = [-1]
        self.lengths = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self._n = 0

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.links.append(link)
        self.lengths.append(length)
        self.ends.append([])
        return len(self.links) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.lengths[p] + 1, self.links[q], dict(self.next[q]))
        self.links[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.links[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.lengths[known] == self.lengths[last] + 1 else self._split(last, token, known)
        new = self._state(self.lengths[last] + 1, 0, {})
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.links[p]
        if p != -1:
            q = self.next[p][token]
            self.links[new] = q if self.lengths[q] == self.lengths[p] + 1 else self._split(p, token, q)
        return new

    def add(self, tokens: list[int]) -> int:
        """Add a sequence; returns its number."""
        number, last = self._n, 0
        for i, token in enumerate(tokens):
            last = self._extend(last, token)
            self.ends[last].append((number, i + 1))
        self._n += 1
        return number

    def children(self) -> list[list[int]]:
        below: list[list[int]] = [[] for _ in self.links]
        for state, link in enumerate(self.links):
            if link >= 0:
                below[link].append(state)
        return below

    def occurrences(self, state: int, below: list[list[int]]) -> list[tuple[int, int]]:
        """(sequence, end) of every occurrence of the state's substrings."""
        found, stack = [], [state]
        while stack:
            s = stack.pop()
            found.extend(self.ends[s])
            stack.extend(below[s])
        return sorted(found)

    def stream(self, tokens: list[int]) -> tuple[list[int], list[int]]:
        """Matching statistics: at every token, the length of the longest suffix that occurs, and its state."""
        edges, links, lengths = self.next, self.links, self.lengths
        state = length = 0
        out_length, out_state = [], []
        for token in tokens:
            to = edges[state].get(token)
            while to is None and state:
                state = links[state]
                length = lengths[state]
                to = edges[state].get(token)
            if to is None:
                length = 0
            else:
                state = to
                length += 1
            out_length.append(length)
            out_state.append(state)
        return out_length, out_state


class Lexicon:
    """Numbers for the word hashes of the added sequences, and their neighbouring pairs, for whole-array look-ups."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        every = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        self.words = np.unique(every)
        self.sequences = [np.searchsorted(self.words, s).astype(np.int64) for s in sequences]
        pairs = [s[:-1] * len(self.words) + s[1:] for s in self.sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where no sequence has it."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def runs(self, ids: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Runs of at least ``least`` known words of one text whose neighbours also are neighbours in a sequence.

        Every match of ``least`` or more words lies inside one run, so streaming runs alone loses nothing.
        """
        if not len(ids):
            return []
        linked = np.zeros(len(ids), bool)  # word i and i + 1
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(both) and len(self.pairs):
            code = ids[both] * len(self.words) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            linked[both[self.pairs[at] == code]] = True
        lead = first[1:-1]
        lead = lead[(lead > 0) & (lead < len(ids))]
        linked[lead - 1] = False
        opens = ids >= 0
        opens[1:] &= ~linked[:-1]
        starts = np.flatnonzero(opens)
        closes = (ids >= 0) & ~linked
        stops = np.flatnonzero(closes) + 1
        keep = stops - starts >= least
        return list(zip(starts[keep].tolist(), stops[keep].tolist(), strict=True))
