"""License scan: a suffix automaton of licence texts, matching statistics over whole files, long matches chained to spans.

``scan_licenses`` streams the words of each text through one automaton that holds the base phrases and the templates.
A phrase occurs where it is a suffix of the current match. Maximal matches of ``min_match`` or more words of one template that
follow each other in template order, with at most ``max_gap`` words between them, form a chain; its share of the template's
words is the template's coverage, and a coverage of ``min_coverage`` gives the template's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.automaton import Lexicon, SuffixAutomaton
from weftgraph.llm.words import ALNUM, scan, slices, words_of

# Phrases and their labels, and the notices that the licences themselves ask to be copied into files.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
MIN_MATCH = 6
MAX_GAP = 20
MIN_COVERAGE = 0.6
_RESULT = (
    "_words bigint, _base array<struct<label:string,start:bigint>>, "
    "_covered array<struct<label:string,start:bigint,end:bigint,coverage:double>>"
)


class LicenseIndex:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], min_match: int) -> None:
        texts = [(label, words_of(text, ALNUM)) for text, label in phrases.items()]
        texts += [(label, words_of(text, ALNUM)) for label, text in templates.items()]
        texts = [(label, hashes) for label, hashes in texts if len(hashes)]
        self.min_match = min_match
        self.labels = [label for label, _ in texts]
        self.lexicon = Lexicon([hashes for _, hashes in texts])
        self.automaton = SuffixAutomaton()
        for sequence in self.lexicon.sequences:
            self.automaton.add(sequence.tolist())
        n_phrases = sum(1 for text in phrases if len(words_of(text, ALNUM)))
        self.sizes = [len(s) for s in self.lexicon.sequences]
        self.least = min([min_match, *self.sizes[:n_phrases]])
        self.phrases: dict[int, list[int]] = {}
        for number, sequence in enumerate(self.lexicon.sequences[:n_phrases]):
            self.phrases.setdefault(self.automaton.stream(sequence.tolist())[1][-1], []).append(number)
        self.templates = set(range(n_phrases, len(texts)))
        self.below = self.automaton.children()
        self._phrases: dict[int, list[int]] = {}
        self._places: dict[int, list[tuple[int, int]]] = {}

    def phrases_at(self, state: int) -> list[int]:
        if state not in self._phrases:
            found, s = [], state
            while s > 0:
                found.extend(self.phrases.get(s, ()))
                s = self.automaton.links[s]
            self._phrases[state] = found
        return self._phrases[state]

    def places(self, state: int) -> list[tuple[int, int]]:
        """(template, end) where the state's substrings occur."""
        if state not in self._places:
            self._places[state] = [x for x in self.automaton.occurrences(state, self.below) if x[0] in self.templates]
        return self._places[state]

    def read(self, tokens: list[int], offset: int, base: list, long: list) -> None:
        """Phrase places and maximal long matches (start, end, state) of a run that starts at word ``offset``."""
        lengths, states = self.automaton.stream(tokens)
        lengths.append(0)
        for i, state in enumerate(states):
            length = lengths[i]
            for number in self.phrases_at(state):
                if self.sizes[number] <= length:
                    base.append((self.labels[number], offset + i + 1 - self.sizes[number]))
            if length >= self.min_match and lengths[i + 1] <= length:
                long.append((offset + i + 1 - length, offset + i + 1, state))

    def chains(self, long: list[tuple[int, int, int]], max_gap: int) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, coverage) of every chain, in document order."""
        out: list[tuple[str, int, int, float]] = []
        open_: dict[int, list[int]] = {}  # template: [start, end, template end, covered words]

        def close(template: int) -> None:
            start, end, _, covered = open_.pop(template)
            out.append((self.labels[template], start, end, min(1.0, covered / self.sizes[template])))

        for start, end, state in sorted(long):
            nearest: dict[int, int] = {}
            for template, stop in self.places(state):
                now = open_.get(template)
                if template not in nearest or (now and nearest[template] < now[2] < stop):
                    nearest[template] = stop  # the first place, or the first that goes on beyond the chain
            for template, stop in nearest.items():
                now = open_.get(template)
                if now and (start - now[1] > max_gap or stop <= now[2]):
                    close(template)
                    now = None
                if now is None:
                    open_[template] = [start, end, stop, end - start]
                else:
                    fresh = min(end - max(start, now[1]), stop - now[2])
                    now[1:] = [end, stop, now[3] + max(0, fresh)]
        for template in list(open_):
            close(template)
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(
    docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
) -> DataFrame:
    """One row per row: the ``keep`` columns (default ``doc_id``), ``_words`` (count), ``_base`` (label and first word of every
    phrase place) and ``_covered`` (label, word span and coverage of every chain of long matches).

    Null and empty texts have no words and no matches; repeated rows are scanned one by one; other columns are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_column).alias("_text"))
    schema = ", ".join([f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [_RESULT])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(phrases, templates, min_match)
        base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
        for part, data, offsets in slices(batches, n_keep):
            found = scan(data, offsets, ALNUM)
            ids = index.lexicon.ids(found.hash)
            base: list[list] = [[] for _ in range(part.num_rows)]
            long: list[list] = [[] for _ in range(part.num_rows)]
            for start, stop in index.lexicon.runs(ids, found.first, index.least):
                doc = int(np.searchsorted(found.first, start, side="right")) - 1
                index.read(ids[start:stop].tolist(), start - int(found.first[doc]), base[doc], long[doc])
            spans = [[dict(zip(("label", "start", "end", "coverage"), c, strict=True)) for c in index.chains(m, max_gap)] if m else [] for m in long]
            places = [[{"label": label, "start": at} for label, at in places] for places in base]
            columns = [part.column(i) for i in range(n_keep)] + [pa.array(np.diff(found.first), pa.int64())]
            columns += [pa.array(places, base_type), pa.array(spans, span_type)]
            names = [f"_k{i}" for i in range(n_keep)] + ["_words", "_base", "_covered"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "_words", "_base", "_covered")


def report(found: DataFrame, id_column: str = "doc_id", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Counts, labels and score per document: the score is 1 with a base phrase, else the best coverage."""
    starts = F.transform("_base", lambda b: b["start"])
    base = F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"])))
    more = F.transform(F.filter("_covered", lambda c: c["coverage"] >= min_coverage), lambda c: c["label"])
    best = F.coalesce(F.array_max(F.transform("_covered", lambda c: c["coverage"])), F.lit(0.0))
    return found.select(
        F.col(id_column), F.col("_words").alias("n_words"), F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
