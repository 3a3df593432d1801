"""Main text of web pages: what the markup names as no article goes, and so does what pages next to each other by URL share.

The pages of a host are sorted by URL path, pages of equal lines once. Each is aligned with its two neighbours on either side by a longest common
subsequence of its text lines. A line that half of them share is a line of the site, not of the page. It goes, except

* in an element that the markup names as the article, where only shared links go: neighbours may quote or copy each other;
* a shared paragraph between unshared lines of a box that is mostly the page's own;
* if nothing of the page would be left: then its neighbours are copies of it, and the box with most text stays.

Lines that the markup names as menus, headers, footers and so on always go; a page with a named article keeps that article's lines only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.pages import ARTICLE, CHROME, HEADING, LINK, Line, lcs, page_lines
from weftgraph.llm.words import slices
from weftgraph.plans.scale import durable

#: Neighbours on either side that a page is aligned with.
REACH = 2
#: Pages aligned by one task at a time.
GROUP = 512
#: Words of a paragraph that may stay between lines of the page's own.
PARAGRAPH = 8

_LINES = "lines array<bigint>, kinds array<int>, boxes array<int>, words array<int>"


def host_and_path(url: str | None) -> tuple[str | None, str]:
    """Lower-case host (null: none, such pages have no neighbours) and path without a closing slash."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or None), parts.path.rstrip("/")
    except ValueError:
        return None, ""


def _codes(lines: list[Line]) -> np.ndarray:
    return pd.util.hash_array(np.array([line.text for line in lines], dtype=object), categorize=False).view(np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
    for part, _, _ in slices(batches, 2):
        rows = []
        for key, url, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            host, path = host_and_path(url)
            lines = page_lines(page or "") if host else []
            if any(not line.kind & CHROME for line in lines):
                rows.append((key, host, path, _codes(lines), [x.kind for x in lines], [x.box for x in lines], [x.text.count(" ") + 1 for x in lines]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "host", "path", "lines", "kinds", "boxes", "words"])


def shared_lines(mine: tuple, others: list) -> list[int]:
    """Lines of a page to delete, given (lines, kinds, boxes, words) of it and the lines of its neighbours."""
    lines, kinds, boxes, words = mine
    votes = np.zeros(len(lines), np.int64)
    for other in others:
        votes[lcs(lines, other)[0]] += 1
    voted = (votes > 0) & (2 * votes >= len(others))
    if not voted.any():
        return []
    open_ = [i for i, kind in enumerate(kinds) if not kind & CHROME]
    named = any(kinds[i] & ARTICLE for i in open_)
    if named:
        return [i for i in open_ if voted[i] and kinds[i] & LINK and not kinds[i] & HEADING]
    total, shared = Counter(), Counter()
    for i in open_:
        total[boxes[i]] += words[i]
        shared[boxes[i]] += words[i] if voted[i] else 0
    own = {box: [i for i in open_ if boxes[i] == box and not voted[i]] for box in total}
    drop = [
        i for i in open_ if voted[i] and not (
            2 * shared[boxes[i]] < total[boxes[i]] and words[i] >= PARAGRAPH and not kinds[i] & LINK and own[boxes[i]][0] < i < own[boxes[i]][-1])
    ]
    if len(drop) == len(open_):
        most = max(total, key=lambda box: (total[box], -box))
        drop = [i for i in drop if boxes[i] != most]
    return drop


def _align(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at", kind="mergesort").reset_index(drop=True)
    sequences = [x.tolist() for x in pdf["lines"]]
    found = []
    for i in np.flatnonzero(pdf["own"]):
        near = [j for j in range(max(0, i - REACH), min(len(pdf), i + REACH + 1)) if j != i and pdf["host"][j] == pdf["host"][i]]
        if near:
            row = pdf.iloc[i]
            drop = shared_lines((sequences[i], row["kinds"], row["boxes"], row["words"]), [sequences[j] for j in near])
            if drop:
                found.append((row["host"], row["digest"], drop))
    return pd.DataFrame(found, columns=["host", "digest", "drop"])


def _deletions(keyed: DataFrame) -> DataFrame:
    """key and the numbers of the lines that the page shares with its neighbours; pages that lose none are left out."""
    summaries = durable(
        keyed.mapInArrow(_summaries, f"key binary, host string, path string, {_LINES}").withColumn("digest", F.md5(F.to_json(F.struct("lines", "kinds", "boxes")))), "pages")
    distinct = summaries.groupBy("host", "digest").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("lines", "kinds", "boxes", "words")])
    order = ["host", "path", "digest"]
    blocks = durable(distinct.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()), "hosts")
    sizes = blocks.groupBy("_block").count()
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(*order)
    numbered = blocks.withColumn("_n", F.row_number().over(inside)).join(offsets, "_block").withColumn("at", F.col("_offset") + F.col("_n") - 1)
    groups = F.array_distinct(F.transform(F.array(*[F.lit(x) for x in (0, -REACH, REACH)]), lambda x: F.floor((F.col("at") + x) / GROUP)))
    dealt = numbered.select("host", "digest", "lines", "kinds", "boxes", "words", "at", F.explode(groups).alias("_group")).withColumn(
        "own", F.floor(F.col("at") / GROUP) == F.col("_group"))
    drops = dealt.groupBy("_group").applyInPandas(lambda pdf: _align(pdf.drop(columns="_group")), "host string, digest string, drop array<int>")
    return summaries.select("key", "host", "digest").distinct().join(durable(drops, "drops"), ["host", "digest"]).select("key", "drop")


def _texts(n_keep: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, 0):
            out = []
            for page, drop in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                lines = page_lines(page or "")
                gone = set(drop or ())
                kept = [line for i, line in enumerate(lines) if not line.kind & CHROME and i not in gone]
                named = any(not line.kind & CHROME and line.kind & ARTICLE for line in lines)
                out.append(" ".join(line.text for line in kept if not named or line.kind & ARTICLE))
            columns = [part.column(2 + i) for i in range(n_keep)] + [pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"_k{i}" for i in range(n_keep)] + ["_main"])

    return run


def main_texts(pages: DataFrame, url_column: str = "url", html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default ``page_id`` and ``url``) and ``text``: the page's main text, blocks joined by one space, empty if there is none.

    Null and empty pages give empty texts; a null or broken URL has no host, and so no neighbours. Pages of equal lines on one host count as one
    neighbour and get equal texts, repeated rows likewise. Neighbours of equal paths go by their lines' digest. Very long pages are read whole;
    an empty table gives no rows. Other columns are not read.
    """
    keep = ["page_id", "url"] if keep is None else keep
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(url_column), F.lit("\0")), F.coalesce(F.col(html_column), F.lit("")))))
    keyed = pages.select(key.alias("key"), F.col(url_column).alias("url"), F.col(html_column).alias("page"))
    rows = pages.select(F.col(html_column).alias("_page"), key.alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    drops = _deletions(keyed).withColumnRenamed("key", "_key")
    joined = rows.join(drops, "_key", "left").select("_page", "drop", *[f"_k{i}" for i in range(len(keep))])
    schema = ", ".join([f"_k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["_main string"])
    found = joined.mapInArrow(_texts(len(keep)), schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_main").alias("text"))
