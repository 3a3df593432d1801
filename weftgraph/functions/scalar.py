"""Column -> Column functions. All JVM-side; none starts a Python worker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import rules as R

__all__ = [
    "word", "strip_ws", "normalize_path", "normalize_url", "segments", "path_confidence", "characters",
    "shannon_entropy", "string_literals", "content_hash", "query_hash", "embedding_input", "slugify",
    "branch_slug", "strip_fences", "truncate_with_notice", "score_band", "dot", "cosine", "relative_path",
    "dir_name", "file_name", "file_stem", "file_ext", "language_of", "tokens", "token_estimate", "first_hit",
]

word = r"[\p{L}\p{N}_]"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _strip_slashes(c: Column) -> Column:
    return F.btrim(c, F.lit("/"))


def normalize_path(c: Column) -> Column:
    params = F.regexp_replace(_strip_slashes(c), r"\{(" + word + r"+)\}", ":$1")
    return F.concat(F.lit("/"), F.lower(params))


def normalize_url(c: Column) -> Column:
    path = F.substring_index(F.regexp_replace(c, "^https?://[^/]+", ""), "?", 1)
    return normalize_path(F.regexp_replace(path, r"\$\{[^}]+\}", ":param"))


def segments(path: Column) -> Column:
    return F.split(_strip_slashes(path), "/")


def path_confidence(a: Column, b: Column) -> Column:
    """1 per equal segment, 0.8 per segment where a side is a parameter; 0 on any mismatch."""
    left, right = segments(a), segments(b)
    scores = F.zip_with(
        left, right,
        lambda x, y: F.when(x == y, F.lit(1.0)).when(x.startswith(":") | y.startswith(":"), F.lit(0.8)),
    )
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    return F.when(F.size(left) == F.size(right), F.coalesce(total / F.size(left), F.lit(0.0))).otherwise(F.lit(0.0))


def characters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def shannon_entropy(c: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    n = F.length(c).cast("double")

    def share(ch: Column) -> Column:
        return (n - F.length(F.replace(c, ch, F.lit("")))) / n

    bits = F.aggregate(
        F.array_distinct(characters(c)), F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch))
    )
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(bits)


def string_literals(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(R.LITERAL_PATTERN), F.lit(1))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def query_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def embedding_input(c: Column) -> Column:
    return F.when(c.isNull() | (strip_ws(c) == ""), F.lit(" ")).otherwise(c)


def slugify(c: Column) -> Column:
    runs = F.regexp_replace(F.lower(strip_ws(c)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(runs, "^-+|-+$", ""), 1, 50)


def branch_slug(c: Column) -> Column:
    chars = F.regexp_replace(F.lower(strip_ws(c)), "[^a-z0-9-]", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(chars, "-{2,}", "-"), "^-+|-+$", ""), 1, 50)


def strip_fences(c: Column) -> Column:
    s = strip_ws(c)
    full = r"(?s)^```[a-zA-Z0-9]*\n(.*?)\n```\z"
    after_first_line = F.regexp_replace(s, r"(?s)\A[^\n]*\n", "")
    return (
        F.when(s.rlike(full), F.regexp_extract(s, full, 1))
        .when(s.startswith("```") & s.contains("\n"), strip_ws(F.regexp_replace(after_first_line, r"`+\z", "")))
        .otherwise(c)
    )


def truncate_with_notice(c: Column, limit: int, notice: str) -> Column:
    """Cut so that text plus notice stays within ``limit`` characters."""
    cut = F.concat(F.substring(c, 1, limit - len(notice)), F.lit(notice))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def score_band(score: Column) -> Column:
    return F.when(score > 0.8, "green").when(score > 0.6, "orange").otherwise("red")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def dir_name(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_ext(path: Column) -> Column:
    """Last suffix with its dot; a leading dot alone is no suffix."""
    return F.regexp_extract(file_name(path), r"(?s)\A.+?(\.[^.]+)\z", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_ext(path)))


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1))
    return reduce(
        lambda acc, kv: F.when(ext == kv[0], F.lit(kv[1])).otherwise(acc),
        R.LANGUAGE_BY_EXTENSION.items(),
        F.lit(None).cast("string"),
    )


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Default token counter: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("int")


def first_hit(cases: list[tuple[Column, Column]]) -> Column:
    """Value of the first case whose predicate holds, else NULL."""
    return F.coalesce(*[F.when(test, value) for test, value in cases])
