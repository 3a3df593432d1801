"""Safety scans over the documents, each with one planted line of a rule's shape, and over refs and paths from other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import rules as R
from weftgraph.operators import safety as S
from weftgraph.plans.scale import spread
from weftgraph.plans.views import sql_over, table

# {h}: 64 hex digits of the row's key; {b}: two base-64 digests. Both engines run this text.
_SHAPES = [
    "concat('sk-', substr({h}, 1, 24))", "concat('ghp_', substr({h}, 1, 40))", "concat('gho_', substr({h}, 1, 40))",
    "concat('ghs_', substr({h}, 1, 40))", "concat('ghr_', substr({h}, 1, 40))", "concat('AKIA', upper(substr({h}, 1, 16)))",
    "concat('aws_secret = \"', substr({h}, 1, 40), '\"')",
    "concat('DefaultEndpointsProtocol=https;AccountName=acct;AccountKey=', {h}, substr({h}, 1, 24))",
    "concat('azure_storage_key: ', substr({h}, 1, 44))", "'\"type\": \"service_account\"'",
    "concat('\"private_key_id\": \"', substr({h}, 1, 40), '\"')", "concat('sk_live_', substr({h}, 1, 24))",
    "concat('rk_live_', substr({h}, 1, 24))", "concat('sk_test_', substr({h}, 1, 24))", "concat('AC', substr({h}, 1, 32))",
    "concat('SK', substr({h}, 1, 32))", "concat('-----BEGIN RSA ', 'PRIVATE KEY-----')", "concat('-----BEGIN PGP ', 'PRIVATE KEY BLOCK-----')",
    "concat('jwt_secret=', substr({h}, 1, 32))", "concat('postgres://user:', substr({h}, 1, 10), '@host/db')",
    "concat('mongodb+srv://u:', substr({h}, 1, 3), '@h')", "concat('api_key = ''', substr({h}, 1, 24), '''')",
    "concat('password = \"', substr({h}, 1, 10), '\"')", "concat('xoxb-1234567890-1234567890-', substr({h}, 1, 24))",
    "concat('SG.', substr({h}, 1, 22), '.', substr({h}, 1, 43))", "concat(substr({h}, 1, 32), '-us12')",
    "concat('sq0atp-', substr({h}, 1, 22))", "concat('sq0csp-', substr({h}, 1, 43))",
    "concat('x = \"', substr({b}, 1, 44), '\"')", "concat('y = \"', {b}, '\"')", "'nothing to see'", "repeat({nul}, 3)", "repeat({bell}, 9000)",
]


def _text_sql(h: str, b: str, char: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + s.format(h=h, b=b, nul=f"{char}(0)", bell=f"{char}(7)") for i, s in enumerate(_SHAPES))
    return f"SELECT doc_id, concat(text, {char}(10), CASE doc_id % {len(_SHAPES)} {cases} END) AS content FROM documents"


SPARK_TEXTS = _text_sql(
    "sha2(CAST(doc_id AS STRING), 256)",
    "concat(base64(unhex(sha2(CAST(doc_id AS STRING), 256))), base64(unhex(sha2(CAST(doc_id + 1 AS STRING), 256))))", "char")
DUCK_TEXTS = _text_sql(
    "sha256(CAST(doc_id AS VARCHAR))",
    "concat(base64(from_hex(sha256(CAST(doc_id AS VARCHAR)))), base64(from_hex(sha256(CAST(doc_id + 1 AS VARCHAR)))))", "chr")


def texts(spark, sf_dir):
    return spread(sql_over(spark, sf_dir, SPARK_TEXTS, ["documents"]))


def secret_scan(spark, sf_dir):
    return S.scan_secrets(texts(spark, sf_dir))


def secret_rule_counts(spark, sf_dir):
    return secret_scan(spark, sf_dir).groupBy("rule", "label").agg(F.count("*").alias("n"))


def entropy_scan(spark, sf_dir):
    found = S.scan_entropy(texts(spark, sf_dir))
    return found.select("doc_id", "pos", "excerpt", "hard", F.round("entropy", 6).alias("entropy"))


def binary_scan(spark, sf_dir):
    return S.scan_binary(texts(spark, sf_dir))


def scan_violations(spark, sf_dir):
    return S.scan_content(texts(spark, sf_dir), "doc_id").groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"), F.bool_or("hard").alias("hard"))


def scan_summary(spark, sf_dir):
    return S.scan_summary(texts(spark, sf_dir), "doc_id")


def redact(spark, sf_dir):
    found = S.redacted(texts(spark, sf_dir))
    return found.select("doc_id", F.sha2("clean", 256).alias("clean_hash"), F.length("clean").alias("clean_length"), "changed")


# Paths from pages and parts: ordinary ones, sensitive names, steps above the root and repository configuration.
PATH_SQL = """
  SELECT url AS path FROM pages
  UNION ALL SELECT concat('/repo/', s_name, CASE WHEN s_acctbal > 5000 THEN '/../../etc/passwd' ELSE '/./a/../config.ts' END) FROM supplier
  UNION ALL SELECT concat('src/', p_type, '/', p_name, CASE p_size % 7 WHEN 0 THEN '.PEM' WHEN 1 THEN '/.env.local' WHEN 2 THEN '/secrets/a.ts'
    WHEN 3 THEN '/.git/x' WHEN 4 THEN '/../../b.ts' ELSE '.ts' END) FROM part
  UNION ALL SELECT concat('.git', CASE n_nationkey % 3 WHEN 0 THEN 'modules' WHEN 1 THEN '/hooks/pre' ELSE 'attributes' END) FROM nation
"""
REF_SQL = """
  SELECT concat(CASE o_orderkey % 6 WHEN 0 THEN 'kb/feature/' WHEN 1 THEN '+kb/feature/' WHEN 2 THEN 'refs/tags/' WHEN 3 THEN 'v' ELSE 'kb/feature/' END,
           lower(replace(o_orderpriority, ' ', '-')), CASE o_orderkey % 5 WHEN 0 THEN '/main' WHEN 1 THEN '/20240101-12' ELSE '/20240101-123456' END) AS ref,
         CASE o_orderstatus WHEN 'F' THEN 'main' WHEN 'O' THEN 'develop' ELSE 'release-1' END AS base_branch,
         concat('org/', CASE WHEN o_custkey % 3 = 0 THEN 'web' ELSE 'api' END) AS repo_slug, o_orderkey
  FROM orders
"""
AUTHOR_SQL = """
  SELECT c_custkey, concat(lower(replace(c_name, '#', '')), CASE c_mktsegment WHEN 'BUILDING' THEN '@Example.com' WHEN 'MACHINERY' THEN '@users.noreply.github.com'
    WHEN 'AUTOMOBILE' THEN '@localhost' ELSE '@other.net' END) AS author_email FROM customer
"""


def path_checks(spark, sf_dir):
    return S.scan_paths(sql_over(spark, sf_dir, PATH_SQL, ["pages", "supplier", "part", "nation"]))


def branch_checks(spark, sf_dir):
    return S.check_branches(sql_over(spark, sf_dir, REF_SQL, ["orders"]), slugs=["org/web"]).select("o_orderkey", "rule")


def author_checks(spark, sf_dir):
    return S.check_authors(sql_over(spark, sf_dir, AUTHOR_SQL, ["customer"]), org="example")


QUERIES = {f.__name__: f for f in (
    secret_scan, secret_rule_counts, entropy_scan, binary_scan, scan_violations, scan_summary, redact, path_checks,
    branch_checks, author_checks)}


def _q(text: str) -> str:
    return text.replace("'", "''")


_RULES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule, '{_q(label)}' AS label, {str(hard).lower()} AS hard FROM t WHERE regexp_matches(content, '{_q(p)}')"
    for i, (p, label, hard) in enumerate(R.SECRET_RULES))
_EXCLUDED = _q("(?i)^(?:" + "|".join(R.ENTROPY_EXCLUSIONS) + ")$")
_T = f"WITH t AS MATERIALIZED ({DUCK_TEXTS})"
_SECRETS = f"{_T}, sec AS ({_RULES})"
_ENTROPY = f"""lit AS (SELECT doc_id, unnest(l) AS literal, generate_subscripts(l, 1) - 1 AS pos FROM (
     SELECT doc_id, regexp_extract_all(content, '{_q(R.LITERAL_PATTERN)}', 1) AS l FROM t)),
   chars AS (SELECT doc_id, pos, literal, unnest(string_split(literal, '')) AS ch FROM lit WHERE NOT regexp_matches(literal, '{_EXCLUDED}')),
   freq AS (SELECT doc_id, pos, literal, ch, count(*)::DOUBLE / length(literal) AS p FROM chars WHERE ch <> '' GROUP BY doc_id, pos, literal, ch),
   ent AS (SELECT doc_id, pos, literal, -sum(p * log2(p)) AS entropy FROM freq GROUP BY doc_id, pos, literal HAVING -sum(p * log2(p)) > 4.5)"""
_BINARY = r"""bin AS (SELECT doc_id, CASE WHEN contains(content, chr(0)) THEN 'contains null bytes' ELSE 'high concentration of control characters' END AS reason FROM t
   WHERE contains(content, chr(0)) OR (length(content) - length(regexp_replace(content, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')))::DOUBLE / length(content) > 0.1)"""
_VIOL = f"""{_SECRETS}, {_ENTROPY}, {_BINARY}, v AS (SELECT doc_id, 'secret' AS kind, hard FROM sec
   UNION ALL SELECT doc_id, 'entropy', entropy > 5.5 FROM ent UNION ALL SELECT doc_id, 'binary', true FROM bin)"""
_CLEAN = "content"
for _p, _r in R.REDACTIONS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_q('(?i)' + _p)}', '{_q(_r)}', 'g')"
_NAMES = ", ".join(f"'{n}'" for n in R.SENSITIVE_NAMES)
_CONFIGS = ", ".join(f"'{n}'" for n in R.REPO_CONFIG_PATHS)

ORACLES = {
    "secret_scan": f"{_SECRETS} SELECT * FROM sec",
    "secret_rule_counts": f"{_SECRETS} SELECT rule, label, count(*) AS n FROM sec GROUP BY rule, label",
    "entropy_scan": f"""{_T}, {_ENTROPY} SELECT doc_id, pos, CASE WHEN length(literal) > 20 THEN substr(literal, 1, 20) || '...' ELSE literal END AS excerpt,
        entropy > 5.5 AS hard, round(entropy, 6) AS entropy FROM ent""",
    "binary_scan": f"{_T}, {_BINARY} SELECT * FROM bin",
    "scan_violations": f"{_VIOL} SELECT doc_id, kind, count(*) AS n, bool_or(hard) AS hard FROM v GROUP BY doc_id, kind",
    "scan_summary": f"""{_VIOL} SELECT t.doc_id, count(*) FILTER (hard) AS hard, count(*) FILTER (NOT hard) AS soft, count(*) FILTER (hard) = 0 AS is_safe
        FROM t LEFT JOIN v USING (doc_id) GROUP BY t.doc_id""",
    "redact": f"""{_T}, r AS (SELECT doc_id, content, {_CLEAN} AS clean FROM t)
        SELECT doc_id, sha256(clean) AS clean_hash, length(clean) AS clean_length, clean <> content AS changed FROM r""",
    # the reduce keeps a stack of parts; one step up pops it
    "path_checks": f"""WITH t AS ({PATH_SQL}),
        a AS (SELECT path, list_filter(string_split(CASE WHEN path LIKE '/%' THEN path ELSE '/repo/' || path END, '/'), lambda p: p <> '' AND p <> '.') AS raw FROM t),
        b AS (SELECT path, string_split(list_reduce(list_prepend('', raw), lambda acc, p: CASE WHEN p <> '..' THEN acc || '/' || p ELSE regexp_replace(acc, '/[^/]*$', '') END), '/') AS st FROM a),
        c AS (SELECT path, st[2:] AS parts FROM b),
        d AS (SELECT path, parts, parts[1] = 'repo' AS inside, lower(parts[len(parts)]) AS name, array_to_string(parts[2:], '/') AS rel FROM c)
        SELECT path, 'outside_root' AS rule FROM d WHERE NOT coalesce(inside, false)
        UNION ALL SELECT path, 'sensitive_name' FROM d WHERE len(list_filter([{_NAMES}], lambda s: contains(name, s) OR list_contains(list_transform(parts, lambda q: lower(q)), s))) > 0
        UNION ALL SELECT path, 'repo_config' FROM d WHERE inside AND (len(list_filter([{_CONFIGS}], lambda s: starts_with(rel, s))) > 0 OR list_contains(string_split(rel, '/'), '.git'))""",
    "branch_checks": f"""WITH t AS ({REF_SQL}), p AS (SELECT *, regexp_extract(ref, '[^/]*$') AS last FROM t)
        SELECT o_orderkey, 'protected' AS rule FROM p WHERE last IN ('main', 'master', 'develop', 'staging', 'production', 'release') OR ref IN ('main', 'master', 'develop', 'staging', 'production', 'release')
        UNION ALL SELECT o_orderkey, 'name_pattern' FROM p WHERE NOT regexp_full_match(ref, 'kb/feature/[a-z0-9-]+/[0-9]{{8}}-[0-9]{{6}}')
        UNION ALL SELECT o_orderkey, 'tag' FROM p WHERE ref LIKE 'refs/tags/%' OR ref LIKE 'v%' OR ref LIKE 'release-%'
        UNION ALL SELECT o_orderkey, 'force_push' FROM p WHERE ref LIKE '+%'
        UNION ALL SELECT o_orderkey, 'base_branch' FROM p WHERE base_branch NOT IN ('main', 'develop')
        UNION ALL SELECT o_orderkey, 'repo_slug' FROM p WHERE repo_slug <> 'org/web'""",
    "author_checks": f"""WITH t AS ({AUTHOR_SQL}) SELECT c_custkey, author_email, len(list_filter(['@example.com', '@users.noreply.github.com', 'noreply@github.com', '@localhost'],
        lambda x: contains(lower(author_email), x))) > 0 AS allowed FROM t""",
}
