"""File edits from documents (each document edits a file of its source) and style samples from page URLs and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import changes as C
from weftgraph.operators import safety as S
from weftgraph.operators import sampling as P
from weftgraph.plans.scale import spread
from weftgraph.plans.views import sql_over

# Three edits on average per file: the original is the text before, the new text drops or adds lines. Both engines run it.
EDIT_SQL = """SELECT source AS repo, concat(lang, '/', CAST(doc_id AS BIGINT) / 3 - (CAST(doc_id AS BIGINT) % 3) / 3.0, '.ts') AS file_path, doc_id AS seq,
  CASE WHEN n_chars % 5 = 0 THEN NULL ELSE text END AS original, CASE WHEN n_chars % 3 = 0 THEN replace(text, '. ', concat('.', chr(10))) ELSE concat(text, chr(10), text, chr(10), 'tail') END AS new,
  concat('edit ', doc_id) AS description, n_chars % 5 = 0 AS is_new, n_chars % 11 = 0 AS is_deleted FROM documents"""
EDIT_SQL = EDIT_SQL.replace("CAST(doc_id AS BIGINT) / 3 - (CAST(doc_id AS BIGINT) % 3) / 3.0", "CAST(floor(doc_id / 3.0) AS BIGINT)")


def edits(spark, sf_dir):
    return spread(sql_over(spark, sf_dir, EDIT_SQL, ["documents"]))


def latest_changes(spark, sf_dir):
    return C.latest_changes(edits(spark, sf_dir)).select(
        "repo", "file_path", F.sha2("original", 256).alias("original_hash"), F.sha2("new", 256).alias("new_hash"), "description", "is_new", "is_deleted")


def line_changes(spark, sf_dir):
    return C.line_changes(C.latest_changes(edits(spark, sf_dir))).select("repo", "file_path", "lines_added", "lines_removed")


def change_summary(spark, sf_dir):
    return C.change_summary(C.line_changes(C.latest_changes(edits(spark, sf_dir))))


def repos_with_changes(spark, sf_dir):
    return C.repos_with_changes(C.latest_changes(edits(spark, sf_dir)))


def restore_set(spark, sf_dir):
    changes = C.latest_changes(edits(spark, sf_dir))
    done = C.repos_with_changes(changes).filter("changes > 10")
    return C.restore_set(changes, done).select("repo", "file_path", "action", F.sha2("content", 256).alias("content_hash"))


def reset_repo(spark, sf_dir):
    return C.reset(edits(spark, sf_dir), "src3").select("repo", "seq")


def diff_caps(spark, sf_dir):
    return S.check_diff_size(C.line_changes(C.latest_changes(edits(spark, sf_dir))), 500)


def file_caps(spark, sf_dir):
    return S.check_file_count(edits(spark, sf_dir))


FILE_SQL = """SELECT p_brand AS repo, concat('src/', lower(p_type), '/', replace(p_name, ' ', '/'), p_size % 4,
   CASE p_size % 8 WHEN 0 THEN 'Controller.java' WHEN 1 THEN 'Service.java' WHEN 2 THEN '.hook.ts' WHEN 3 THEN '/page.tsx' WHEN 4 THEN '.test.ts' WHEN 5 THEN 'Dto.java' ELSE '.ts' END) AS path,
   concat(p_name, ' ', p_partkey) AS content, p_partkey FROM part
  UNION ALL SELECT 'web', concat('app/', regexp_replace(url, '[?#].*$', ''), CASE page_id % 3 WHEN 0 THEN '/page.tsx' WHEN 1 THEN '/List.component.tsx' ELSE '/api/client.ts' END), html, 1000000000 + page_id FROM pages
  UNION ALL SELECT concat('Brand#', n_nationkey + 1), CASE n_regionkey WHEN 0 THEN 'CONVENTIONS.md' WHEN 1 THEN 'CLAUDE.md' WHEN 2 THEN 'README.md' ELSE 'NOTES.md' END,
    concat(CASE WHEN n_nationkey % 2 = 0 THEN 'Style guide ' ELSE 'Notes ' END, n_name), 2000000000 + n_nationkey FROM nation"""


def files(spark, sf_dir):
    """One row per path: the latest content."""
    raw = sql_over(spark, sf_dir, FILE_SQL, ["part", "pages", "nation"])
    return raw.groupBy("repo", "path").agg(F.max_by("content", "p_partkey").alias("content"))


def _targets(spark, sf_dir):
    return files(spark, sf_dir).select("repo", F.col("path").alias("target"))


def similar_files(spark, sf_dir):
    return P.similar_files(_targets(spark, sf_dir), files(spark, sf_dir), 3)


def style_samples(spark, sf_dir):
    found = files(spark, sf_dir)
    return P.samples(P.similar_files(_targets(spark, sf_dir), found, 3), found, 3, 300)


def name_collisions(spark, sf_dir):
    return P.name_collisions(_targets(spark, sf_dir), files(spark, sf_dir), 3)


def first_samples(spark, sf_dir):
    found = files(spark, sf_dir).withColumn("language", F.when(F.col("path").endswith(".java"), "java").otherwise("typescript"))
    return P.first_samples(found)


def convention_files(spark, sf_dir):
    return P.convention_file(files(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    latest_changes, line_changes, change_summary, repos_with_changes, restore_set, reset_repo, diff_caps, file_caps,
    similar_files, style_samples, name_collisions, first_samples, convention_files)}

_CH = f"""WITH e AS ({EDIT_SQL}), f AS (SELECT repo, file_path, seq, original FROM e QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY seq) = 1),
  l AS (SELECT repo, file_path, "new", description, is_new, is_deleted FROM e QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY seq DESC) = 1),
  ch AS (SELECT repo, file_path, original, "new", description, is_new, is_deleted FROM f JOIN l USING (repo, file_path))"""
_LC = _CH + r""", li AS (SELECT repo, file_path, unnest(regexp_extract_all(coalesce("new", ''), '[^\n]*\n|[^\n]+')) AS line, 1 AS d FROM ch
    UNION ALL SELECT repo, file_path, unnest(regexp_extract_all(coalesce(original, ''), '[^\n]*\n|[^\n]+')), -1 FROM ch),
  net AS (SELECT repo, file_path, line, sum(d) AS d FROM li GROUP BY ALL),
  lc AS (SELECT repo, file_path, is_new, coalesce(sum(greatest(d, 0)), 0) AS lines_added, coalesce(sum(greatest(-d, 0)), 0) AS lines_removed FROM ch LEFT JOIN net USING (repo, file_path) GROUP BY ALL)"""
_FILES = f"""WITH raw AS ({FILE_SQL}), files AS (SELECT repo, path, arg_max(content, p_partkey) AS content FROM raw GROUP BY repo, path),
  fp AS (SELECT repo, path, content, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(path, '[^/]*$') AS name,
         regexp_extract(regexp_extract(path, '[^/]*$'), '^.+?(\\.[^.]+)$', 1) AS ext FROM files)"""
_FAMS = ["Controller.java", "Service.java", "Repository.java", "Dto.java", "Request.java", "Response.java", ".hook.ts", ".hook.tsx",
         ".component.tsx", ".test.ts", ".test.tsx", ".stories.tsx", ".config.ts", ".config.js"]
_SAME_FAMILY = " OR ".join(f"(ends_with(t.name, '{s}') AND ends_with(f.name, '{s}'))" for s in _FAMS)
_SIM = _FILES + f""", pr AS (SELECT t.repo, t.path AS target, f.path, CASE WHEN f.dir = t.dir AND f.ext = t.ext THEN 10 WHEN {_SAME_FAMILY} THEN 5 WHEN f.ext = t.ext THEN 1 END AS score
     FROM fp t JOIN fp f ON f.repo = t.repo AND f.name <> t.name),
  sim AS (SELECT repo, target, path, score, row_number() OVER (PARTITION BY repo, target ORDER BY score DESC, path) AS rank FROM pr WHERE score IS NOT NULL QUALIFY rank <= 3)"""
ORACLES = {
    "latest_changes": _CH + """ SELECT repo, file_path, sha256(original) AS original_hash, sha256("new") AS new_hash, description, is_new, is_deleted FROM ch""",
    "line_changes": _LC + " SELECT repo, file_path, lines_added, lines_removed FROM lc",
    "change_summary": _LC + " SELECT repo, count(*) FILTER (NOT is_new) AS files_modified, count(*) FILTER (is_new) AS files_created, sum(lines_added) AS lines_added, sum(lines_removed) AS lines_removed FROM lc GROUP BY repo",
    "repos_with_changes": _CH + " SELECT repo, count(*) AS changes FROM ch GROUP BY repo",
    "restore_set": _CH + """ SELECT repo, file_path, CASE WHEN is_new THEN 'delete' WHEN original IS NOT NULL THEN 'restore' ELSE 'none' END AS action,
        CASE WHEN NOT is_new THEN sha256(original) END AS content_hash FROM ch WHERE repo IN (SELECT repo FROM ch GROUP BY repo HAVING count(*) > 10)""",
    "reset_repo": f"SELECT repo, seq FROM ({EDIT_SQL}) WHERE repo <> 'src3'",
    "diff_caps": _LC + """ SELECT repo, sum(lines_added) AS added, sum(lines_removed) AS removed, 500 AS "limit", sum(lines_added) + sum(lines_removed) > 500 AS violation FROM lc GROUP BY repo""",
    "file_caps": f"""SELECT repo, count(DISTINCT file_path) AS files, 15 AS "limit", count(DISTINCT file_path) > 15 AS violation FROM ({EDIT_SQL}) GROUP BY repo""",
    "similar_files": _SIM + " SELECT * FROM sim",
    "style_samples": _SIM + r""", fi AS (SELECT repo, path, min(struct_pack(a := target, b := rank)) AS k FROM sim GROUP BY repo, path),
        po AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY k.a, k.b, path) AS position FROM fi QUALIFY position <= 6)
        SELECT repo, position, path, CASE WHEN len(string_split(content, chr(10))) > 300 THEN array_to_string(string_split(content, chr(10))[1:300], chr(10)) || chr(10) || '... (truncated, ' || len(string_split(content, chr(10))) || ' total lines)' ELSE content END AS sample
        FROM po JOIN files USING (repo, path)""",
    "name_collisions": _FILES + r""", st AS (SELECT *, lower(substr(name, 1, length(name) - length(ext))) AS stem FROM fp),
        pr AS (SELECT t.repo, t.path AS target, f.path FROM st t JOIN st f ON f.repo = t.repo AND f.stem = t.stem AND f.ext = t.ext AND f.path <> t.path
          QUALIFY row_number() OVER (PARTITION BY t.repo, t.path ORDER BY f.path) <= 3)
        SELECT repo, target, string_agg(path, ', ' ORDER BY path) AS similar FROM pr GROUP BY repo, target""",
    "first_samples": _FILES + r""", pat(kind, rx, pattern) AS (VALUES ('t', '(^|/)components/(.*/)?[^/]*\.tsx$', 'React component pattern'), ('t', '(^|/)hooks/(.*/)?[^/]*\.ts$', 'Custom hook pattern'),
          ('t', '(^|/)app/(.*/)?page\.tsx$', 'App Router page pattern'), ('t', '(^|/)api/(.*/)?[^/]*\.ts$', 'API client pattern'), ('j', '(^|/)[^/]*Controller\.java$', 'Controller pattern'),
          ('j', '(^|/)[^/]*Service\.java$', 'Service pattern'), ('j', '(^|/)[^/]*Repository\.java$', 'Repository pattern'), ('j', '(^|/)dto/(.*/)?[^/]*\.java$', 'DTO pattern')),
        h AS (SELECT repo, pattern, path, string_split(content, chr(10)) AS l FROM files JOIN pat ON (kind = 'j') = ends_with(path, '.java') AND regexp_matches(path, rx)
          QUALIFY row_number() OVER (PARTITION BY repo, pattern ORDER BY path) = 1)
        SELECT repo, pattern, path, array_to_string(l[1:100], chr(10)) || CASE WHEN len(l) >= 100 THEN chr(10) || '... (truncated)' ELSE '' END AS sample FROM h""",
    "convention_files": _FILES + """, c AS (SELECT repo, path, content AS text, CASE path WHEN 'CONVENTIONS.md' THEN 0 WHEN 'CLAUDE.md' THEN 1 WHEN '.claude/instructions.md' THEN 2
          WHEN 'README.md' THEN CASE WHEN contains(lower(content), 'convention') OR contains(lower(content), 'style') THEN 3 END END AS prio FROM files)
        SELECT repo, path, text FROM c WHERE prio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY prio) = 1""",
}
