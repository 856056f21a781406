"""Queries of the general training-data problems 1, 3 and 4, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.operators.hierarchy import descendants, hierarchy, url_links
from anchorloom.operators.orphans import orphan_references, orphan_report
from anchorloom.operators.snapshots import snapshot_changes
from anchorloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(spark, table(spark, d, "sitemap_autolink_entry_snapshots"), table(spark, d, "sitemap_autolink_sync_runs"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("run_id", "change_type").agg(F.count(F.lit(1)).alias("n_pages"))


def _tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return hierarchy(spark, url_links(table(spark, d, "sitemap_autolink_sitemaps")), paths)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, paths=False).select(F.col("id").alias("sitemap_id"), "root_id", F.col("depth").alias("tree_depth"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("id").alias("sitemap_id"), F.array_join(F.col("path").cast("array<string>"), "/").alias("tree_path"), "in_cycle")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_tree(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = {t: table(spark, d, t) for t in ("sitemap_autolink_entries", "sitemap_autolink_sitemaps")}
    return orphan_references(table(spark, d, "sitemap_autolink_entry_sitemaps"), parents, table(spark, d, "catalog_deletions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p4_report": p4_report,
}

_P1 = r"""
WITH runs AS (
  SELECT id AS run_id, started_at, lead(id) OVER (ORDER BY started_at, id) AS next_id,
         row_number() OVER (ORDER BY started_at, id) AS k
  FROM sitemap_autolink_sync_runs WHERE success AND NOT partial AND finished_at IS NOT NULL),
st AS (
  SELECT s.run_id, regexp_replace(regexp_replace(s.url, '^\s+', ''), '[\s/]+$', '') AS url,
         regexp_replace(trim(s.title, E' \t\n\r'), '\s+', ' ', 'g') AS title, s.last_seen_at, s.delivered_at
  FROM sitemap_autolink_entry_snapshots s JOIN runs r USING (run_id) WHERE s.last_seen_at >= r.started_at),
pages AS (
  SELECT run_id, url, title FROM st
  QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY last_seen_at DESC, delivered_at DESC, title DESC) = 1),
new AS (SELECT r.run_id AS pair, p.url, p.title FROM pages p JOIN runs r USING (run_id) WHERE r.k > 1),
old AS (SELECT r.next_id AS pair, p.url, p.title FROM pages p JOIN runs r USING (run_id) WHERE r.next_id IS NOT NULL),
diff AS (
  SELECT coalesce(n.pair, o.pair) AS run_id, coalesce(n.url, o.url) AS url,
         CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed'
              WHEN n.title IS DISTINCT FROM o.title THEN 'changed' END AS change_type
  FROM new n FULL OUTER JOIN old o ON n.pair = o.pair AND n.url = o.url)
"""

_P3 = r"""
WITH RECURSIVE cur AS (
  SELECT id, url, parent_url FROM sitemap_autolink_sitemaps WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, url DESC, parent_url DESC) = 1),
cut AS (
  SELECT id, regexp_replace(regexp_replace(url, '^\s+', ''), '[\s/]+$', '') AS u,
         regexp_replace(regexp_replace(parent_url, '^\s+', ''), '[\s/]+$', '') AS p FROM cur),
norm AS (
  SELECT id, lower(regexp_extract(u, '^[A-Za-z]+://[^/?#]*')) || substr(u, length(regexp_extract(u, '^[A-Za-z]+://[^/?#]*')) + 1) AS u,
         lower(regexp_extract(p, '^[A-Za-z]+://[^/?#]*')) || substr(p, length(regexp_extract(p, '^[A-Za-z]+://[^/?#]*')) + 1) AS p FROM cut),
own AS (SELECT u, min(id) AS parent FROM norm WHERE u <> '' GROUP BY u),
links AS (SELECT n.id, o.parent FROM norm n LEFT JOIN own o ON n.p = o.u),
tree AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth, [id] AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.id, t.root_id, t.depth + 1, list_append(t.path, l.id) FROM links l JOIN tree t ON l.parent = t.id),
loose AS (SELECT * FROM links WHERE id NOT IN (SELECT id FROM tree)),
walk AS (
  SELECT id AS start, id AS node FROM loose
  UNION
  SELECT w.start, l.parent FROM walk w JOIN loose l ON l.id = w.node),
onloop AS (SELECT DISTINCT w.start AS id FROM walk w JOIN loose l ON l.id = w.node WHERE l.parent = w.start),
loops AS (
  SELECT w.start AS id, min(w.node) AS root_id FROM walk w JOIN onloop o ON o.id = w.node GROUP BY w.start)
"""

_P4 = """
WITH cur AS (
  SELECT id, entry_id, sitemap_id, created_at FROM sitemap_autolink_entry_sitemaps
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
refs AS (
  SELECT id, 'entry_id' AS ref_field, 'sitemap_autolink_entries' AS table_name, entry_id AS ref_id, created_at FROM cur WHERE entry_id IS NOT NULL
  UNION ALL
  SELECT id, 'sitemap_id', 'sitemap_autolink_sitemaps', sitemap_id, created_at FROM cur WHERE sitemap_id IS NOT NULL),
known AS (
  SELECT 'sitemap_autolink_entries' AS table_name, id, max_by(created_at, updated_at) AS parent_at FROM sitemap_autolink_entries GROUP BY id
  UNION ALL
  SELECT 'sitemap_autolink_sitemaps', id, max_by(created_at, updated_at) FROM sitemap_autolink_sitemaps GROUP BY id),
found AS (
  SELECT r.id AS membership_id, r.ref_field, r.table_name,
         CASE WHEN k.id IS NOT NULL THEN 'late'
              WHEN EXISTS (SELECT 1 FROM catalog_deletions d WHERE d.table_name = r.table_name AND d.record_id = r.ref_id) THEN 'deleted'
              ELSE 'missing' END AS orphan_cause,
         strftime(r.created_at, '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN known k ON k.table_name = r.table_name AND k.id = r.ref_id
  WHERE k.id IS NULL OR k.parent_at > r.created_at)
"""

ORACLES = {
    "p1_found": _P1 + "SELECT * FROM diff WHERE change_type IS NOT NULL",
    "p1_counts": _P1 + "SELECT run_id, change_type, count(*) AS n_pages FROM diff WHERE change_type IS NOT NULL GROUP BY ALL",
    "p3_found": _P3 + "SELECT id AS sitemap_id, root_id, depth AS tree_depth FROM tree UNION ALL SELECT id, root_id, -1 FROM loops",
    "p3_paths": _P3
    + "SELECT id AS sitemap_id, array_to_string(path, '/') AS tree_path, false AS in_cycle FROM tree "
    "UNION ALL SELECT id, NULL, id IN (SELECT id FROM onloop) FROM loose",
    "p3_descendants": _P3
    + "SELECT path[k] AS ancestor_id, id AS descendant_id, (depth + 1 - k)::INTEGER AS distance "
    "FROM (SELECT id, depth, path, unnest(range(1, depth + 1)) AS k FROM tree)",
    "p4_found": _P4 + "SELECT membership_id, ref_field, orphan_cause, ref_month FROM found",
    "p4_report": _P4 + "SELECT table_name, ref_field, orphan_cause, ref_month, count(*) AS n_refs FROM found GROUP BY ALL",
}
