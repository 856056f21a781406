"""Queries of sync, mutations and re-processing, with their SQL.

The listing of a pass is the dump of the last complete run; each of its rows is one listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.operators import mutations, rebake, sync
from anchorloom.operators.phrases import generate_terms
from anchorloom.plans.fixture import PAGES, SETTINGS, VIEWS, pages
from anchorloom.plans.texts import _EXCLUDED, _STRIP, GATED, _cut
from anchorloom.sources.catalog import Catalog
from anchorloom.sources.sitemaps import fetch_pages

QUERIES, ORACLES = {}, {}
NOW = "2025-11-24 03:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Catalog(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def listing(c: Catalog) -> DataFrame:
    """Rows (ordinal, loc, content_type, lastmod, sitemap_id) of the last complete run's dump."""
    last = c.runs.where(F.col("success") & ~F.col("partial") & F.col("finished_at").isNotNull()).agg(F.max(F.struct("started_at", "id")).alias("r")).select(F.col("r.id").alias("run_id"))
    rows = c.raw("sitemap_autolink_entry_snapshots").join(last, "run_id")
    ordinal = F.struct(F.coalesce("sitemap_id", F.lit(-1)).alias("a"), F.col("entry_id").alias("b"), F.coalesce("lastmod", F.lit("")).alias("c"))
    return rows.select(ordinal.alias("ordinal"), F.col("url").alias("loc"), "content_type", "lastmod", "sitemap_id")


def admitted(c: Catalog) -> DataFrame:
    return sync.admission(listing(c), SETTINGS)


LISTED = PAGES + r""",
ls AS (SELECT regexp_replace(regexp_replace(url, '^\s+', ''), '[\s/]+$', '') AS url, content_type, lastmod, sitemap_id, entry_id FROM sitemap_autolink_entry_snapshots
  WHERE run_id = (SELECT id FROM sitemap_autolink_sync_runs WHERE success AND NOT partial AND finished_at IS NOT NULL ORDER BY started_at DESC, id DESC LIMIT 1)),
ad AS (SELECT url, content_type, lastmod, sitemap_id, count(*) OVER (PARTITION BY url) AS n_listed, """ + _EXCLUDED.format("url") + r""" OR url NOT ILIKE 'http%' AS excluded FROM ls WHERE url <> ''
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY coalesce(sitemap_id, -1), entry_id, coalesce(lastmod, ''), content_type) = 1),
seen AS (SELECT * FROM ad WHERE NOT excluded)
"""


@query(LISTED + "SELECT url, content_type, n_listed, excluded FROM ad")
def sync_admission(c: Catalog) -> DataFrame:
    return admitted(c).select("url", "content_type", "n_listed", "excluded")


@query(LISTED + "SELECT count(*) FILTER (NOT excluded) AS seen, coalesce(sum(n_listed) FILTER (excluded), 0)::BIGINT AS excluded FROM ad")
def sync_counts(c: Catalog) -> DataFrame:
    return sync.admission_counts(admitted(c))


@query(
    LISTED + "SELECT coalesce(n.url, e.url) AS url, e.id AS entry_id, CASE WHEN e.id IS NULL THEN 'added' WHEN n.url IS NOT NULL AND e.removed_from_source THEN 'restored' WHEN n.url IS NOT NULL THEN 'known' "
    "WHEN e.source = 'sitemap' AND e.auto_discovered AND NOT e.removed_from_source THEN 'removed' ELSE 'untouched' END AS change, coalesce(n.url IS NOT NULL AND e.auto_discovered AND e.content_type <> n.content_type, false) AS retyped "
    "FROM seen n FULL OUTER JOIN e ON e.url = n.url"
)
def sync_diff(c: Catalog) -> DataFrame:
    return sync.diff(admitted(c), c.entries)


_PLAN = f""",
pl AS (SELECT e.id AS entry_id, e.url, n.lastmod, CASE WHEN e.title_source = 'slug' AND NOT (e.next_title_fetch_at IS NULL OR e.next_title_fetch_at <= TIMESTAMP '{NOW}') AND NOT ch THEN 'deferred' WHEN ch OR e.title_source = 'slug' THEN 'refetch' ELSE 'unchanged' END AS decision
  FROM (SELECT e.id AS eid, coalesce(trim(n.lastmod) <> '' AND n.lastmod IS DISTINCT FROM e.lastmod, false) AS ch, n.url FROM e JOIN seen n ON n.url = e.url) x JOIN e ON e.id = x.eid JOIN seen n ON n.url = x.url)
"""


@query(LISTED + _PLAN + "SELECT * FROM pl")
def refetch_plan(c: Catalog) -> DataFrame:
    return sync.refetch_plan(admitted(c), c.entries, F.lit(NOW).cast("timestamp_ntz"))


_PT = r"nullif(trim(CASE WHEN p.id % 7 < 2 THEN p.title ELSE p.title || ' | Example' END, chr(32) || chr(9) || chr(10) || chr(13)), '')"
_SLUG = (
    r"array_to_string(list_transform(string_split(regexp_replace(regexp_extract(regexp_replace(u.url, '/+$', ''), '[^/]*$'), '-+$', ''), '-'), lambda w: CASE WHEN regexp_matches(w, '^\d') THEN w ELSE upper(left(w, 1)) || lower(w[2:]) END), ' ')"
)
_TITLES = f""",
pg AS (SELECT url, min(struct_pack(id := id, title := title)) AS p FROM pages GROUP BY url),
tt AS (SELECT u.url, coalesce({_PT.replace("p.id", "pg.p.id").replace("p.title", "pg.p.title")}, {_SLUG}) AS title, CASE WHEN {_PT.replace("p.id", "pg.p.id").replace("p.title", "pg.p.title")} IS NULL THEN 'slug' ELSE 'page' END AS title_source FROM seen u LEFT JOIN pg ON pg.url = u.url)
"""
#: Titles as pages give them, without suffix cleaning.
PLAIN = SETTINGS.with_(title_suffixes=())


def titles(c: Catalog) -> DataFrame:
    web = pages(c).groupBy("url").agg(F.min(F.struct("id", "html")).alias("p")).select("url", "p.html")
    return sync.resolve_titles(fetch_pages(admitted(c).where(~F.col("excluded")).select("url"), web), PLAIN)


@query(LISTED + _TITLES + "SELECT * FROM tt")
def resolve_titles(c: Catalog) -> DataFrame:
    return titles(c)


@query(
    LISTED + _PLAN + _TITLES + "SELECT pl.entry_id, CASE WHEN tt.title_source = 'page' THEN tt.title ELSE e.title END AS title, CASE WHEN tt.title_source = 'page' THEN 'page' ELSE e.title_source END AS title_source, "
    "CASE WHEN tt.title_source = 'page' THEN 0 ELSE e.title_fetch_failures + 1 END AS failures, CASE WHEN tt.title_source = 'slug' THEN least(pow(2, greatest(e.title_fetch_failures, 0)), 7)::INTEGER END AS retry_days, "
    "CASE WHEN tt.title_source = 'page' AND tt.title <> e.title THEN 'retitled' WHEN tt.title_source = 'page' THEN 'healed' ELSE 'failed' END AS outcome FROM pl JOIN tt ON tt.url = pl.url JOIN e ON e.id = pl.entry_id WHERE pl.decision = 'refetch'"
)
def refetch_outcome(c: Catalog) -> DataFrame:
    plan = sync.refetch_plan(admitted(c), c.entries, F.lit(NOW).cast("timestamp_ntz"))
    return sync.refetch_outcome(plan, titles(c), c.entries)


_REGEN = (
    GATED + ", keep AS (SELECT entry_id, normalized_phrase, min(struct_pack(state := state, origin := origin)) AS k FROM t WHERE (origin <> 'generated' OR state IN ('approved', 'disabled')) AND entry_id IN (SELECT id FROM e) GROUP BY ALL), "
    "rg AS (SELECT entry_id, normalized_phrase, k.state AS state, k.origin AS origin, 'kept' AS change FROM keep UNION ALL SELECT g.entry_id, g.normalized_phrase, CASE WHEN review_reason IS NULL THEN 'auto_active' ELSE 'pending_review' END, 'generated', 'added' "
    "FROM g WHERE NOT EXISTS (SELECT 1 FROM keep WHERE keep.entry_id = g.entry_id AND keep.normalized_phrase = g.normalized_phrase)) "
)


@query(_REGEN + "SELECT * FROM rg")
def regenerate_terms(c: Catalog) -> DataFrame:
    return sync.regenerate_terms(c.terms, c.entries, SETTINGS)


_PDIFF = (
    _REGEN + ", o AS (SELECT DISTINCT entry_id, normalized_phrase AS phrase FROM t WHERE state IN ('auto_active', 'approved')), n AS (SELECT DISTINCT entry_id, normalized_phrase AS phrase FROM rg WHERE state IN ('auto_active', 'approved')), "
    "pd AS (SELECT * FROM (SELECT *, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) WHERE entry_id IN (SELECT id FROM e WHERE enabled AND NOT removed_from_source)) "
)


@query(_PDIFF + "SELECT * FROM pd")
def phrase_diff(c: Catalog) -> DataFrame:
    return sync.phrase_diff(c.terms, regenerate_terms(c), c.entries)


@query(_PDIFF + ", k AS (SELECT count(DISTINCT phrase) AS n_phrases FROM pd) SELECT n_phrases, CASE WHEN n_phrases = 0 THEN 'none' WHEN n_phrases > 50 THEN 'skip' ELSE 'rebake' END AS decision FROM k")
def rebake_gate(c: Catalog) -> DataFrame:
    return rebake.gate(phrase_diff(c), SETTINGS)


@query(
    VIEWS + f", c0 AS (SELECT id, {_STRIP.format('title')} AS title FROM e WHERE auto_discovered AND NOT removed_from_source)" + "".join(_cut(f"c{i + 1}", f"c{i}") for i in range(6))
    + " SELECT c6.id AS entry_id, c6.title FROM c6 JOIN e ON e.id = c6.id WHERE c6.title <> '' AND c6.title <> e.title"
)
def reclean_titles(c: Catalog) -> DataFrame:
    return sync.reclean_titles(c.entries, SETTINGS.title_suffixes)


@query(LISTED + "SELECT id AS entry_id FROM e WHERE source = 'sitemap' AND auto_discovered AND NOT removed_from_source AND url NOT IN (SELECT url FROM seen)")
def mark_removed(c: Catalog) -> DataFrame:
    return sync.mark_removed(c.entries, admitted(c).where(~F.col("excluded")), clean=True)


@query(
    LISTED + ", ob AS (SELECT DISTINCT entry_id, sitemap_id FROM ls WHERE sitemap_id IS NOT NULL), rd AS (SELECT id AS sitemap_id FROM s WHERE status = 'enabled') "
    "SELECT coalesce(o.entry_id, m.entry_id) AS entry_id, coalesce(o.sitemap_id, m.sitemap_id) AS sitemap_id, CASE WHEN m.entry_id IS NULL THEN 'added' WHEN o.entry_id IS NOT NULL THEN 'seen' "
    "WHEN coalesce(o.sitemap_id, m.sitemap_id) IN (SELECT sitemap_id FROM rd) THEN 'pruned' ELSE 'kept' END AS change FROM ob o FULL OUTER JOIN m ON m.entry_id = o.entry_id AND m.sitemap_id = o.sitemap_id"
)
def membership_diff(c: Catalog) -> DataFrame:
    obs = listing(c).select(F.col("ordinal.b").alias("entry_id"), "sitemap_id").where(F.col("sitemap_id").isNotNull())
    return sync.membership_diff(obs, c.memberships, c.sitemaps.where(F.col("status") == "enabled").select(F.col("id").alias("sitemap_id")))


@query(LISTED + "SELECT s.url, min(s.content_type) AS content_type, count(DISTINCT e.id) AS n_entries FROM m JOIN s ON s.id = m.sitemap_id JOIN e ON e.id = m.entry_id GROUP BY s.url")
def membership_backfill(c: Catalog) -> DataFrame:
    s = c.sitemaps.select(F.col("id").alias("sitemap_id"), "url", "content_type")
    m = c.memberships.join(c.entries.select(F.col("id").alias("entry_id")), "entry_id").join(s, "sitemap_id")
    return m.groupBy("url").agg(F.min("content_type").alias("content_type"), F.countDistinct("entry_id").alias("n_entries"))


@query(LISTED + "SELECT DISTINCT parent_url AS url FROM s WHERE parent_url <> '' AND parent_url NOT IN (SELECT url FROM s)")
def undiscovered_sources(c: Catalog) -> DataFrame:
    p = c.sitemaps.where(F.col("parent_url") != "").select(F.col("parent_url").alias("url")).distinct()
    return p.join(c.sitemaps.select("url"), "url", "left_anti")


@query(LISTED + ", pv AS (SELECT sitemap_id, url, excluded, row_number() OVER (PARTITION BY sitemap_id ORDER BY url) AS k FROM ad) SELECT sitemap_id, url FROM pv WHERE k <= 3 AND sitemap_id IS NOT NULL")
def preview_sample(c: Catalog) -> DataFrame:
    return sync.first_by(admitted(c).where(F.col("sitemap_id").isNotNull()).select("sitemap_id", "url"), "sitemap_id", "url", 3).select("sitemap_id", "url")


@query(LISTED + "SELECT content_type, count(*) AS total, count(*) FILTER (excluded) AS excluded FROM ad GROUP BY ALL")
def preview_counts(c: Catalog) -> DataFrame:
    return admitted(c).groupBy("content_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("excluded").alias("excluded"))


@query()
def preview_phrases(c: Catalog) -> DataFrame:
    t = titles(c).withColumn("id", F.xxhash64("url"))
    return generate_terms(t, SETTINGS).join(t.select(F.col("id").alias("entry_id"), "url"), "entry_id").select("url", "phrase", "state")


# --- Mutations
@query(LISTED + "SELECT t.id, CASE WHEN t.state = 'pending_review' AND e.content_type = 'wiki' THEN 'approved' ELSE t.state END AS state FROM t LEFT JOIN e ON e.id = t.entry_id")
def bulk_terms(c: Catalog) -> DataFrame:
    t = c.terms.join(c.entries.select(F.col("id").alias("entry_id"), "content_type"), "entry_id", "left")
    return mutations.set_state(t, (F.col("state") == "pending_review") & F.coalesce(F.col("content_type") == "wiki", F.lit(False)), "approved").select("id", "state")


@query(
    LISTED + ", dm AS (SELECT id FROM e WHERE removed_from_source) SELECT 'entries' AS table_name, count(*) AS n FROM e WHERE id NOT IN (SELECT id FROM dm) UNION ALL SELECT 'terms', count(*) FROM t WHERE entry_id NOT IN (SELECT id FROM dm) "
    "UNION ALL SELECT 'memberships', count(*) FROM m WHERE entry_id NOT IN (SELECT id FROM dm)"
)
def purge_gone(c: Catalog) -> DataFrame:
    out = None
    for name, df in zip(("entries", "terms", "memberships"), mutations.purge(c.entries, c.terms, c.memberships), strict=True):
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(LISTED + ", off AS (SELECT id FROM s WHERE status = 'ignored') SELECT DISTINCT m.entry_id FROM m JOIN e ON e.id = m.entry_id WHERE e.source = 'sitemap' AND m.sitemap_id IN (SELECT id FROM off) AND m.entry_id NOT IN (SELECT entry_id FROM m WHERE sitemap_id NOT IN (SELECT id FROM off))")
def detach_orphans(c: Catalog) -> DataFrame:
    return mutations.detach(c.memberships, c.entries, c.sitemaps.where(F.col("status") == "ignored").select(F.col("id").alias("sitemap_id")))


@query(
    LISTED + "SELECT 'entry_url_repeated' AS check_name, count(*) AS n FROM (SELECT url FROM e GROUP BY url HAVING count(*) > 1) UNION ALL SELECT 'entry_blank', count(*) FROM e WHERE NOT (coalesce(regexp_matches(url, '\\S'), false) AND coalesce(regexp_matches(title, '\\S'), false) AND coalesce(regexp_matches(content_type, '\\S'), false)) "
    "UNION ALL SELECT 'term_repeated', count(*) FROM (SELECT 1 FROM t GROUP BY entry_id, normalized_phrase HAVING count(*) > 1) UNION ALL SELECT 'term_blank', count(*) FROM t WHERE NOT coalesce(regexp_matches(phrase, '\\S'), false) "
    "UNION ALL SELECT 'sitemap_url_repeated', count(*) FROM (SELECT url FROM s GROUP BY url HAVING count(*) > 1) UNION ALL SELECT 'sitemap_status', count(*) FROM s WHERE status NOT IN ('pending', 'enabled', 'ignored') "
    "UNION ALL SELECT 'membership_repeated', count(*) FROM (SELECT 1 FROM m GROUP BY entry_id, sitemap_id HAVING count(*) > 1)"
)
def integrity_checks(c: Catalog) -> DataFrame:
    return mutations.integrity(c.entries, c.terms, c.sitemaps, c.memberships)


# --- Re-processing
def changed_phrases(c: Catalog) -> DataFrame:
    """Phrases of manual terms stand for those that a sync changed."""
    return rebake.wave_phrases(c.terms.where(F.col("origin") == "manual").select(F.col("normalized_phrase").alias("phrase")))


_WAVE = LISTED + (
    ", w AS (SELECT DISTINCT trim(normalized_phrase, chr(32) || chr(9) || chr(10) || chr(13)) AS phrase FROM t WHERE origin = 'manual' AND length(trim(normalized_phrase, chr(32) || chr(9) || chr(10) || chr(13))) >= 3), "
    "sp AS (SELECT lower(x) AS x FROM (SELECT unnest([phrase, replace(phrase, '''', '’'), replace(phrase, '''', '‘')]) AS x FROM w)), "
    "cd AS (SELECT DISTINCT p.id FROM p JOIN sp ON contains(lower(p.raw), sp.x) WHERE p.deleted_at IS NULL) "
)


@query(_WAVE + "SELECT id FROM cd")
def rebake_candidates(c: Catalog) -> DataFrame:
    return rebake.candidates(c.posts, changed_phrases(c)).select("id")


@query(_WAVE.replace("origin = 'manual'", "state IN ('auto_active', 'approved')") + "SELECT id FROM cd")
def rebake_all_phrases(c: Catalog) -> DataFrame:
    """A wave over every phrase that can link."""
    return rebake.candidates(c.posts, rebake.all_phrases(c.terms)).select("id")


@query(_WAVE + "SELECT id FROM cd WHERE id > 500 ORDER BY id LIMIT 200")
def rebake_batch(c: Catalog) -> DataFrame:
    return rebake.batch(c.posts, changed_phrases(c), after_id=500, budget=SETTINGS.max_rebakes_per_job_run)
