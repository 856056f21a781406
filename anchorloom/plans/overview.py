"""Queries of reports, lists and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.filters import active
from anchorloom.operators import listing, reports
from anchorloom.plans.fixture import MAPPINGS, SETTINGS, VIEWS
from anchorloom.plans.linking import RULES, _SAFE, every_rule, hits_sql
from anchorloom.settings import TERM_STATES
from anchorloom.sources.catalog import Catalog
from anchorloom.sources.http import fetch_telemetry as telemetry
from anchorloom.streaming.posts import click_payload

QUERIES, ORACLES = {}, {}
AS_OF = "2025-11-24 02:27:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Catalog(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CLAIMS = RULES + f""",
lpairs AS (SELECT DISTINCT phrase, entry_id FROM db WHERE {_SAFE.format("url")}),
own AS (SELECT t.normalized_phrase AS phrase, t.entry_id, e.url, t.state, e.enabled, e.removed_from_source, rs.url AS win_url,
    coalesce(rs.url IS NOT NULL AND rs.entry_id IS NULL, false) AS overridden, lpairs.phrase IS NOT NULL AS pair
  FROM t JOIN e ON e.id = t.entry_id LEFT JOIN lpairs ON lpairs.phrase = t.normalized_phrase AND lpairs.entry_id = t.entry_id LEFT JOIN rs ON rs.phrase = t.normalized_phrase),
cl AS (SELECT phrase, entry_id, url, state, pair AND NOT overridden AS linking, win_url,
    CASE WHEN pair AND NOT overridden THEN NULL WHEN removed_from_source THEN 'page_gone' WHEN NOT enabled THEN 'page_disabled' WHEN state = 'disabled' THEN 'keyword_disabled' WHEN state = 'pending_review' THEN 'keyword_pending'
      WHEN overridden THEN 'override' WHEN NOT {_SAFE.format("url")} THEN 'unlinkable_url' ELSE 'settings' END AS reason FROM own),
dup AS (SELECT phrase FROM cl GROUP BY phrase HAVING count(DISTINCT entry_id) > 1)
"""


@query(RULES + "SELECT normalized_phrase AS phrase, count(DISTINCT entry_id) AS n_entries FROM t GROUP BY ALL HAVING n_entries > 1")
def duplicate_phrases(c: Catalog) -> DataFrame:
    return reports.duplicate_phrases(c.terms)


@query(CLAIMS + "SELECT phrase, entry_id, url, state, linking, reason, reason IS NULL OR reason IN ('keyword_disabled', 'keyword_pending') AS can_win, coalesce(linking AND url = win_url, false) AS winner FROM cl JOIN dup USING (phrase)")
def collision_candidates(c: Catalog) -> DataFrame:
    return reports.collision_candidates(c.terms, c.entries, every_rule(c))


@query(CLAIMS + "SELECT phrase, count(DISTINCT entry_id) AS n_candidates, count(DISTINCT entry_id) FILTER (linking) AS n_linking, max(url) FILTER (linking AND url = win_url) AS winner_url FROM cl JOIN dup USING (phrase) GROUP BY phrase HAVING n_linking > 1")
def collisions(c: Catalog) -> DataFrame:
    return reports.collisions(collision_candidates(c))


_ALL = CLAIMS + ", g AS (SELECT phrase, count(DISTINCT entry_id) AS n_candidates, count(DISTINCT entry_id) FILTER (linking) AS n_linking, max(url) FILTER (linking AND url = win_url) AS winner_url FROM cl JOIN dup USING (phrase) GROUP BY phrase) "


@query(_ALL + "SELECT * FROM g WHERE contains(phrase, 'saw') ORDER BY phrase LIMIT 50")
def collisions_searched(c: Catalog) -> DataFrame:
    return reports.collision_page(collision_candidates(c), "Saw", include_inactive=True)


@query(_ALL + "SELECT count(*) FILTER (n_linking > 1) AS competing, count(*) FILTER (n_linking <= 1) AS settled FROM g")
def collision_totals(c: Catalog) -> DataFrame:
    return reports.collision_totals(collision_candidates(c))


@query(
    CLAIMS + ", w AS (SELECT phrase, max(entry_id) AS wished FROM cl JOIN dup USING (phrase) GROUP BY phrase), x AS (SELECT t.id AS term_id, t.state, CASE WHEN w.wished IS NULL THEN t.state WHEN w.wished = t.entry_id THEN 'approved' ELSE 'disabled' END AS new_state "
    "FROM t LEFT JOIN w ON w.phrase = t.normalized_phrase) SELECT term_id, new_state, new_state <> state AS changed FROM x"
)
def resolve_collision(c: Catalog) -> DataFrame:
    wishes = collision_candidates(c).groupBy("phrase").agg(F.max("entry_id").alias("entry_id"))
    return reports.resolve_collision(c.terms, c.entries, wishes)


_WISHED = (
    VIEWS + ", wi AS (SELECT t.normalized_phrase AS phrase, max(t.entry_id) AS entry_id FROM t JOIN e ON e.id = t.entry_id GROUP BY ALL HAVING count(DISTINCT t.entry_id) > 1), "
    "t2 AS (SELECT t.* REPLACE (CASE WHEN wi.entry_id IS NULL THEN t.state WHEN wi.entry_id = t.entry_id THEN 'approved' ELSE 'disabled' END AS state) FROM t LEFT JOIN wi ON wi.phrase = t.normalized_phrase)"
    + RULES[len(VIEWS) :].replace("FROM t JOIN e", "FROM t2 AS t JOIN e")
)


@query(
    _WISHED + "SELECT wi.phrase, wi.entry_id, coalesce(rs.entry_id = wi.entry_id, false) AS accepted, CASE WHEN rs.entry_id = wi.entry_id THEN NULL WHEN rs.url IS NULL THEN 'no_rule' WHEN rs.entry_id IS NULL THEN 'override' ELSE 'outranked' END AS refusal "
    "FROM wi LEFT JOIN rs ON rs.phrase = wi.phrase"
)
def verify_wishes(c: Catalog) -> DataFrame:
    wishes = collision_candidates(c).groupBy("phrase").agg(F.max("entry_id").alias("entry_id"))
    return reports.verify_wishes(c.spark, c.terms, c.entries, wishes, SETTINGS, MAPPINGS)


_PAIRS = (
    CLAIMS + ", o AS (SELECT phrase, list_sort(list(DISTINCT url)) AS urls FROM cl GROUP BY phrase), "
    "known AS (SELECT coalesce(o.phrase, rs.phrase) AS phrase, CASE WHEN rs.url IS NOT NULL THEN [rs.url] ELSE o.urls END AS dest, rs.url IS NOT NULL AS rule FROM o FULL OUTER JOIN rs ON rs.phrase = o.phrase)"
    + hits_sql("SELECT phrase AS doc_id, phrase AS text FROM known", "known")
    + ", ov AS (SELECT DISTINCT h.phrase, h.doc_id AS covered_by FROM hits h WHERE h.phrase <> h.doc_id), "
    "pr AS (SELECT ov.phrase, ov.covered_by, a.dest = b.dest AS same_destination, a.rule AND b.rule AS live, a.rule AS linking FROM ov JOIN known a ON a.phrase = ov.phrase JOIN known b ON b.phrase = ov.covered_by) "
)


@query(_PAIRS + "SELECT * FROM pr")
def overlap_pairs(c: Catalog) -> DataFrame:
    return reports.overlap_pairs(c.terms, c.entries, every_rule(c))


@query(_PAIRS + "SELECT phrase, count(*) AS n_covering FROM pr WHERE NOT same_destination GROUP BY phrase HAVING bool_or(live)")
def overlaps(c: Catalog) -> DataFrame:
    return reports.overlaps(overlap_pairs(c))


@query(_PAIRS + "SELECT phrase, count(*) AS n_covering FROM pr WHERE contains(phrase, 'gauge') OR contains(covered_by, 'gauge') GROUP BY phrase ORDER BY phrase LIMIT 50")
def overlaps_searched(c: Catalog) -> DataFrame:
    return reports.overlap_page(overlap_pairs(c), "Gauge", include_inactive=True)


@query(
    _PAIRS + ", g AS (SELECT phrase, bool_or(NOT same_destination) AS other, bool_or(NOT same_destination AND live) AS active, count(*) FILTER (same_destination) AS same FROM pr GROUP BY phrase) "
    "SELECT count(*) FILTER (active) AS active, count(*) FILTER (other AND NOT active) AS settled, coalesce(sum(same), 0)::BIGINT AS same_destination FROM g"
)
def overlap_totals(c: Catalog) -> DataFrame:
    return reports.overlap_totals(overlap_pairs(c))


@query("SELECT id, started_at, success, urls_seen FROM sitemap_autolink_sync_runs ORDER BY started_at DESC, id DESC LIMIT 1")
def last_run(c: Catalog) -> DataFrame:
    return reports.last_run(c.runs).select("id", "started_at", "success", "urls_seen")


@query(RULES + ", f AS (SELECT t.state FROM t JOIN e ON e.id = t.entry_id WHERE e.enabled AND NOT e.removed_from_source) SELECT x.state, (SELECT count(*) FROM f WHERE f.state = x.state) AS n FROM (VALUES ('auto_active'), ('pending_review'), ('approved'), ('disabled')) AS x(state)")
def state_counts(c: Catalog) -> DataFrame:
    return reports.state_counts(listing.list_terms(c.terms, c.entries, state_of_page="live"))


_STATS = {
    "stats_pages": "SELECT count(*) AS total, count(*) FILTER (enabled AND NOT removed_from_source) AS live, count(*) FILTER (NOT enabled AND NOT removed_from_source) AS disabled, count(*) FILTER (removed_from_source) AS gone, count(*) FILTER (NOT auto_discovered) AS manual FROM e",
    "stats_keywords": "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in TERM_STATES) + ", count(*) FILTER (origin = 'manual') AS manual FROM t",
    "stats_sitemaps": "SELECT count(*) AS total, count(*) FILTER (status = 'enabled') AS enabled, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (status = 'enabled' AND kind <> 'index') AS importing, count(*) FILTER (kind = 'index') AS indexes FROM s",
    "stats_linking": f"SELECT (SELECT count(*) FROM rs) AS rules, (SELECT count(*) FROM (SELECT phrase FROM (SELECT DISTINCT phrase, entry_id FROM db WHERE {_SAFE.format('url')}) WHERE phrase NOT IN (SELECT phrase FROM rs WHERE entry_id IS NULL) GROUP BY phrase HAVING count(*) > 1)) AS contested",
}


@query(RULES + _STATS["stats_pages"])
def stats_pages(c: Catalog) -> DataFrame:
    return reports.stats_pages(c.entries)


@query(RULES + _STATS["stats_keywords"])
def stats_keywords(c: Catalog) -> DataFrame:
    return reports.stats_keywords(c.terms)


@query(RULES + _STATS["stats_sitemaps"])
def stats_sitemaps(c: Catalog) -> DataFrame:
    return reports.stats_sitemaps(c.sitemaps)


@query(RULES + _STATS["stats_linking"])
def stats_linking(c: Catalog) -> DataFrame:
    return reports.stats_linking(every_rule(c))


def _long(df: DataFrame, part: str) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(f"{part}.{x}").alias("figure"), F.col(x).cast("long").alias("n")) for x in df.columns])).alias("x")).select("x.*")


def _long_sql(sql: str, part: str) -> str:
    return f"SELECT '{part}.' || name AS figure, value AS n FROM (UNPIVOT ({sql}) ON COLUMNS(*))"


@query(RULES + " UNION ALL ".join(_long_sql(sql, name[6:]) for name, sql in _STATS.items()))
def status(c: Catalog) -> DataFrame:
    parts = {"pages": stats_pages(c), "keywords": stats_keywords(c), "sitemaps": stats_sitemaps(c), "linking": stats_linking(c)}
    out = None
    for name, df in parts.items():
        out = _long(df, name) if out is None else out.unionByName(_long(df, name))
    return out


@query(
    RULES + ", mm AS (SELECT m.sitemap_id, count(*) FILTER (e.enabled AND NOT e.removed_from_source) AS live, count(*) FILTER (e.removed_from_source) AS gone FROM m JOIN e ON e.id = m.entry_id GROUP BY ALL), "
    "kids AS (SELECT parent_url, count(*) AS n_children, count(*) FILTER (status = 'pending') AS pending_children FROM s WHERE parent_url <> '' GROUP BY ALL) "
    "SELECT s.id AS sitemap_id, coalesce(live, 0) AS live, coalesce(gone, 0) AS gone, coalesce(n_children, 0) AS n_children, coalesce(pending_children, 0) AS pending_children FROM s LEFT JOIN mm ON mm.sitemap_id = s.id LEFT JOIN kids ON kids.parent_url = s.url"
)
def sitemap_stats(c: Catalog) -> DataFrame:
    return reports.sitemap_stats(c.sitemaps, c.memberships, c.entries)


@query(RULES + "SELECT id, coalesce(nullif(parent_url, ''), url) AS group_url, coalesce(parent_url, '') <> '' AS is_child, url FROM s ORDER BY group_url, is_child, url, id")
def sitemap_tree(c: Catalog) -> DataFrame:
    parent = F.nullif(F.coalesce("parent_url", F.lit("")), F.lit(""))
    t = c.sitemaps.select("id", F.coalesce(parent, "url").alias("group_url"), parent.isNotNull().alias("is_child"), "url")
    return t.orderBy("group_url", "is_child", "url", "id")


@query(RULES + "SELECT DISTINCT content_type FROM e")
def entry_types(c: Catalog) -> DataFrame:
    return c.entries.select("content_type").distinct()


@query(RULES + "SELECT content_type, count(*) AS n FROM e WHERE enabled AND NOT removed_from_source GROUP BY ALL")
def type_breakdown(c: Catalog) -> DataFrame:
    return c.entries.where(active()).groupBy("content_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "content_type")


@query(RULES + "SELECT id, url FROM e ORDER BY content_type, title, id LIMIT 50 OFFSET 100")
def entries_page(c: Catalog) -> DataFrame:
    return listing.page_of(c.entries, ["content_type", "title", "id"], 2).select("id", "url")


@query(RULES + "SELECT DISTINCT e.id FROM e WHERE contains(lower(e.url), 'reed') OR contains(lower(e.title), 'reed') OR EXISTS (SELECT 1 FROM t WHERE t.entry_id = e.id AND (contains(lower(t.phrase), 'reed') OR contains(lower(t.normalized_phrase), 'reed')))")
def entries_search(c: Catalog) -> DataFrame:
    return listing.search_entries(c.entries, c.terms, "Reed").select("id")


@query(RULES + "SELECT DISTINCT e.id, e.url FROM e WHERE e.id IN (SELECT entry_id FROM t WHERE state = 'pending_review')")
def review_queue_pages(c: Catalog) -> DataFrame:
    q = c.terms.where(F.col("state") == "pending_review").select(F.col("entry_id").alias("id"))
    return c.entries.join(q, "id", "left_semi").select("id", "url")


@query(RULES + "SELECT id FROM e WHERE id IN (SELECT entry_id FROM m WHERE sitemap_id IN (SELECT id FROM s WHERE status = 'enabled' AND kind <> 'index'))")
def entries_by_sitemap(c: Catalog) -> DataFrame:
    s = c.sitemaps.where((F.col("status") == "enabled") & (F.col("kind") != "index"))
    return listing.entries_in_sitemap(c.entries, c.memberships, s).select("id")


@query(RULES + "SELECT id, url FROM s WHERE id IN (SELECT sitemap_id FROM m JOIN e ON e.id = m.entry_id)")
def entry_sitemaps(c: Catalog) -> DataFrame:
    m = c.memberships.join(c.entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select(F.col("sitemap_id").alias("id"))
    return c.sitemaps.join(m, "id", "left_semi").select("id", "url")


@query(
    RULES + "SELECT t.id, t.entry_id, t.phrase, t.normalized_phrase, t.state, t.origin, e.url, e.title FROM t JOIN e ON e.id = t.entry_id WHERE e.enabled AND NOT e.removed_from_source AND t.state = 'auto_active' AND e.content_type = 'product' "
    "AND (contains(lower(t.phrase), 'bow') OR contains(lower(t.normalized_phrase), 'bow') OR contains(lower(e.title), 'bow') OR contains(lower(e.url), 'bow'))"
)
def terms_list(c: Catalog) -> DataFrame:
    return listing.list_terms(c.terms, c.entries, state="auto_active", state_of_page="live", content_type="product", origin="nonsense", query="Bow").orderBy("normalized_phrase", "id")


@query(
    RULES + ", pg AS (SELECT * FROM e ORDER BY title, id LIMIT 50), ph AS (SELECT DISTINCT pg.id AS entry_id, t.normalized_phrase AS np FROM pg JOIN t ON t.entry_id = pg.id), "
    "rv AS (SELECT normalized_phrase AS np, count(DISTINCT entry_id) AS n FROM t GROUP BY ALL) "
    "SELECT pg.id AS entry_id, coalesce((SELECT string_agg(np, '|' ORDER BY np) FROM ph WHERE ph.entry_id = pg.id), '') AS phrases, "
    "coalesce((SELECT string_agg(u, '|' ORDER BY u) FROM (SELECT DISTINCT m.entry_id AS eid, s.url AS u FROM m JOIN s ON s.id = m.sitemap_id) x WHERE x.eid = pg.id), '') AS sitemap_urls, "
    "coalesce((SELECT max(n) > 1 FROM ph JOIN rv USING (np) WHERE ph.entry_id = pg.id), false) AS has_duplicate FROM pg"
)
def entries_cards(c: Catalog) -> DataFrame:
    return listing.entry_cards(listing.page_of(c.entries, ["title", "id"], 0), c.terms, c.memberships, c.sitemaps)


@query("SELECT id, started_at FROM sitemap_autolink_sync_runs ORDER BY started_at DESC, id DESC LIMIT 30")
def recent_runs(c: Catalog) -> DataFrame:
    return c.runs.orderBy(F.desc("started_at"), F.desc("id")).limit(30).select("id", "started_at")


@query(
    f"SELECT id, CASE WHEN finished_at IS NOT NULL THEN CASE WHEN NOT success THEN 'failed' WHEN partial THEN 'partial' ELSE 'ok' END "
    f"WHEN datediff('second', greatest(updated_at, started_at), TIMESTAMP '{AS_OF}') <= 90 THEN 'running' ELSE 'interrupted' END AS result FROM sitemap_autolink_sync_runs"
)
def run_results(c: Catalog) -> DataFrame:
    return c.runs.select("id", reports.run_result(F.lit(AS_OF).cast("timestamp_ntz")).alias("result"))


@query("SELECT count(*) AS n_runs, count(*) FILTER (success) AS n_ok, sum(urls_seen)::BIGINT AS urls_seen, sum(urls_excluded)::BIGINT AS urls_excluded, sum(entries_added)::BIGINT AS entries_added, sum(entries_removed)::BIGINT AS entries_removed FROM sitemap_autolink_sync_runs")
def run_summary(c: Catalog) -> DataFrame:
    return c.runs.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("success").alias("n_ok"), *[F.sum(x).alias(x) for x in ("urls_seen", "urls_excluded", "entries_added", "entries_removed")])


@query(RULES + "SELECT content_type, id, title FROM e WHERE enabled AND NOT removed_from_source QUALIFY row_number() OVER (PARTITION BY content_type ORDER BY id) <= 3")
def report_sample_entries(c: Catalog) -> DataFrame:
    from anchorloom.operators.sync import first_by

    return first_by(c.entries.where(active()).select("content_type", "id", "title"), "content_type", "id", 3).drop("rank")


def fetched(c: Catalog) -> DataFrame:
    """Events stand for fetches: their value for seconds, errors and purchases for failed ones."""
    failed = F.col("event_type").isin("error", "purchase")
    return c.raw("events").select(F.col("event_id").cast("string").alias("url"), F.when(~failed, F.lit(b"x")).alias("body"), F.col("value").alias("seconds"))


_FETCHED = "WITH f AS (SELECT event_id::VARCHAR AS url, event_type IN ('error', 'purchase') AS failed, value AS seconds FROM events) "


@query(_FETCHED + "SELECT count(*) AS n_fetches, count(*) FILTER (failed) AS n_failed, round(sum(seconds), 2) AS total_seconds, round(avg(seconds), 4) AS mean_seconds FROM f")
def fetch_telemetry(c: Catalog) -> DataFrame:
    return telemetry(fetched(c)).select("n_fetches", "n_failed", F.round("total_seconds", 2).alias("total_seconds"), F.round("mean_seconds", 4).alias("mean_seconds"))


@query(_FETCHED + "SELECT url, seconds FROM f ORDER BY seconds DESC, url LIMIT 5")
def slowest_fetches(c: Catalog) -> DataFrame:
    return telemetry(fetched(c)).select(F.explode("slowest").alias("x")).select("x.url", "x.seconds")


@query("SELECT event_type AS link_type, 'x' || user_id AS matched_term, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE '77' END AS topic_id, count(*) AS clicks FROM events GROUP BY ALL")
def click_events(c: Catalog) -> DataFrame:
    """Clicks as pages report them; half of them name no topic, which the address then gives."""
    even = F.col("event_id") % 2 == 0
    payload = F.to_json(F.struct(F.col("event_type").alias("link_type"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("matched_term"), F.when(even, F.col("user_id").cast("string")).alias("topic_id")))
    clicks = click_payload(c.raw("events").select(payload.alias("payload"), F.lit("https://forum.example/t/some-title/77").alias("url")))
    return clicks.groupBy("link_type", "matched_term", "topic_id").agg(F.count(F.lit(1)).alias("clicks"))

