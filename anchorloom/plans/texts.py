"""Queries over urls, titles, phrases and sitemap documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.filters import contains_literal, ingestible, page_state, safe_url, url_excluded
from anchorloom.functions.text import clean_title, normalize_text, retry_days, slug_title, title_from_html
from anchorloom.functions.urls import page_url
from anchorloom.operators import phrases as ph
from anchorloom.plans.fixture import DOCS, PAGES, SETTINGS, VIEWS, pages, sitemap_docs
from anchorloom.settings import parse_rewrites
from anchorloom.sources import sitemaps as sm
from anchorloom.sources.catalog import Catalog

QUERIES, ORACLES = {}, {}
PATTERNS = SETTINGS.excluded_url_patterns
SUFFIXES = SETTINGS.title_suffixes


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Catalog(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NORM = "lower(translate({0}, '’‘' || chr(160), ''''' '))"
_EXCLUDED = r"(regexp_matches({0}, '(?i)/blog/') OR regexp_matches({0}, '(?i)kb\.corvale.*kit'))"
_SAFE = r"regexp_matches(translate({0}, chr(9) || chr(10) || chr(13), ''), '(?i)^(https?://|/([^/\\]|$))')"


@query(VIEWS + "SELECT id, " + NORM.format("phrase") + " AS norm, length(" + NORM.format("phrase") + ")::INTEGER AS n FROM t")
def normalize_text_q(c: Catalog) -> DataFrame:
    return c.terms.select("id", normalize_text("phrase").alias("norm"), F.length(normalize_text("phrase")).alias("n"))


@query(r"SELECT DISTINCT url AS raw, regexp_replace(regexp_replace(url, '^\s+', ''), '[\s/]+$', '') AS url FROM sitemap_autolink_entry_snapshots")
def normalize_url(c: Catalog) -> DataFrame:
    return c.raw("sitemap_autolink_entry_snapshots").select(F.col("url").alias("raw"), page_url("url").alias("url")).distinct()


@query(VIEWS + "SELECT id, " + _EXCLUDED.format("url") + " AS excluded FROM e")
def url_excluded_q(c: Catalog) -> DataFrame:
    return c.entries.select("id", url_excluded("url", PATTERNS).alias("excluded"))


@query(VIEWS + "SELECT id FROM e WHERE url ILIKE 'http%' AND NOT " + _EXCLUDED.format("url"))
def ingestible_q(c: Catalog) -> DataFrame:
    return c.entries.where(ingestible("url", PATTERNS)).select("id")


_ODD = "CASE id % 6 WHEN 0 THEN url WHEN 1 THEN '/t/' || id WHEN 2 THEN '//' || url WHEN 3 THEN '/' || chr(92) || url WHEN 4 THEN '/' || chr(9) || '/' || id ELSE 'javascript:' || id END"


@query(VIEWS + f"SELECT id, {_SAFE.format('u')} AS safe FROM (SELECT id, {_ODD} AS u FROM e)")
def safe_url_q(c: Catalog) -> DataFrame:
    return c.entries.select("id", F.expr(_ODD.replace("chr(92)", "char(92)").replace("chr(9)", "char(9)")).alias("u")).select("id", safe_url("u").alias("safe"))


@query(VIEWS + "SELECT id FROM e WHERE contains(lower(title), '100%') OR contains(lower(title), '_title')")
def search_literal(c: Catalog) -> DataFrame:
    return c.entries.where(contains_literal("title", "100%") | contains_literal("title", "_TITLE")).select("id")


@query(
    VIEWS + "SELECT 'live' AS page_state, count(*) FILTER (enabled AND NOT removed_from_source) AS n FROM e UNION ALL SELECT 'disabled', count(*) FILTER (NOT enabled) FROM e "
    "UNION ALL SELECT 'removed', count(*) FILTER (removed_from_source) FROM e UNION ALL SELECT 'any', count(*) FROM e"
)
def page_state_counts(c: Catalog) -> DataFrame:
    one = c.entries.agg(*[F.count_if(page_state(s)).alias(s) for s in ("live", "disabled", "removed", "any")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("page_state"), F.col(s).alias("n")) for s in ("live", "disabled", "removed", "any")])).alias("x")).select("x.*")


_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x00]+', ''), '[\s\x00]+$', '')"


@query(PAGES + f"SELECT url, id, nullif({_STRIP.format('CASE WHEN id % 7 < 2 THEN title ELSE title || chr(32) || chr(124) || chr(32) || ' + chr(39) + 'Example' + chr(39) + ' END')}, '') AS page_title FROM every_page")
def extract_title(c: Catalog) -> DataFrame:
    return pages(c, answered=False).select("url", "id", title_from_html("html").alias("page_title"))


def _cut(step: str, prev: str) -> str:
    hit = " ".join(f"WHEN lower(title) LIKE '%{s.lower()}' THEN {len(s)}" for s in SUFFIXES)
    left = f"rtrim(left(title, length(title) - n), ' ' || chr(9) || chr(10))"
    return f", {step} AS (SELECT id, CASE WHEN n IS NULL THEN title ELSE trim(regexp_replace({left}, '[\\s|\\-–—·:•]+$', '')) END AS title FROM (SELECT id, title, CASE {hit} END AS n FROM {prev}))"


@query(
    VIEWS + f", c0 AS (SELECT id, {_STRIP.format('title')} AS title FROM e)" + "".join(_cut(f"c{i + 1}", f"c{i}") for i in range(6)) + " SELECT id, nullif(title, '') AS cleaned FROM c6"
)
def clean_title_q(c: Catalog) -> DataFrame:
    return c.entries.select("id", clean_title("title", SUFFIXES).alias("cleaned"))


@query(
    VIEWS + r"SELECT id, array_to_string(list_transform(string_split(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '-+$', ''), '-'), "
    r"lambda w: CASE WHEN regexp_matches(w, '^\d') THEN w ELSE upper(left(w, 1)) || lower(w[2:]) END), ' ') AS slug FROM e"
)
def slug_title_q(c: Catalog) -> DataFrame:
    return c.entries.select("id", slug_title("url").alias("slug"))


@query(VIEWS + "SELECT id, least(pow(2, greatest(title_fetch_failures - 1, 0)), 7)::INTEGER AS days FROM e")
def retry_backoff(c: Catalog) -> DataFrame:
    return c.entries.select("id", retry_days("title_fetch_failures").alias("days"))


# --- Phrases
_TITLE = r"regexp_replace(regexp_replace(regexp_replace(title, '[\s]+', ' ', 'g'), '^ ', ''), ' $', '')"
_LAST = "lower(regexp_extract(v, '[^ ]*$'))"
_NUMBER = (
    rf"CASE WHEN contains(v, ':') OR contains(v, '(') THEN NULL WHEN NOT regexp_matches({_LAST}, 's$') THEN v || CASE WHEN regexp_matches({_LAST}, '(x|z|ch|sh)$') THEN 'es' ELSE 's' END "
    rf"WHEN regexp_matches({_LAST}, '(xes|ses|zes|ches|shes)$') THEN v[:-3] WHEN length({_LAST}) > 4 AND NOT regexp_matches({_LAST}, '(ss|us|is|ns)$') THEN v[:-2] END"
)
_STAGES = [
    (r"CASE WHEN regexp_matches(v, '^[^:]{2,24}:\s+.+$') THEN regexp_extract(v, '^[^:]{2,24}:\s+(.+)$', 1) END", "v1", "v0"),
    (r"CASE WHEN regexp_matches(v, '^.*\S\s*\([^)]*\)$') THEN regexp_extract(v, '^(.*\S)\s*\([^)]*\)$', 1) END", "v2", "v1"),
    (r"CASE WHEN regexp_matches(v, '(?i)^the\s+') THEN regexp_replace(v, '(?i)^the\s+', '') END", "v3", "v2"),
    (_NUMBER, "v4", "v3"),
    (r"CASE WHEN contains(v, ' & ') THEN replace(v, ' & ', ' and ') WHEN regexp_matches(v, '\sand\s') THEN regexp_replace(v, '\sand\s', ' & ', 'g') END", "v5", "v4"),
]
VARIANTS = VIEWS + f", v0 AS (SELECT id, [{_TITLE}] AS vs FROM e WHERE {_TITLE} <> '')" + "".join(
    f", {new} AS (SELECT id, list_concat(vs, list_filter(list_transform(vs, lambda v: {f}), lambda x: x IS NOT NULL)) AS vs FROM {old})" for f, new, old in _STAGES
)
_COMMON = "[" + ", ".join(f"'{w}'" for w in ph.COMMON_WORDS) + "]"
_SINGULAR = f"CASE WHEN length(w) >= 5 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') AND list_contains({_COMMON}, w[:-2]) THEN w[:-2] ELSE w END"
_WORDS = r"list_filter(string_split_regex(norm, '\s+'), lambda w: w <> '')"
GATED = (
    VARIANTS + ", x AS (SELECT id AS entry_id, vs, list_transform(vs, lambda v: " + NORM.format("v") + ") AS ns, unnest(range(1, len(vs) + 1)) AS k FROM v5), "
    "y AS (SELECT entry_id, k, vs[k] AS phrase, ns[k] AS norm FROM x WHERE list_position(ns, ns[k]) = k AND ns[k] <> '' AND ns[k] NOT IN ('aguja de vela', 'fairlead', 'bow saw')), "
    f"z AS (SELECT *, {_WORDS} AS ws FROM y), "
    f"g AS (SELECT entry_id, phrase, norm AS normalized_phrase, CASE WHEN length(norm) < 5 THEN 'too_short' WHEN len(ws) = 1 AND list_contains({_COMMON}, list_transform([norm], lambda w: {_SINGULAR})[1]) THEN 'generic_word' "
    f"WHEN len(ws) <= 2 AND len(list_filter(ws, lambda w: list_contains({_COMMON}, {_SINGULAR}))) = len(ws) THEN 'generic_words' "
    "WHEN len(ws) < 2 AND NOT (regexp_matches(norm, '[a-zA-Z]') AND regexp_matches(norm, '[0-9]')) THEN 'below_min_words' END AS review_reason FROM z) "
)


@query(VARIANTS + "SELECT id, array_to_string(vs, '|') AS variants, len(vs)::INTEGER AS n FROM v5")
def term_variants(c: Catalog) -> DataFrame:
    v = c.entry_rows("title").select("id", ph.variants("title").alias("vs")).where(F.size("vs") > 0)
    return v.select("id", F.array_join("vs", "|").alias("variants"), F.size("vs").alias("n"))


@query(GATED + "SELECT entry_id, phrase, normalized_phrase, CASE WHEN review_reason IS NULL THEN 'auto_active' ELSE 'pending_review' END AS state FROM g")
def generate_terms(c: Catalog) -> DataFrame:
    return ph.generate_terms(c.entry_rows("title"), SETTINGS).select("entry_id", "phrase", "normalized_phrase", "state")


@query(GATED + "SELECT review_reason, count(*) AS n FROM g GROUP BY ALL")
def gate_terms(c: Catalog) -> DataFrame:
    return ph.generate_terms(c.entry_rows("title"), SETTINGS).groupBy("review_reason").agg(F.count(F.lit(1)).alias("n"))


# --- Sitemap documents
_BLOCKS = "b AS (SELECT url, unnest(string_split_regex(xml, '(?i)</(url|sitemap)>')) AS block, unnest(range(len(string_split_regex(xml, '(?i)</(url|sitemap)>')))) AS position FROM docs), "
_LOC = r"replace(replace(replace(replace(regexp_extract(block, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1), '&lt;', '<'), '&#x77;', 'w'), '&#98;', 'b'), '&amp;', '&')"
PARSED = DOCS + ", " + _BLOCKS + rf"parsed AS (SELECT url, position::INTEGER AS position, {_LOC} AS loc, nullif(regexp_extract(block, '(?i)<lastmod>([^<\s]+)</lastmod>', 1), '') AS lastmod FROM b WHERE {_LOC} <> '') "


@query(PARSED + "SELECT * FROM parsed")
def parse_sitemap(c: Catalog) -> DataFrame:
    return sm.parse_sitemap(sitemap_docs(c))


@query(DOCS + "SELECT url, xml LIKE '%</urlset>' OR xml LIKE '%</sitemapindex>' AS complete, CASE WHEN xml LIKE '<sitemapindex%' THEN 'index' ELSE 'urlset' END AS kind FROM docs")
def sitemap_complete(c: Catalog) -> DataFrame:
    return sitemap_docs(c).select("url", sm.is_complete("xml").alias("complete"), sm.sitemap_kind("xml").alias("kind"))


@query(
    PARSED + ", good AS (SELECT url, CASE WHEN xml LIKE '<sitemapindex%' THEN 'index' ELSE 'urlset' END AS kind FROM docs WHERE xml LIKE '%</urlset>' OR xml LIKE '%</sitemapindex>'), "
    "src AS (SELECT DISTINCT s.url FROM s WHERE s.configured OR s.kind = 'index'), "
    "kids AS (SELECT DISTINCT p.url AS source, p.loc AS url FROM parsed p JOIN good USING (url) JOIN src USING (url) WHERE kind = 'index' QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY p.position) <= 100), "
    "reads AS (SELECT url AS source, url FROM src JOIN good USING (url) WHERE kind = 'urlset' UNION ALL "
    "SELECT DISTINCT k.source, k.url FROM kids k JOIN good g USING (url) WHERE g.kind = 'urlset' AND k.url IN (SELECT url FROM s WHERE status = 'enabled')) "
    "SELECT r.source, r.url AS listed_in, p.position, p.loc, p.lastmod FROM reads r JOIN parsed p ON p.url = r.url"
)
def sitemap_expand(c: Catalog) -> DataFrame:
    src = c.sitemaps.where(F.col("configured") | (F.col("kind") == "index")).select("url").distinct()
    return sm.expand(src, sitemap_docs(c), c.sitemaps)


@query(
    PARSED + ", whole AS (SELECT url, xml LIKE '<sitemapindex%' AS idx FROM docs WHERE xml LIKE '%</urlset>' OR xml LIKE '%</sitemapindex>'), src AS (SELECT DISTINCT url FROM s), "
    "ks AS (SELECT p.url AS source, p.loc AS child, row_number() OVER (PARTITION BY p.url ORDER BY p.position) AS k, count(*) OVER (PARTITION BY p.url) AS n FROM parsed p JOIN whole w ON w.url = p.url AND w.idx JOIN src ON src.url = p.url) "
    "SELECT DISTINCT source, child, NULL::BIGINT AS n_children FROM ks WHERE k <= 100 AND child IN (SELECT url FROM s WHERE status = 'enabled') AND child NOT IN (SELECT url FROM whole) "
    "UNION ALL SELECT DISTINCT source, NULL, n FROM ks WHERE n > 100"
)
def sync_unread(c: Catalog) -> DataFrame:
    """What a pass over all sitemaps could not read, so that it removes nothing."""
    return sm.unread(c.sitemaps.select("url").distinct(), sitemap_docs(c), c.sitemaps)


@query(
    PARSED + "SELECT d.url, CASE WHEN xml LIKE '<sitemapindex%' THEN 'index' ELSE 'urlset' END AS kind, (SELECT count(*) FROM parsed p WHERE p.url = d.url) AS url_count, "
    "NOT (xml LIKE '%</urlset>' OR xml LIKE '%</sitemapindex>') AS url_count_partial FROM docs d"
)
def sitemap_measure(c: Catalog) -> DataFrame:
    return sm.measure(sitemap_docs(c))


@query(
    PARSED + ", f AS (SELECT url, regexp_replace(regexp_replace(loc, '^\\s+', ''), '[\\s/]+$', '') AS page FROM parsed QUALIFY row_number() OVER (PARTITION BY url ORDER BY position) <= 20), "
    "k AS (SELECT DISTINCT url AS page FROM e WHERE enabled AND first_seen_at IS NOT NULL), "
    "a AS (SELECT f.url, count(*) AS n_sample, count(k.page) AS n_known FROM f LEFT JOIN k USING (page) WHERE f.page ILIKE 'http%' AND NOT " + _EXCLUDED.format("f.page") + " GROUP BY f.url) "
    "SELECT *, n_known * 2 > n_sample AS adopted FROM a"
)
def sitemap_adopt(c: Catalog) -> DataFrame:
    return sm.adopt(sitemap_docs(c), c.entries.where(F.col("enabled") & F.col("first_seen_at").isNotNull()), PATTERNS)


@query(
    VIEWS + ", old AS (SELECT url, min(parent_url) AS parent_url, min(content_type) AS content_type, min(status) AS status, bool_or(configured) AS configured FROM s WHERE last_fetched_at IS NOT NULL GROUP BY url), "
    "new AS (SELECT url, min(parent_url) AS parent_url, min(content_type) AS content_type, bool_or(configured) AS configured FROM s WHERE last_seen_at IS NOT NULL GROUP BY url) "
    "SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NOT NULL THEN n.parent_url ELSE o.parent_url END AS parent_url, coalesce(n.content_type, o.content_type) AS content_type, "
    "CASE WHEN n.configured THEN 'enabled' WHEN o.url IS NULL THEN 'pending' ELSE o.status END AS status, "
    "coalesce(n.configured, false) OR (NOT EXISTS (SELECT 1 FROM new WHERE configured) AND coalesce(o.configured, false)) AS configured, "
    "CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'kept' ELSE 'seen' END AS change FROM old o FULL OUTER JOIN new n ON o.url = n.url"
)
def sitemap_upsert(c: Catalog) -> DataFrame:
    cols = [F.min("parent_url").alias("parent_url"), F.min("content_type").alias("content_type"), F.max("configured").alias("configured")]
    old = c.sitemaps.where(F.col("last_fetched_at").isNotNull()).groupBy("url").agg(*cols, F.min("status").alias("status"))
    return sm.upsert(old, c.sitemaps.where(F.col("last_seen_at").isNotNull()).groupBy("url").agg(*cols))


_REWRITES = ("www.tarnwick.example=inner:8080", "Shop.Velmora.example=http://10.0.0.1", "bad row", "=x")


@query(
    VIEWS + r"SELECT id, CASE WHEN lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)) = 'www.tarnwick.example' THEN regexp_replace(url, '(?i)^(https?://)[^/?#]*', '\1inner:8080') "
    r"WHEN lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)) = 'shop.velmora.example' THEN regexp_replace(url, '(?i)^https?://[^/?#]*', 'http://10.0.0.1') ELSE url END AS target FROM e"
)
def host_rewrite(c: Catalog) -> DataFrame:
    return c.entries.select("id", sm.rewrite_host("url", parse_rewrites(_REWRITES)).alias("target"))


@query(PAGES + "SELECT e.id, e.url, p.url IS NOT NULL AS fetched FROM e LEFT JOIN (SELECT DISTINCT url FROM pages) p ON p.url = e.url")
def fetch_pages(c: Catalog) -> DataFrame:
    return sm.fetch_pages(c.entries.select("id", "url"), pages(c).select("url", "html")).select("id", "url", "fetched")


for _name in ("normalize_text", "url_excluded", "ingestible", "safe_url", "clean_title", "slug_title"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_q")
    ORACLES[_name] = ORACLES.pop(f"{_name}_q")
