"""Inputs that the test tables lack, derived from them: sitemap documents, web pages, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.settings import Settings
from anchorloom.sources.catalog import Catalog

#: Settings and mappings with which the queries run.
SETTINGS = Settings(
    type_priority=("manual", "docs", "wiki"),
    excluded_terms=("aguja de vela", "fairlead", "bow saw"),
    excluded_url_patterns=("/blog/", "kb.corvale*kit"),
    title_suffixes=(" 2026", " II", "Field Report", " Maintenance"),
    excluded_categories=(3, 7),
)
MAPPINGS = [("Cider Press", "https://shop.example/cider-press", "manual"), ("Bow Saw", "/t/bow-saw", "product"), ("Null Modem", "javascript:alert(1)", "manual"), ("Star Tracker", "//other.example/x", "manual"), ("Patch Cable", "https://www.example/cable", "docs")]
CHUNK = 1000
#: Ids of children that one index document lists; an index has as many documents as it needs.
INDEX_CHUNK = 50_000

#: The current tables, for the SQL: e entries, t terms, s sitemaps, m memberships, p posts.
VIEWS = r"""
WITH RECURSIVE
e AS (SELECT * FROM sitemap_autolink_entries WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, url DESC, title DESC) = 1),
t AS (SELECT * FROM sitemap_autolink_terms WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
s AS (SELECT * REPLACE (regexp_replace(regexp_replace(url, '^\s+', ''), '[\s/]+$', '') AS url,
      regexp_replace(regexp_replace(parent_url, '^\s+', ''), '[\s/]+$', '') AS parent_url, lower(kind) AS kind)
  FROM (SELECT * FROM sitemap_autolink_sitemaps WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, url DESC) = 1)),
m AS (SELECT entry_id, sitemap_id, max(last_seen_at) AS last_seen_at
  FROM (SELECT * FROM sitemap_autolink_entry_sitemaps WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)
  WHERE entry_id IS NOT NULL AND sitemap_id IS NOT NULL GROUP BY ALL),
p AS (SELECT * FROM posts WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1)
"""

DOCS = VIEWS + r""",
listed AS (SELECT s.url || CASE WHEN m.entry_id // 1000 = (SELECT min(m2.entry_id // 1000) FROM m m2 JOIN e e2 ON e2.id = m2.entry_id WHERE m2.sitemap_id = s.id) THEN '' ELSE '?part=' || (m.entry_id // 1000) END AS url,
    m.entry_id, trim(e.url) AS loc, e.lastmod, (m.entry_id // 1000) % 3 = 2 AS cut
  FROM m JOIN e ON e.id = m.entry_id JOIN s ON s.id = m.sitemap_id WHERE s.kind <> 'index' AND e.url IS NOT NULL),
leaf AS (SELECT url, '<?xml version="1.0"?><urlset>' || string_agg('<url><loc> ' || replace(replace(replace(replace(loc, '&', '&amp;'), '<', '&lt;'), '/wiki/', '/&#x77;iki/'), '/blog/', '/&#98;log/') || '</loc>' || coalesce('<lastmod>' || lastmod || '</lastmod>', '') || '</url>', '' ORDER BY entry_id, loc)
    || CASE WHEN bool_or(cut) THEN '' ELSE '</urlset>' END AS xml FROM listed GROUP BY url),
idx AS (SELECT url, '<sitemapindex xmlns="x">' || string_agg('<sitemap><loc>' || child || '</loc></sitemap>', '' ORDER BY id) || '</sitemapindex>' AS xml
  FROM (SELECT i.url || CASE WHEN c.id // 50000 = min(c.id // 50000) OVER (PARTITION BY i.url) THEN '' ELSE '?part=' || (c.id // 50000) END AS url, c.id, c.url AS child FROM s i JOIN s c ON c.parent_url = i.url WHERE i.kind = 'index') GROUP BY url),
docs AS (SELECT * FROM leaf UNION ALL SELECT * FROM idx)
"""

PAGES = VIEWS + r""",
every_page AS (SELECT id, regexp_replace(trim(url), '/+$', '') AS url, title_fetch_failures,
  '<html><head>' || CASE id % 7 WHEN 0 THEN '<meta property="og:title" content="' || esc || '">' WHEN 1 THEN '<meta content="' || esc || '" property="og:title">' ELSE '' END
  || '<title>' || esc || ' | Example</title></head><body><p>Text</p></body></html>' AS html, title
  FROM (SELECT *, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS esc FROM e)),
pages AS (SELECT * FROM every_page WHERE title_fetch_failures = 0)
"""


def sitemap_docs(c: Catalog) -> DataFrame:
    """(url, xml): a document per sitemap and 1,000 entry ids, indexes list their children."""
    s = c.sitemaps.select(F.col("id").alias("sitemap_id"), "url", "kind", "parent_url")
    e = c.entries.where(F.col("url").isNotNull()).select(F.col("id").alias("entry_id"), F.trim("url").alias("loc"), "lastmod")
    m = c.memberships.select("entry_id", "sitemap_id").join(e, "entry_id").withColumn("chunk", F.expr(f"entry_id div {CHUNK}"))
    first = m.groupBy("sitemap_id").agg(F.min("chunk").alias("first"))
    m = m.join(s.where(F.col("kind") != "index"), "sitemap_id").join(first, "sitemap_id")
    url = F.when(F.col("chunk") == F.col("first"), F.col("url")).otherwise(F.concat("url", F.lit("?part="), F.col("chunk").cast("string")))
    esc = F.col("loc")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("/wiki/", "/&#x77;iki/"), ("/blog/", "/&#98;log/")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    block = F.concat(F.lit("<url><loc> "), esc, F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "lastmod", F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    g = m.groupBy(url.alias("doc")).agg(F.array_sort(F.collect_list(F.struct("entry_id", "loc", block.alias("b")))).alias("bs"), F.max(F.col("chunk") % 3 == 2).alias("cut"))
    leaf = g.select(F.col("doc").alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(F.transform("bs", lambda b: b["b"]), ""), F.when(F.col("cut"), "").otherwise("</urlset>")).alias("xml"))
    kids = s.select(F.col("parent_url").alias("url"), F.struct("sitemap_id", F.col("url").alias("u")).alias("k"))
    kids = kids.join(s.where(F.col("kind") == "index").select("url"), "url")
    # The protocol bounds a document at 50,000 locations: a large index has further documents.
    kids = kids.withColumn("chunk", F.expr(f"k.sitemap_id div {INDEX_CHUNK}"))
    head = kids.groupBy("url").agg(F.min("chunk").alias("head"))
    kids = kids.join(head, "url").select(F.when(F.col("chunk") == F.col("head"), F.col("url")).otherwise(F.concat("url", F.lit("?part="), F.col("chunk").cast("string"))).alias("url"), "k")
    idx = kids.groupBy("url").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    idx = idx.select("url", F.concat(F.lit('<sitemapindex xmlns="x">'), F.array_join(F.transform("ks", lambda k: F.concat(F.lit("<sitemap><loc>"), k["u"], F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    return leaf.unionByName(idx)


def pages(c: Catalog, answered: bool = True) -> DataFrame:
    """(id, url, html, title): the web; pages whose title could not be fetched do not answer.
    Titles hold references of all kinds, of the astral planes, too."""
    esc = F.col("title")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("é", "&#xe9;"), ("ü", "&#XFC;"), ("K", "&#75;"), ("🔧", "&#x1F527;"), ("’", "&#8217;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    og = F.when(F.col("id") % 7 == 0, F.concat(F.lit('<meta property="og:title" content="'), esc, F.lit('">'))).when(F.col("id") % 7 == 1, F.concat(F.lit('<meta content="'), esc, F.lit('" property="og:title">'))).otherwise("")
    html = F.concat(F.lit("<html><head>"), og, F.lit("<title>"), esc, F.lit(" | Example</title></head><body><p>Text</p></body></html>"))
    e = c.entries.where(F.col("title_fetch_failures") == 0) if answered else c.entries
    return e.select("id", F.regexp_replace(F.trim("url"), r"/+\z", "").alias("url"), html.alias("html"), "title")


def categories(c: Catalog) -> DataFrame:
    """(id, parent_id): the posts' categories; the parent of n is n div 2."""
    ids = c.post_rows("category_id").where(F.col("category_id").isNotNull()).select(F.col("category_id").cast("long").alias("id")).distinct()
    return ids.select("id", F.nullif(F.expr("id div 2"), F.lit(0)).alias("parent_id"))
