"""Sitemap documents: parsing, kinds, expansion of indexes, measuring, adoption, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorloom.functions.filters import ingestible
from anchorloom.functions.text import unescape_html
from anchorloom.functions.urls import page_url, strip

CHILDREN_PER_INDEX = 100
ADOPTION_SAMPLE = 20
# --- Fixed values: the elements of the sitemap format.
_BLOCK_END, _LOC, _LASTMOD = r"(?i)</(?:url|sitemap)>", r"(?i)<loc>\s*([^<\s]+)\s*</loc>", r"(?i)<lastmod>\s*([^<\s]+)\s*</lastmod>"


def is_complete(xml: Column | str) -> Column:
    """The closing tag is there; anything else counts as a failed fetch."""
    c = F.col(xml) if isinstance(xml, str) else xml
    return F.coalesce(c.rlike(r"(?i)</\s*(?:urlset|sitemapindex)\s*>"), F.lit(False))


def sitemap_kind(xml: Column | str) -> Column:
    c = F.col(xml) if isinstance(xml, str) else xml
    return F.when(c.rlike(r"(?i)<sitemapindex[\s>]"), "index").otherwise("urlset")


def parse_sitemap(docs: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """(url, position, loc, lastmod): blocks in document order; blocks without a loc are dropped."""
    blocks = docs.select(F.col(url).alias("url"), F.posexplode(F.split(xml, _BLOCK_END)).alias("position", "block"))
    loc = F.regexp_extract("block", _LOC, 1)
    lastmod = F.nullif(F.regexp_extract("block", _LASTMOD, 1), F.lit(""))
    return blocks.select("url", "position", unescape_html(loc).alias("loc"), lastmod.alias("lastmod")).where(F.col("loc") != "")


def _children(sources: DataFrame, docs: DataFrame, cap: int) -> DataFrame:
    """(source, url): the first ``cap`` children of each index among the sources."""
    heads = sources.select(strip("url").alias("url")).join(docs.where(is_complete("xml") & (sitemap_kind("xml") == "index")), "url")
    rank = F.row_number().over(Window.partitionBy("url").orderBy("position"))
    return parse_sitemap(heads).withColumn("rank", rank).where(F.col("rank") <= cap).select(F.col("url").alias("source"), strip("loc").alias("url")).distinct()


def _enabled(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.where(F.col("status") == "enabled").select(strip("url").alias("url")).distinct()


def enabled_children(sources: DataFrame, docs: DataFrame, sitemaps: DataFrame, cap: int = CHILDREN_PER_INDEX) -> DataFrame:
    """(url) of the children of indexes that a pass reads."""
    return _children(sources, docs, cap).join(_enabled(sitemaps), "url").select("url").distinct()


def unread(sources: DataFrame, docs: DataFrame, sitemaps: DataFrame, cap: int = CHILDREN_PER_INDEX) -> DataFrame:
    """(source, child, n_children): what ``expand`` left out. An enabled child that is missing or
    cut off has its url; an index with more than ``cap`` children has a row with a null child."""
    whole = docs.where(is_complete("xml")).select("url")
    failed = _children(sources, docs, cap).join(_enabled(sitemaps), "url").where(F.col("url") != "").join(whole, "url", "left_anti")
    heads = sources.select(strip("url").alias("url")).distinct().join(docs.where(is_complete("xml") & (sitemap_kind("xml") == "index")), "url")
    over = parse_sitemap(heads).groupBy(F.col("url").alias("source")).agg(F.count(F.lit(1)).alias("n_children")).where(F.col("n_children") > cap)
    return failed.select("source", F.col("url").alias("child"), F.lit(None).cast("long").alias("n_children")).unionByName(over.select("source", F.lit(None).cast("string").alias("child"), "n_children"))


def read_in_full(sources: DataFrame, docs: DataFrame, sitemaps: DataFrame, cap: int = CHILDREN_PER_INDEX) -> DataFrame:
    """(url) of the complete urlsets that ``expand`` reads, also those that list nothing."""
    whole = docs.where(is_complete("xml") & (sitemap_kind("xml") == "urlset")).select("url")
    read = sources.select(strip("url").alias("url")).unionByName(_children(sources, docs, cap).join(_enabled(sitemaps), "url").select("url"))
    return read.join(whole, "url", "left_semi").distinct()


def expand(sources: DataFrame, docs: DataFrame, sitemaps: DataFrame, cap: int = CHILDREN_PER_INDEX) -> DataFrame:
    """(source, listed_in, position, loc, lastmod) of what sources list, through their indexes.

    A urlset source lists its own pages. Of an index' first ``cap`` children those that are
    enabled and complete urlsets are read; pending and ignored ones and nested indexes are not.
    """
    good = docs.where(is_complete("xml")).withColumn("kind", sitemap_kind("xml"))
    heads = sources.select(strip("url").alias("url")).join(good, "url")
    own = parse_sitemap(heads.where(F.col("kind") == "urlset")).withColumn("source", F.col("url"))
    read = _children(sources, docs, cap).join(_enabled(sitemaps), "url").join(good.where(F.col("kind") == "urlset").select("url", "xml"), "url")
    through = parse_sitemap(read.select("url", "xml").distinct()).join(read.select("url", "source"), "url")
    cols = ["source", F.col("url").alias("listed_in"), "position", "loc", "lastmod"]
    return own.select(*cols).unionByName(through.select(*cols))


def measure(docs: DataFrame) -> DataFrame:
    """(url, kind, url_count, url_count_partial): incomplete documents give a floor."""
    counts = parse_sitemap(docs).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    one = docs.select("url", F.when(F.col("xml").isNotNull(), sitemap_kind("xml")).otherwise("unknown").alias("kind"), (~is_complete("xml")).alias("url_count_partial"))
    return one.join(counts, "url", "left").select("url", "kind", F.coalesce("n", F.lit(0)).alias("url_count"), "url_count_partial")


def adopt(docs: DataFrame, entries: DataFrame, patterns: tuple[str, ...] = (), sample: int = ADOPTION_SAMPLE) -> DataFrame:
    """(url, n_sample, n_known, adopted): a new child whose first pages are mostly known already."""
    rank = F.row_number().over(Window.partitionBy("url").orderBy("position"))
    first = parse_sitemap(docs).withColumn("rank", rank).where(F.col("rank") <= sample).select("url", page_url("loc").alias("page"))
    first = first.where((F.col("page") != "") & ingestible("page", patterns))
    known = entries.select(F.col("url").alias("page")).distinct().withColumn("known", F.lit(1))
    agg = first.join(known, "page", "left").groupBy("url").agg(F.count(F.lit(1)).alias("n_sample"), F.sum(F.coalesce("known", F.lit(0))).alias("n_known"))
    return agg.withColumn("adopted", F.col("n_known") * 2 > F.col("n_sample"))


def upsert(sitemaps: DataFrame, seen: DataFrame, auto_import: bool = False) -> DataFrame:
    """(url, parent_url, content_type, status, configured, change) after a pass that saw ``seen``
    (url, parent_url, content_type, configured, last_error).

    Configured ones are enabled; a new child is pending unless imported at once; known rows
    keep their status unless configured. Sources no longer configured lose the mark, but
    not if the pass had no sources at all.
    """
    old = sitemaps.select("url", F.col("parent_url").alias("o_parent"), F.col("content_type").alias("o_type"), "status", F.col("configured").alias("o_conf"))
    new = seen.select("url", F.col("parent_url").alias("n_parent"), F.col("content_type").alias("n_type"), F.col("configured").alias("n_conf"))
    any_source = seen.where("configured").limit(1).select(F.lit(True).alias("has")).withColumn("k", F.lit(1))
    both = old.join(new, "url", "full_outer").withColumn("k", F.lit(1)).join(any_source, "k", "left")
    is_new, is_seen = F.col("status").isNull(), F.col("n_conf").isNotNull()
    kept = F.when(F.col("has"), F.lit(False)).otherwise(F.coalesce("o_conf", F.lit(False)))
    return both.select(
        "url",
        F.when(is_seen, F.col("n_parent")).otherwise(F.col("o_parent")).alias("parent_url"),
        F.coalesce("n_type", "o_type").alias("content_type"),
        F.when(F.col("n_conf"), "enabled").when(is_new, F.lit("enabled" if auto_import else "pending")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("n_conf"), F.lit(True)).otherwise(kept).alias("configured"),
        F.when(is_new, "new").when(is_seen, "seen").otherwise("kept").alias("change"),
    )


def rewrite_host(url: Column | str, rewrites: dict[str, str]) -> Column:
    """The address to fetch: host replaced by its target; the stored url stays public."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(c, r"(?i)^https?://([^/?#]*)", 1))
    out = c
    for public, target in rewrites.items():
        fixed = F.regexp_replace(c, r"(?i)^https?://[^/?#]*", target) if "://" in target else F.regexp_replace(c, r"(?i)^(https?://)[^/?#]*", "$1" + target)
        out = F.when(host == public, fixed).otherwise(out)
    return out


def fetch_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html, fetched): the web is a table; a missing page is a failed fetch."""
    return urls.join(pages.select("url", "html"), "url", "left").withColumn("fetched", F.col("html").isNotNull())
