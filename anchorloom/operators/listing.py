"""Filtered, ordered and paged lists of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.filters import contains_literal, page_state
from anchorloom.settings import ORIGINS, check_state

PER_PAGE, LAST_PAGE = 50, 10_000


def page_of(df: DataFrame, order: list, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """One page; the page number is clamped, pages past the end are empty. ``order`` must be unique."""
    page = min(max(int(page), 0), LAST_PAGE)
    return df.orderBy(*order).offset(page * per_page).limit(per_page)


def page_count(total: int, per_page: int = PER_PAGE) -> int:
    return -(-total // per_page)


def entries_in_sitemap(entries: DataFrame, memberships: DataFrame, sitemaps: DataFrame, url: str | None = None) -> DataFrame:
    s = sitemaps if url is None else sitemaps.where(F.col("url") == url)
    m = memberships.join(s.select(F.col("id").alias("sitemap_id")), "sitemap_id", "left_semi")
    return entries.join(m.select(F.col("entry_id").alias("id")), "id", "left_semi")


def search_entries(entries: DataFrame, terms: DataFrame, query: str) -> DataFrame:
    """Entries whose url or title, or one of whose phrases, holds the query as literal text."""
    hit = terms.where(contains_literal("phrase", query) | contains_literal("normalized_phrase", query)).select(F.col("entry_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    j = entries.join(hit, "id", "left")
    return j.where(F.coalesce("hit", F.lit(False)) | contains_literal("url", query) | contains_literal("title", query)).drop("hit")


def list_terms(terms: DataFrame, entries: DataFrame, state: str | None = None, state_of_page: str | None = None, content_type: str | None = None, origin: str | None = None, query: str | None = None) -> DataFrame:
    """Terms with url and title of their page. An unknown state is an error, an unknown origin no filter."""
    t = terms.where(F.col("state") == check_state(state)) if state else terms
    t = t.where(F.col("origin") == origin) if origin in ORIGINS else t
    e = entries.where(page_state(state_of_page))
    e = e.where(F.col("content_type") == content_type) if content_type else e
    j = t.select("id", "entry_id", "phrase", "normalized_phrase", "state", "origin").join(e.select(F.col("id").alias("entry_id"), "url", "title"), "entry_id")
    if query:
        j = j.where(contains_literal("phrase", query) | contains_literal("normalized_phrase", query) | contains_literal("title", query) | contains_literal("url", query))
    return j


def entry_cards(entries: DataFrame, terms: DataFrame, memberships: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(entry_id, phrases, sitemap_urls, has_duplicate) of a page of entries, lists sorted.

    ``entries`` is one page of a list, so terms and bridge rows are first cut to its ids;
    the duplicate mark looks only at phrases on the page.
    """
    ids = entries.select(F.col("id").alias("entry_id"))
    own = terms.join(ids, "entry_id", "left_semi").select("entry_id", "normalized_phrase").distinct()
    rivals = terms.join(own.select("normalized_phrase").distinct(), "normalized_phrase", "left_semi").groupBy("normalized_phrase").agg(F.countDistinct("entry_id").alias("n"))
    own = own.join(rivals, "normalized_phrase").groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("normalized_phrase")), "|").alias("phrases"), (F.max("n") > 1).alias("has_duplicate"))
    m = memberships.join(ids, "entry_id", "left_semi").join(sitemaps.select(F.col("id").alias("sitemap_id"), "url"), "sitemap_id")
    m = m.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("url")), "|").alias("sitemap_urls"))
    return ids.join(own, "entry_id", "left").join(m, "entry_id", "left").select("entry_id", F.coalesce("phrases", F.lit("")).alias("phrases"), F.coalesce("sitemap_urls", F.lit("")).alias("sitemap_urls"), F.coalesce("has_duplicate", F.lit(False)).alias("has_duplicate"))
