"""The catalog's tables in their current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.urls import page_url
from anchorloom.operators.current import current_rows
from anchorloom.sources.tables import table


class Catalog:
    """Entries, terms, sitemaps, memberships, runs and posts of a data folder, one row per id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def entry_rows(self, *columns: str) -> DataFrame:
        """Current entries with only these columns (and id, updated_at): an aggregate of whole
        rows carries every column through its shuffle, so heavy queries name theirs."""
        return current_rows(self.raw("sitemap_autolink_entries"), columns=list(columns))

    def term_rows(self, *columns: str) -> DataFrame:
        return current_rows(self.raw("sitemap_autolink_terms"), columns=list(columns))

    def post_rows(self, *columns: str) -> DataFrame:
        return current_rows(self.raw("posts"), order="created_at", columns=list(columns))

    @property
    def entries(self) -> DataFrame:
        return current_rows(self.raw("sitemap_autolink_entries"))

    @property
    def terms(self) -> DataFrame:
        return current_rows(self.raw("sitemap_autolink_terms"))

    @property
    def sitemaps(self) -> DataFrame:
        return current_rows(self.raw("sitemap_autolink_sitemaps")).withColumns({"url": page_url("url"), "parent_url": page_url("parent_url"), "kind": F.lower("kind")})

    @property
    def memberships(self) -> DataFrame:
        """Bridge rows with both ends, one per (entry, sitemap): the one seen last."""
        m = current_rows(self.raw("sitemap_autolink_entry_sitemaps")).where(F.col("entry_id").isNotNull() & F.col("sitemap_id").isNotNull())
        return m.groupBy("entry_id", "sitemap_id").agg(F.max("last_seen_at").alias("last_seen_at"))

    @property
    def runs(self) -> DataFrame:
        return self.raw("sitemap_autolink_sync_runs")

    @property
    def posts(self) -> DataFrame:
        return current_rows(self.raw("posts"), order="created_at")
