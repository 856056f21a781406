"""Rules: from linkable phrases and manual mappings to one winner per phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.filters import active, linkable, safe_url, url_excluded
from anchorloom.functions.text import normalize_text
from anchorloom.settings import Settings

RULE_SCHEMA = "phrase string, url string, type string, priority int, entry_id bigint, seq bigint"


def type_rank(content_type: Column | str, type_priority: tuple[str, ...]) -> Column:
    """Index of the type in the list; types not listed come after all others."""
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    at = F.array_position(F.array(*[F.lit(t) for t in type_priority]), c) if type_priority else F.lit(0)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(type_priority))).cast("int")


def rule_priority(settings: Settings) -> Column:
    """The entry's own priority, else -1 for a manual alias, else the rank of its type."""
    return F.coalesce(F.col("priority"), F.when(F.col("origin") == "manual", F.lit(-1)), type_rank("content_type", settings.type_priority)).cast("int")


def database_rules(terms: DataFrame, entries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rules of linkable phrases of active entries: (phrase, url, type, priority, entry_id, seq).

    Gates: type enabled, phrase not excluded (manual aliases pass), url not excluded. All
    filters and the few columns reach the scans; the join is on entry_id.
    """
    e = entries.where(active() & ~url_excluded("url", settings.excluded_url_patterns))
    if settings.enabled_types:
        e = e.where(F.col("content_type").isin(*settings.enabled_types))
    e = e.select(F.col("id").alias("entry_id"), "url", "content_type", "priority")
    t = terms.where(linkable()).select(F.col("id").alias("seq"), "entry_id", F.col("normalized_phrase").alias("phrase"), "origin")
    if settings.excluded_terms:
        t = t.where((F.col("origin") == "manual") | ~F.col("phrase").isin(*settings.excluded_terms))
    return t.join(e, "entry_id").select("phrase", "url", F.col("content_type").alias("type"), rule_priority(settings).alias("priority"), "entry_id", "seq")


def mapping_rules(spark: SparkSession, mappings: list[tuple[str, str, str]]) -> DataFrame:
    """Rules of the mappings in the settings: priority -2, no entry, before all others in order."""
    rows = [(p, u, t, -2, None, i - len(mappings) - 1_000_000_000) for i, (p, u, t) in enumerate(mappings)]
    df = spark.createDataFrame(rows, RULE_SCHEMA)
    return df.withColumn("phrase", normalize_text("phrase")).where((F.trim("phrase") != "") & (F.trim("url") != ""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """One rule per phrase: least (priority, url in byte order, seq). Null priority is 0.

    Rules without a phrase or with an unsafe url are dropped. ``min(struct)`` combines on
    the map side, so a phrase that a third of all rows claim is no hot group.
    """
    ok = rules.where((F.col("phrase") != "") & safe_url("url"))
    best = F.min(F.struct(F.coalesce("priority", F.lit(0)).alias("rank"), "url", "seq", "type", "priority", "entry_id"))
    return ok.groupBy("phrase").agg(best.alias("b")).select("phrase", "b.url", "b.type", "b.priority", "b.entry_id", "b.seq")


def all_rules(spark: SparkSession, terms: DataFrame, entries: DataFrame, settings: Settings, mappings: list[tuple[str, str, str]]) -> DataFrame:
    db = database_rules(terms, entries, settings)
    return mapping_rules(spark, mappings).unionByName(db) if mappings else db


def linking_pairs(db_rules: DataFrame) -> DataFrame:
    """(phrase, entry_id) of every claimant that could link, winner or not."""
    return db_rules.where(safe_url("url") & F.col("entry_id").isNotNull()).select("phrase", "entry_id").distinct()
