"""One pass of catalog sync as pure functions: what to admit, change, fetch, remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorloom.functions.filters import active, ingestible, linkable
from anchorloom.functions.text import clean_title, retry_days, slug_title, title_from_html
from anchorloom.functions.urls import page_url
from anchorloom.operators.phrases import generate_terms
from anchorloom.settings import Settings


def admission(listing: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(url, content_type, lastmod, sitemap_id, n_listed, excluded): one row per normalized url.

    ``listing`` has ordinal, loc, content_type, lastmod, sitemap_id; the first listing by
    ordinal decides type and lastmod. Excluded urls are never admitted, every listing of
    one counts. Empty locs are dropped. ``min(struct)`` combines on the map side.
    """
    l = listing.select("ordinal", page_url("loc").alias("url"), "content_type", "lastmod", "sitemap_id").where(F.col("url") != "")
    first = F.min(F.struct("ordinal", "content_type", "lastmod", "sitemap_id"))
    g = l.groupBy("url").agg(first.alias("f"), F.count(F.lit(1)).alias("n_listed"))
    return g.select("url", "f.content_type", "f.lastmod", "f.sitemap_id", "n_listed", (~ingestible("url", settings.excluded_url_patterns)).alias("excluded"))


def admission_counts(admitted: DataFrame) -> DataFrame:
    """(seen, excluded): urls once, exclusions per listing."""
    return admitted.agg(F.count_if(~F.col("excluded")).alias("seen"), F.coalesce(F.sum(F.when(F.col("excluded"), F.col("n_listed"))), F.lit(0)).alias("excluded"))


def diff(admitted: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, entry_id, change, retyped): added, restored, known, removed (only discovered
    sitemap entries that are not removed yet) or untouched."""
    seen = admitted.where(~F.col("excluded")).select("url", F.col("content_type").alias("new_type"))
    old = entries.select(F.col("id").alias("entry_id"), "url", "content_type", "source", "auto_discovered", "removed_from_source")
    both = seen.withColumn("seen", F.lit(True)).join(old, "url", "full_outer")
    known = F.col("entry_id").isNotNull()
    change = (
        F.when(~known, "added")
        .when(F.col("seen") & F.col("removed_from_source"), "restored")
        .when(F.col("seen"), "known")
        .when((F.col("source") == "sitemap") & F.col("auto_discovered") & ~F.col("removed_from_source"), "removed")
        .otherwise("untouched")
    )
    retyped = F.coalesce(F.col("seen") & F.col("auto_discovered") & (F.col("content_type") != F.col("new_type")), F.lit(False))
    return both.select("url", "entry_id", change.alias("change"), retyped.alias("retyped"))


def refetch_plan(admitted: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """(entry_id, url, lastmod, decision) for known entries: refetch, deferred or unchanged.

    ``now`` is one literal time of the run."""
    seen = admitted.where(~F.col("excluded")).select("url", F.col("lastmod").alias("new_lastmod"))
    e = entries.join(seen, "url")
    changed = F.coalesce((F.trim("new_lastmod") != "") & ~F.col("new_lastmod").eqNullSafe(F.col("lastmod")), F.lit(False))
    due = F.col("next_title_fetch_at").isNull() | (F.col("next_title_fetch_at") <= now)
    slug = F.col("title_source") == "slug"
    decision = F.when(slug & ~due & ~changed, "deferred").when(changed | slug, "refetch").otherwise("unchanged")
    return e.select(F.col("id").alias("entry_id"), "url", F.col("new_lastmod").alias("lastmod"), decision.alias("decision"))


def resolve_titles(fetched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(url, title, title_source) of rows (url, html): the page's title, else one from the slug."""
    t = fetched.withColumn("page_title", title_from_html("html", settings.title_suffixes))
    return t.select("url", F.coalesce("page_title", slug_title("url")).alias("title"), F.when(F.col("page_title").isNotNull(), "page").otherwise("slug").alias("title_source"))


def refetch_outcome(plan: DataFrame, titles: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, title, title_source, failures, retry_days, outcome) of refetched entries:
    retitled, healed (same title, now from the page) or failed (title kept, backoff grows)."""
    p = plan.where(F.col("decision") == "refetch").select("entry_id", "url")
    t = titles.select("url", F.col("title").alias("new_title"), F.col("title_source").alias("new_source"))
    e = entries.select(F.col("id").alias("entry_id"), "title", "title_source", "title_fetch_failures")
    j = p.join(t, "url").join(e, "entry_id")
    page = F.col("new_source") == "page"
    failures = F.when(page, F.lit(0)).otherwise(F.col("title_fetch_failures") + 1)
    return j.select(
        "entry_id",
        F.when(page, F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(page, F.lit("page")).otherwise(F.col("title_source")).alias("title_source"),
        failures.alias("failures"),
        F.when(~page, retry_days(failures)).alias("retry_days"),
        F.when(page & (F.col("new_title") != F.col("title")), "retitled").when(page, "healed").otherwise("failed").alias("outcome"),
    )


def reclean_titles(entries: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(entry_id, title) of discovered entries whose stored title changes under the suffixes."""
    e = entries.where(F.col("auto_discovered") & ~F.col("removed_from_source"))
    e = e.select(F.col("id").alias("entry_id"), F.col("title").alias("old"), clean_title("title", suffixes).alias("title"))
    return e.where(F.col("title").isNotNull() & (F.col("title") != F.col("old"))).select("entry_id", "title")


def regenerate_terms(terms: DataFrame, entries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(entry_id, normalized_phrase, state, origin, change) of the entries' terms anew.

    Generated terms that nobody approved or disabled go; generated phrases that are not
    there come. change is kept or added.
    """
    ids = entries.select(F.col("id").alias("entry_id"))
    kept = terms.where((F.col("origin") != "generated") | F.col("state").isin("approved", "disabled"))
    kept = kept.join(ids, "entry_id", "left_semi").groupBy("entry_id", "normalized_phrase").agg(F.min(F.struct("state", "origin")).alias("k")).select("entry_id", "normalized_phrase", "k.state", "k.origin")
    fresh = generate_terms(entries, settings).select("entry_id", "normalized_phrase", "state").join(kept.select("entry_id", "normalized_phrase"), ["entry_id", "normalized_phrase"], "left_anti")
    return kept.withColumn("change", F.lit("kept")).unionByName(fresh.withColumn("origin", F.lit("generated")).withColumn("change", F.lit("added")))


def phrase_diff(before: DataFrame, after: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, phrase, change): linkable phrases of active entries that were added or removed."""
    live = entries.where(active()).select(F.col("id").alias("entry_id"))
    side = lambda t, n: t.where(linkable()).select("entry_id", F.col("normalized_phrase").alias("phrase")).distinct().withColumn(n, F.lit(True))
    both = side(before, "old").join(side(after, "new"), ["entry_id", "phrase"], "full_outer").where(F.col("old").isNull() | F.col("new").isNull())
    return both.join(live, "entry_id", "left_semi").select("entry_id", "phrase", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"))


def mark_removed(entries: DataFrame, seen: DataFrame, clean: bool) -> DataFrame:
    """(entry_id) to mark as removed; nothing unless the pass was clean and complete."""
    e = entries.where((F.col("source") == "sitemap") & F.col("auto_discovered") & ~F.col("removed_from_source")).where(F.lit(clean))
    return e.join(seen.select("url"), "url", "left_anti").select(F.col("id").alias("entry_id"))


def membership_diff(observed: DataFrame, old: DataFrame, read: DataFrame) -> DataFrame:
    """(entry_id, sitemap_id, change): added, seen, pruned (its sitemap was read in full, the
    row was not seen) or kept (its sitemap was not read)."""
    o = observed.select("entry_id", "sitemap_id").distinct().withColumn("obs", F.lit(True))
    b = old.select("entry_id", "sitemap_id").distinct().withColumn("had", F.lit(True))
    r = read.select("sitemap_id").distinct().withColumn("read", F.lit(True))
    j = o.join(b, ["entry_id", "sitemap_id"], "full_outer").join(r, "sitemap_id", "left")
    change = F.when(F.col("had").isNull(), "added").when(F.col("obs"), "seen").when(F.col("read"), "pruned").otherwise("kept")
    return j.select("entry_id", "sitemap_id", change.alias("change"))


def first_by(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key, Spark's group limit keeps them while sorting."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
