"""Whole passes: one sync of a catalog, and linking of posts with its rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.text import to_utf8
from anchorloom.operators import rebake, rules, sync
from anchorloom.operators.control import RunControl
from anchorloom.operators.phrases import generate_terms
from anchorloom.operators.posts import linkable_posts
from anchorloom.operators.render import plain_nodes, render_text
from anchorloom.operators.resolve import resolve
from anchorloom.operators.scan import scan
from anchorloom.runtime import Workspace
from anchorloom.settings import Settings
from anchorloom.sources import sitemaps as sm
from anchorloom.sources.http import PAGE_BYTES, SITEMAP_BYTES, fetch_telemetry, fetch_urls, http_get
from anchorloom.sources.snapshots import SnapshotStore

ENTRY = "id bigint, url string, title string, content_type string, source string, title_source string, priority int, enabled boolean, auto_discovered boolean, removed_from_source boolean, lastmod string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, title_fetch_failures int, next_title_fetch_at timestamp_ntz"
TERM = "entry_id bigint, phrase string, normalized_phrase string, state string, origin string, review_reason string"
RUN_COUNTS = ("seen", "excluded", "added", "retitled", "removed", "phrases_added", "phrases_removed")
RUN = "started_at timestamp_ntz, success boolean, partial boolean, " + ", ".join(f"{k} bigint" for k in RUN_COUNTS) + ", error_details string, sources string"
MEMBER = "entry_id bigint, sitemap_url string, last_seen_at timestamp_ntz"


@dataclass
class SyncReport:
    """What a pass did; counts only, the lists are in ``changes``."""

    version: int
    clean: bool
    counts: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


class Fetcher:
    """Fetches what a pass needs, each address once: results are written, so that nothing that
    reads them fetches again. ``get`` gives the body of an address, or null."""

    def __init__(self, spark: SparkSession, get: Callable[[str], bytes | None] | None = None, delay_seconds: float = 0.5):
        self.spark, self.get, self.delay, self.work, self.fetched = spark, get, delay_seconds, Workspace(spark, "fetched"), []

    def _fetch(self, urls: DataFrame, max_bytes: int, stop: bytes) -> DataFrame:
        get = self.get or (lambda u: http_get(u, max_bytes, stop=stop))
        got = self.work.write(fetch_urls(urls.distinct(), get, self.delay), "fetched")
        self.fetched.append(got)
        return got.select("url", to_utf8("body").alias("text"))

    def documents(self, sources: list[tuple[str, str]], sitemaps: DataFrame) -> DataFrame:
        """(url, xml) of the sources and of the enabled children of those that are indexes."""
        src = self.spark.createDataFrame([(u,) for u, _ in sources], "url string")
        docs = self._fetch(src, SITEMAP_BYTES, b"").withColumnRenamed("text", "xml")
        kids = self._fetch(sm.enabled_children(src, docs, sitemaps).join(src, "url", "left_anti"), SITEMAP_BYTES, b"").withColumnRenamed("text", "xml")
        return docs.unionByName(kids)

    def pages(self, urls: DataFrame) -> DataFrame:
        """(url, html) of pages, up to the end of their titles."""
        return self._fetch(urls, PAGE_BYTES, b"</title>").withColumnRenamed("text", "html")

    def telemetry(self) -> DataFrame | None:
        """Counts, times and the slowest of all fetches so far."""
        return fetch_telemetry(reduce(DataFrame.unionByName, self.fetched)) if self.fetched else None


def empty_catalog(spark: SparkSession) -> dict[str, DataFrame]:
    return {"entries": spark.createDataFrame([], ENTRY), "terms": spark.createDataFrame([], TERM), "memberships": spark.createDataFrame([], MEMBER), "changes": spark.createDataFrame([], "url string, entry_id bigint, change string")}


def sync_catalog(spark: SparkSession, store: SnapshotStore, sources: list[tuple[str, str]], docs: DataFrame, web: DataFrame, sitemaps: DataFrame, settings: Settings, now: datetime, partial: bool = False, control: RunControl | None = None) -> SyncReport:
    """``sync_pass`` as the only run at a time: under the control's lock, and partial if the run
    was cancelled or its time was up before the sweep."""
    if control is None:
        return sync_pass(spark, store, sources, docs, web, sitemaps, settings, now, partial)
    with control.lock():
        control.heartbeat(0)
        return sync_pass(spark, store, sources, docs, web, sitemaps, settings, now, partial, lambda: control.cancelled() or control.out_of_time())


def sync_pass(spark: SparkSession, store: SnapshotStore, sources: list[tuple[str, str]], docs: DataFrame, web: DataFrame, sitemaps: DataFrame, settings: Settings, now: datetime, partial: bool = False, stopped: Callable[[], bool] = lambda: False) -> SyncReport:
    """One pass: list, admit, compare, fetch titles, generate phrases, sweep, commit.

    ``docs`` (url, xml) and ``web`` (url, html) are what was fetched; ``web`` may be a function that
    fetches the pages of (url) that are due, as ``Fetcher.pages`` does; ``sitemaps`` (url, status)
    says which children of indexes are read. The new tables become the store's next version.
    Without sources, with a source or an enabled child that cannot be read in full, with an
    index of more children than are read, or after a partial pass
    nothing is removed or pruned. ``stopped`` is asked once titles are there; if so the pass
    is partial. One time stamp holds for the whole pass. The version's ``runs`` hold a row for
    each pass with its outcome and counters.
    """
    work = Workspace(spark, "sync")
    version = store.version()
    old = {n: store.read(n, version) for n in ("entries", "terms", "memberships")} if version else empty_catalog(spark)
    at = F.lit(now).cast("timestamp_ntz")
    src = spark.createDataFrame([(u, t, k) for k, (u, t) in enumerate(sources)], "url string, content_type string, rank int")
    whole = docs.where(sm.is_complete("xml")).select("url")
    broken = [r["url"] for r in src.join(whole, "url", "left_anti").select("url").collect()]  # sources are settings: few
    errors = [f"failed to fetch sitemap {u}" for u in sorted(broken)] + ([] if sources else ["no sitemap sources configured"])
    # At most CHILDREN_PER_INDEX rows and one more for each source.
    gaps = sorted(sm.unread(src.select("url"), docs, sitemaps).collect(), key=lambda r: (r["source"], r["child"] or ""))
    errors += [f"failed to fetch child sitemap {u} (unreachable or incomplete)" for u in dict.fromkeys(r["child"] for r in gaps if r["child"])]
    notes = [f"sitemap index {r['source']} lists {r['n_children']} child sitemaps; only the first {sm.CHILDREN_PER_INDEX} were processed" for r in gaps if not r["child"]]
    clean = not errors and not notes and not partial

    pages = sm.expand(src.select("url"), docs, sitemaps)
    listing = pages.join(src.withColumnRenamed("url", "source"), "source").select(F.struct("rank", "listed_in", "position").alias("ordinal"), "loc", "content_type", "lastmod", F.col("listed_in").alias("sitemap_id"))
    listing = work.write(listing, "listing")
    admitted = work.write(sync.admission(listing, settings), "admitted")
    seen = admitted.where(~F.col("excluded"))
    change = work.write(sync.diff(admitted, old["entries"]), "change")

    plan = sync.refetch_plan(admitted, old["entries"], at)
    due = plan.where(F.col("decision") == "refetch").select("url").unionByName(change.where(F.col("change") == "added").select("url"))
    pages = web(due) if callable(web) else web
    titles = work.write(sync.resolve_titles(sm.fetch_pages(due, pages), settings), "titles")
    if stopped():
        clean, notes = False, [*notes, "stopped before the end"]
    outcome = sync.refetch_outcome(plan, titles, old["entries"])
    known = plan.join(outcome.select("entry_id", F.col("title").alias("n_title"), F.col("title_source").alias("n_source"), "failures", "retry_days", "outcome"), "entry_id", "left").select(
        F.col("entry_id").alias("id"), F.col("lastmod").alias("n_lastmod"), "n_title", "n_source", "failures", "retry_days", "outcome"
    )
    e = old["entries"].join(known, "id", "left").join(change.select(F.col("entry_id").alias("id"), "change", "retyped"), "id", "left")
    e = e.join(seen.select("url", F.col("content_type").alias("n_type")), "url", "left")
    hit, fetched = F.col("change").isin("known", "restored"), F.col("outcome").isNotNull()
    cleaned = sync.reclean_titles(old["entries"], settings.title_suffixes).select(F.col("entry_id").alias("id"), F.col("title").alias("c_title"))
    e = e.join(cleaned, "id", "left")
    gone = F.lit(clean) & (F.col("change") == "removed")
    kept = e.select(
        "id", "url", F.coalesce("n_title", "c_title", "title").alias("title"), F.when(F.col("retyped"), F.col("n_type")).otherwise(F.col("content_type")).alias("content_type"), "source",
        F.coalesce("n_source", "title_source").alias("title_source"), "priority", "enabled", "auto_discovered", (gone | F.col("removed_from_source") & ~hit).alias("removed_from_source"),
        F.when(fetched, F.col("n_lastmod")).otherwise(F.col("lastmod")).alias("lastmod"), "first_seen_at", F.when(hit, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.coalesce("failures", "title_fetch_failures").alias("title_fetch_failures"),
        F.when(fetched, F.when(F.col("retry_days").isNotNull(), at + F.make_dt_interval(F.col("retry_days")))).otherwise(F.col("next_title_fetch_at")).alias("next_title_fetch_at"),
        (F.coalesce("n_title", "c_title", "title") != F.col("title")).alias("retitled"),
    )
    top = old["entries"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    slug = F.col("title_source") == "slug"
    new = change.where(F.col("change") == "added").select("url").join(seen, "url").join(titles, "url")
    # Ids need only be unique: partition and row number, after the greatest id so far.
    new = work.write(new.withColumn("id", F.monotonically_increasing_id() + 1 + F.lit(top)), "new").select(
        "id", "url", "title", "content_type", F.lit("sitemap").alias("source"), "title_source", F.lit(None).cast("int").alias("priority"), F.lit(True).alias("enabled"), F.lit(True).alias("auto_discovered"),
        F.lit(False).alias("removed_from_source"), "lastmod", at.alias("first_seen_at"), at.alias("last_seen_at"), slug.cast("int").alias("title_fetch_failures"),
        F.when(slug, at + F.make_dt_interval(F.lit(1))).alias("next_title_fetch_at"), F.lit(True).alias("retitled"),
    )
    entries = work.write(kept.unionByName(new), "entries")
    changed = entries.where("retitled").select("id", "title")
    ids = changed.select(F.col("id").alias("entry_id"))
    stay = old["terms"].join(ids, "entry_id", "left_anti")
    own = old["terms"].join(ids, "entry_id", "left_semi").where((F.col("origin") != "generated") | F.col("state").isin("approved", "disabled"))
    made = generate_terms(changed, settings).join(own.select("entry_id", "normalized_phrase"), ["entry_id", "normalized_phrase"], "left_anti").withColumn("origin", F.lit("generated"))
    cols = ["entry_id", "phrase", "normalized_phrase", "state", "origin", "review_reason"]
    terms = work.write(stay.select(cols).unionByName(own.select(cols)).unionByName(made.select(cols)), "terms")

    by_url = entries.select(F.col("id").alias("entry_id"), "url")
    observed = listing.select(sm.page_url("loc").alias("url"), F.col("sitemap_id").alias("sitemap_url")).join(by_url, "url").select("entry_id", "sitemap_url").distinct().withColumn("last_seen_at", at)
    rest = old["memberships"].join(observed.select("entry_id", "sitemap_url"), ["entry_id", "sitemap_url"], "left_anti")
    if clean:
        # Of every sitemap read in full, also of one that lists nothing any more.
        read = sm.read_in_full(src.select("url"), docs, sitemaps)
        rest = rest.join(read.select(F.col("url").alias("sitemap_url")), "sitemap_url", "left_anti")
    members = observed.unionByName(rest.select("entry_id", "sitemap_url", "last_seen_at"))

    phrases = sync.phrase_diff(old["terms"], terms, entries) if version else sync.phrase_diff(terms.limit(0), terms, entries)
    phrases = work.write(phrases, "phrases")
    tables = {"entries": entries.drop("retitled"), "terms": terms, "memberships": members, "changes": change.where(F.col("change").isin("added", "restored", "removed") & (F.lit(clean) | (F.col("change") != "removed")))}
    n = {r["change"]: r["n"] for r in tables["changes"].groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    a = sync.admission_counts(admitted).first()
    p = {r["change"]: r["n"] for r in phrases.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {"seen": a["seen"], "excluded": a["excluded"], **{k: n.get(k, 0) for k in ("added", "restored", "removed")}, "retitled": entries.where("retitled").count() - n.get("added", 0), "phrases_added": p.get("added", 0), "phrases_removed": p.get("removed", 0)}
    decision = rebake.gate(phrases, settings).first()["decision"] if settings.auto_rebake_on_changes else "none"
    counts["rebake"] = int(decision == "rebake")
    run = [(now, not errors, bool(notes) or partial, *[counts[k] for k in RUN_COUNTS], "; ".join(errors + notes) or None, ", ".join(u for u, _ in sources))]
    runs = spark.createDataFrame(run, RUN)
    tables["runs"] = store.read("runs", version).unionByName(runs) if store.has("runs", version) else runs
    new_version = store.commit(tables, version)
    work.clear()
    return SyncReport(new_version, clean, counts, errors, notes)


def catalog_rules(spark: SparkSession, store: SnapshotStore, settings: Settings, mappings: list[tuple[str, str, str]] = ()) -> DataFrame:
    """The compiled rules of the store's current version."""
    terms = store.read("terms").withColumn("id", F.xxhash64("entry_id", "normalized_phrase"))
    return rules.compile_rules(rules.all_rules(spark, terms, store.read("entries"), settings, list(mappings)))


def link_posts(posts: DataFrame, categories: DataFrame, ruleset: DataFrame, settings: Settings) -> DataFrame:
    """(id, rendered, n_links) of posts that may be linked."""
    nodes = plain_nodes(linkable_posts(posts, categories, settings), "id", "raw")
    links = resolve(scan(nodes, ruleset, ["id"]), ruleset, ["id"], settings.max_links_per_destination, settings.max_links_per_post)
    return render_text(nodes, links, ["id"], settings.anchor_class).drop("node_index")
