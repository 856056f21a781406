"""Conflicts, overlaps and statistics of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.filters import active, linkable, safe_url
from anchorloom.functions.text import normalize_text
from anchorloom.operators.listing import page_of
from anchorloom.operators.rules import all_rules, compile_rules, linking_pairs
from anchorloom.operators.scan import scan
from anchorloom.settings import TERM_STATES, Settings


def duplicate_phrases(terms: DataFrame) -> DataFrame:
    """(phrase, n_entries) of phrases that several entries claim."""
    d = terms.groupBy(F.col("normalized_phrase").alias("phrase")).agg(F.countDistinct("entry_id").alias("n_entries"))
    return d.where(F.col("n_entries") > 1)


def not_linking_reason(linking: Column) -> Column:
    return F.coalesce(
        F.when(linking, F.lit(None)),
        F.when(~linking & F.col("removed_from_source"), "page_gone"),
        F.when(~linking & ~F.col("enabled"), "page_disabled"),
        F.when(~linking & (F.col("state") == "disabled"), "keyword_disabled"),
        F.when(~linking & (F.col("state") == "pending_review"), "keyword_pending"),
        F.when(~linking & F.col("overridden"), "override"),
        F.when(~linking & ~safe_url("url"), "unlinkable_url"),
        F.when(~linking, "settings"),
    )


def owners(terms: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(phrase, entry_id, url, state, linking, reason, can_win, winner): every claim to a phrase.

    ``rules`` are those of one snapshot, mappings first; claims, pairs and winners all come
    from it, so the figures of a report agree.
    """
    pairs = linking_pairs(rules).withColumn("pair", F.lit(True))
    won = compile_rules(rules).select("phrase", F.col("url").alias("winner_url"), F.col("entry_id").isNull().alias("overridden"))
    e = entries.select(F.col("id").alias("entry_id"), "url", "enabled", "removed_from_source")
    c = terms.select(F.col("normalized_phrase").alias("phrase"), "entry_id", "state").join(e, "entry_id")
    c = c.join(pairs, ["phrase", "entry_id"], "left").join(won, "phrase", "left").withColumn("overridden", F.coalesce("overridden", F.lit(False)))
    c = c.withColumn("linking", F.coalesce("pair", F.lit(False)) & ~F.col("overridden")).withColumn("reason", not_linking_reason(F.col("linking")))
    return c.select(
        "phrase", "entry_id", "url", "state", "linking", "reason",
        (F.col("reason").isNull() | F.col("reason").isin("keyword_disabled", "keyword_pending")).alias("can_win"),
        F.coalesce(F.col("linking") & (F.col("url") == F.col("winner_url")), F.lit(False)).alias("winner"),
    )


def collision_candidates(terms: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The claims to phrases that several existing entries claim."""
    o = owners(terms, entries, rules)
    many = o.groupBy("phrase").agg(F.countDistinct("entry_id").alias("n")).where(F.col("n") > 1).select("phrase")
    return o.join(many, "phrase", "left_semi")


def collisions(candidates: DataFrame, include_inactive: bool = False) -> DataFrame:
    """(phrase, n_candidates, n_linking, winner_url); by default only contested phrases."""
    g = candidates.groupBy("phrase").agg(
        F.countDistinct("entry_id").alias("n_candidates"),
        F.countDistinct(F.when(F.col("linking"), F.col("entry_id"))).alias("n_linking"),
        F.max(F.when(F.col("winner"), F.col("url"))).alias("winner_url"),
    )
    return g if include_inactive else g.where(F.col("n_linking") > 1)


def collision_page(candidates: DataFrame, search: str = "", page: int = 0, include_inactive: bool = False) -> DataFrame:
    """A page of ``collisions`` by phrase, of phrases that hold ``search`` (normalized)."""
    g = collisions(candidates, include_inactive)
    if search.strip():
        g = g.where(F.contains("phrase", normalize_text(F.lit(search))))
    return page_of(g, ["phrase"], page)


def collision_totals(candidates: DataFrame) -> DataFrame:
    """(competing, settled): phrases that several linking pages claim, and those with one at most."""
    g = collisions(candidates, include_inactive=True)
    return g.agg(F.count_if(F.col("n_linking") > 1).alias("competing"), F.count_if(F.col("n_linking") <= 1).alias("settled"))


def resolve_collision(terms: DataFrame, entries: DataFrame, wishes: DataFrame) -> DataFrame:
    """Terms after giving phrases to entries: ``wishes`` (phrase, entry_id). The wished claim is
    approved, all others to the phrase are disabled; wishes of entries that do not claim
    the phrase change nothing. Returns (term_id, state, changed)."""
    t = terms.select(F.col("id").alias("term_id"), F.col("normalized_phrase").alias("phrase"), "entry_id", "state")
    claims = wishes.select("phrase", F.col("entry_id").alias("wished")).join(t.select("phrase", F.col("entry_id").alias("wished")).distinct(), ["phrase", "wished"], "left_semi")
    j = t.join(claims, "phrase", "left")
    state = F.when(F.col("wished").isNull(), F.col("state")).when(F.col("entry_id") == F.col("wished"), "approved").otherwise("disabled")
    return j.select("term_id", state.alias("new_state"), (state != F.col("state")).alias("changed"))


def verify_wishes(spark: SparkSession, terms: DataFrame, entries: DataFrame, wishes: DataFrame, settings: Settings, mappings: list[tuple[str, str, str]] = ()) -> DataFrame:
    """(phrase, entry_id, accepted, refusal) of wishes (phrase, entry_id).

    The wished states are applied to a copy, the rules compiled anew, and a wish is accepted
    only if its entry then owns the phrase. Otherwise: not_claimant, override (a mapping owns
    it), no_rule (a setting, the page or its url rules it out) or outranked. Only accepted
    wishes should be committed.
    """
    states = resolve_collision(terms, entries, wishes).select(F.col("term_id").alias("id"), "new_state")
    after = terms.join(states, "id").withColumn("state", F.col("new_state")).drop("new_state")
    won = compile_rules(all_rules(spark, after, entries, settings, list(mappings))).select("phrase", F.col("entry_id").alias("owner"), F.lit(True).alias("rule"))
    claims = terms.select(F.col("normalized_phrase").alias("phrase"), "entry_id").distinct().withColumn("claim", F.lit(True))
    j = wishes.select("phrase", "entry_id").join(claims, ["phrase", "entry_id"], "left").join(won, "phrase", "left")
    refusal = (
        F.when(F.col("claim").isNull(), "not_claimant").when(F.col("owner") == F.col("entry_id"), None)
        .when(F.col("rule").isNull(), "no_rule").when(F.col("owner").isNull(), "override").otherwise("outranked")
    )
    return j.withColumn("refusal", refusal).select("phrase", "entry_id", F.col("refusal").isNull().alias("accepted"), "refusal")


def overlap_pairs(terms: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(phrase, covered_by, same_destination, live): each phrase inside a longer one, on word
    boundaries, once. live: both have a rule. The phrases are the texts and the rules of
    the same scan that posts go through."""
    # Where a phrase leads: its winner's url, or all its claimants' urls. Sets of urls are
    # compared by size and digest, so a phrase that very many pages claim is not collected.
    one = F.struct(F.lit(1).cast("bigint").alias("n"), F.xxhash64("url").alias("digest"), F.col("url").alias("least"))
    won = compile_rules(rules).select("phrase", one.alias("dest"), F.lit(True).alias("rule"))
    own = owners(terms, entries, rules).select("phrase", "url").distinct().groupBy("phrase")
    own = own.agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("url")).alias("digest"), F.min("url").alias("least")).alias("urls"))
    known = own.join(won, "phrase", "full_outer").select("phrase", F.coalesce("dest", "urls").alias("dest"), F.coalesce("rule", F.lit(False)).alias("rule"))
    texts = known.select(F.col("phrase").alias("covered_by"), F.lit(0).alias("node_index"), F.col("phrase").alias("text"))
    hits = scan(texts, known.select("phrase"), ["covered_by"]).where(F.col("phrase") != F.col("covered_by")).select("phrase", "covered_by").distinct()
    inner = known.withColumnRenamed("dest", "d1").withColumnRenamed("rule", "r1")
    outer = known.select(F.col("phrase").alias("covered_by"), F.col("dest").alias("d2"), F.col("rule").alias("r2"))
    j = hits.join(inner, "phrase").join(outer, "covered_by")
    return j.select("phrase", "covered_by", (F.col("d1") == F.col("d2")).alias("same_destination"), (F.col("r1") & F.col("r2")).alias("live"), F.col("r1").alias("linking"))


def overlaps(pairs: DataFrame) -> DataFrame:
    """(phrase, n_covering) of phrases that link and that a linking phrase with another destination covers."""
    p = pairs.where(~F.col("same_destination"))
    g = p.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_covering"), F.max("live").alias("live"))
    return g.where(F.col("live")).select("phrase", "n_covering")


def overlap_page(pairs: DataFrame, search: str = "", page: int = 0, include_inactive: bool = False) -> DataFrame:
    """A page of (phrase, n_covering) by phrase. ``search`` is looked for in both phrases of a pair;
    ``include_inactive`` lists phrases that do not link and pairs with one destination, too."""
    p = pairs.where(F.contains("phrase", normalize_text(F.lit(search))) | F.contains("covered_by", normalize_text(F.lit(search)))) if search.strip() else pairs
    g = p.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_covering")) if include_inactive else overlaps(p)
    return page_of(g, ["phrase"], page)


def overlap_totals(pairs: DataFrame) -> DataFrame:
    """(active, settled, same_destination): phrases listed by default, phrases with another
    destination that are not, and pairs that lead to one destination."""
    g = pairs.groupBy("phrase").agg(F.max(~F.col("same_destination")).alias("other"), F.max(~F.col("same_destination") & F.col("live")).alias("active"), F.count_if("same_destination").alias("same"))
    return g.agg(F.count_if("active").alias("active"), F.count_if(F.col("other") & ~F.col("active")).alias("settled"), F.coalesce(F.sum("same"), F.lit(0)).alias("same_destination"))


def last_run(runs: DataFrame) -> DataFrame:
    """The run that started last, ties to the greater id; no row if there is none."""
    one = runs.agg(F.max(F.struct("started_at", "id", *[c for c in runs.columns if c not in ("started_at", "id")])).alias("r"))
    return one.where(F.col("r").isNotNull()).select("r.*")


def state_counts(terms: DataFrame) -> DataFrame:
    """(state, n) over all states, zero where there are none."""
    states = terms.sparkSession.createDataFrame([(s,) for s in TERM_STATES], "state string")
    return states.join(terms.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def stats_pages(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(active()).alias("live"),
        F.count_if(~F.col("enabled") & ~F.col("removed_from_source")).alias("disabled"),
        F.count_if("removed_from_source").alias("gone"),
        F.count_if(~F.col("auto_discovered")).alias("manual"),
    )


def stats_keywords(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in TERM_STATES], F.count_if(F.col("origin") == "manual").alias("manual"))


def stats_linking(rules: DataFrame) -> DataFrame:
    """(rules, contested): compiled rules; phrases with several linkable claimants that no setting owns."""
    won = compile_rules(rules)
    claims = linking_pairs(rules).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    owned = won.where(F.col("entry_id").isNull()).select("phrase")
    contested = claims.join(owned, "phrase", "left_anti").agg(F.count(F.lit(1)).alias("contested"))
    n = won.agg(F.count(F.lit(1)).alias("rules")).withColumn("k", F.lit(1))
    return n.join(contested.withColumn("k", F.lit(1)), "k").select("rules", "contested")


def stats_sitemaps(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("enabled", "pending", "ignored")],
        F.count_if((F.col("status") == "enabled") & (F.col("kind") != "index")).alias("importing"),
        F.count_if(F.col("kind") == "index").alias("indexes"),
    )


def types_mismatch(rules: int, active_entries: int) -> bool:
    """Pages are active, yet no rule compiled: the enabled types exclude everything."""
    return rules == 0 and active_entries > 0


def sitemap_stats(sitemaps: DataFrame, memberships: DataFrame, entries: DataFrame) -> DataFrame:
    """(sitemap_id, live, gone, n_children, pending_children) per sitemap, zero-filled."""
    e = entries.select(F.col("id").alias("entry_id"), active().alias("is_live"), F.col("removed_from_source").alias("is_gone"))
    m = memberships.join(e, "entry_id").groupBy("sitemap_id").agg(F.count_if("is_live").alias("live"), F.count_if("is_gone").alias("gone"))
    kids = sitemaps.where(F.col("parent_url") != "").groupBy(F.col("parent_url").alias("url")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("status") == "pending").alias("pending_children"))
    s = sitemaps.select(F.col("id").alias("sitemap_id"), "url").join(m, "sitemap_id", "left").join(kids, "url", "left")
    return s.select("sitemap_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("live", "gone", "n_children", "pending_children")])


def run_result(as_of: Column, heartbeat_seconds: int = 90) -> Column:
    """failed, partial or ok; unfinished: running while its heartbeat is fresh, else interrupted."""
    beat = F.greatest("updated_at", "started_at")
    fresh = F.timestamp_diff("SECOND", beat, as_of) <= heartbeat_seconds
    done = F.when(~F.col("success"), "failed").when(F.col("partial"), "partial").otherwise("ok")
    return F.when(F.col("finished_at").isNotNull(), done).when(fresh, "running").otherwise("interrupted")


def linkable_terms(terms: DataFrame, entries: DataFrame) -> DataFrame:
    return terms.where(linkable()).join(entries.where(active()).select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
