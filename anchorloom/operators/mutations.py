"""Catalog changes as functions from tables to tables, and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.text import normalize_text
from anchorloom.settings import SITEMAP_STATUSES, check_state

MAX_BULK_IDS = 1_000


def create_entry(entries: DataFrame, url: str, title: str, content_type: str) -> DataFrame:
    """With a manual entry; refused if a field is blank or the url is taken."""
    if not (url.strip() and title.strip() and content_type.strip()):
        raise ValueError("url, title and content type must be given")
    if not entries.where(F.col("url") == url.strip()).isEmpty():
        raise ValueError(f"url is taken: {url}")
    row = entries.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    given = {"url": F.lit(url.strip()), "title": F.lit(title), "content_type": F.lit(content_type), "source": F.lit("manual"), "title_source": F.lit("manual"), "enabled": F.lit(True), "auto_discovered": F.lit(False), "removed_from_source": F.lit(False), "title_fetch_failures": F.lit(0)}
    cols = [F.col("id") if f.name == "id" else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema.fields]
    return entries.unionByName(row.select(*cols))


def add_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """(entry_id, phrase, normalized_phrase, state, origin) rows of aliases that are new to their
    entry: approved and manual, normalized but not stripped, blank ones and repeats left out."""
    n = new.select("entry_id", "phrase", normalize_text("phrase").alias("normalized_phrase")).where(F.col("phrase").rlike(r"\S"))
    n = n.groupBy("entry_id", "normalized_phrase").agg(F.min("phrase").alias("phrase"))
    n = n.join(terms.select("entry_id", "normalized_phrase"), ["entry_id", "normalized_phrase"], "left_anti")
    return n.select("entry_id", "phrase", "normalized_phrase", F.lit("approved").alias("state"), F.lit("manual").alias("origin"))


def set_state(terms: DataFrame, where: Column, state: str) -> DataFrame:
    """All terms, with the state of those that ``where`` selects."""
    return terms.withColumn("state", F.when(where, F.lit(check_state(state))).otherwise(F.col("state")))


def set_state_of(terms: DataFrame, ids: list[int], state: str) -> DataFrame:
    if len(ids) > MAX_BULK_IDS:
        raise ValueError(f"at most {MAX_BULK_IDS} ids at once; use a filter")
    return set_state(terms, F.col("id").isin(list(ids)), state)


def destroy_terms(terms: DataFrame, ids: DataFrame) -> DataFrame:
    return terms.join(ids.select("id"), "id", "left_anti")


def purge(entries: DataFrame, terms: DataFrame, memberships: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without entries that are gone (and fulfil ``where``). Live entries stay."""
    doomed = entries.where("removed_from_source")
    doomed = (doomed if where is None else doomed.where(where)).select("id")
    ids = doomed.withColumnRenamed("id", "entry_id")
    return entries.join(doomed, "id", "left_anti"), terms.join(ids, "entry_id", "left_anti"), memberships.join(ids, "entry_id", "left_anti")


def detach(memberships: DataFrame, entries: DataFrame, sitemap_ids: DataFrame) -> DataFrame:
    """(entry_id) of sitemap entries that are in no sitemap once those of ``sitemap_ids`` are off."""
    off = sitemap_ids.select("sitemap_id")
    hit = memberships.join(off, "sitemap_id", "left_semi").select("entry_id").distinct()
    rest = memberships.join(off, "sitemap_id", "left_anti").select("entry_id").distinct()
    own = entries.where(F.col("source") == "sitemap").select(F.col("id").alias("entry_id"))
    return hit.join(rest, "entry_id", "left_anti").join(own, "entry_id", "left_semi")


def update_entry(entries: DataFrame, entry_id: int, changes: dict) -> DataFrame:
    """All entries, with the given fields of one changed: enabled, priority (null takes it away), url
    and title, of which blank ones are left as they are. A url that another entry has, an
    unknown field and an unknown id are refused."""
    if set(changes) - {"enabled", "priority", "url", "title"}:
        raise ValueError(f"fields cannot be changed: {sorted(changes)}")
    given = {k: v for k, v in changes.items() if k not in ("url", "title") or (v and v.strip())}
    if "url" in given:
        given["url"] = given["url"].strip().rstrip("/")
        if not entries.where((F.col("url") == given["url"]) & (F.col("id") != entry_id)).isEmpty():
            raise ValueError(f"url is taken: {given['url']}")
    if entries.where(F.col("id") == entry_id).isEmpty():
        raise ValueError(f"no such entry: {entry_id}")
    types = {f.name: f.dataType for f in entries.schema.fields}
    return entries.withColumns({k: F.when(F.col("id") == entry_id, F.lit(v).cast(types[k])).otherwise(F.col(k)) for k, v in given.items()})


def update_term(terms: DataFrame, term_id: int, state: str | None = None, phrase: str | None = None) -> DataFrame:
    """All terms, with state or phrase of one changed; a new phrase is normalized anew."""
    one = F.col("id") == term_id
    out = terms if state is None else set_state(terms, one, state)
    if phrase is not None and phrase.strip():
        out = out.withColumn("phrase", F.when(one, F.lit(phrase)).otherwise(F.col("phrase")))
        out = out.withColumn("normalized_phrase", F.when(one, normalize_text("phrase")).otherwise(F.col("normalized_phrase")))
    return out


def destroy_entry(entries: DataFrame, terms: DataFrame, memberships: DataFrame, entry_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without one entry that is gone; a live one is refused."""
    if entries.where((F.col("id") == entry_id) & F.col("removed_from_source")).isEmpty():
        raise ValueError(f"not an entry that is gone: {entry_id}")
    return purge(entries, terms, memberships, F.col("id") == entry_id)


def set_sitemap_status(sitemaps: DataFrame, memberships: DataFrame, entries: DataFrame, sitemap_id: int, status: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sitemaps, memberships, entries) after a change of status. One that is no longer enabled
    loses its memberships, and entries that were listed only there are gone."""
    if status not in SITEMAP_STATUSES:
        raise ValueError(f"unknown status: {status}")
    one = F.col("id") == sitemap_id
    off = sitemaps.where(one & (F.col("status") == "enabled")).select(F.col("id").alias("sitemap_id"))
    changed = sitemaps.withColumn("status", F.when(one, F.lit(status)).otherwise(F.col("status")))
    if status == "enabled":
        return changed, memberships, entries
    lost = detach(memberships, entries, off).select(F.col("entry_id").alias("id"), F.lit(True).alias("lost"))
    e = entries.join(lost, "id", "left").withColumn("removed_from_source", F.col("removed_from_source") | F.coalesce("lost", F.lit(False))).select(*entries.columns)
    return changed, memberships.join(off, "sitemap_id", "left_anti"), e


def integrity(entries: DataFrame, terms: DataFrame, sitemaps: DataFrame, memberships: DataFrame) -> DataFrame:
    """(check_name, n) of rows or keys that break a constraint; all checks, also with 0."""

    def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")).select(F.lit(name).alias("check_name"), "n")

    def broken(df: DataFrame, cond: Column, name: str) -> DataFrame:
        return df.agg(F.count_if(F.coalesce(cond, F.lit(True))).alias("n")).select(F.lit(name).alias("check_name"), "n")

    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    checks = [
        repeated(entries, ["url"], "entry_url_repeated"),
        broken(entries, blank("url") | blank("title") | blank("content_type"), "entry_blank"),
        repeated(terms, ["entry_id", "normalized_phrase"], "term_repeated"),
        broken(terms, blank("phrase"), "term_blank"),
        repeated(sitemaps, ["url"], "sitemap_url_repeated"),
        broken(sitemaps, ~F.col("status").isin(*SITEMAP_STATUSES), "sitemap_status"),
        repeated(memberships, ["entry_id", "sitemap_id"], "membership_repeated"),
    ]
    return reduce(DataFrame.unionByName, checks)
