"""Streams: posts to links as they arrive, clicks to windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.operators.render import plain_nodes, render_text
from anchorloom.operators.resolve import resolve
from anchorloom.operators.scan import scan
from anchorloom.settings import Settings


class RulesetCache:
    """The compiled ruleset of a catalog version; compiled anew only when the version or a
    setting that rules depend on changes. ``compile`` gives a DataFrame, kept in memory
    while it is current (lost blocks are computed again)."""

    def __init__(self, compile: Callable[[], DataFrame]):
        self.compile, self.key, self.rules = compile, None, None

    def get(self, version: int, settings: Settings) -> DataFrame:
        key = (version, settings.rule_key())
        if key != self.key:
            if self.rules is not None:
                self.rules.unpersist()
            self.rules, self.key = self.compile().persist(), key
        return self.rules


def link_batch(posts: DataFrame, rules: DataFrame, settings: Settings, key: str = "id", text: str = "raw") -> DataFrame:
    """(key, rendered, n_links) of one batch; a post that comes twice in it is linked once."""
    nodes = plain_nodes(posts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).dropDuplicates([key]), key, text)
    links = resolve(scan(nodes, rules, [key]), rules, [key], settings.max_links_per_destination, settings.max_links_per_post)
    return render_text(nodes, links, [key], settings.anchor_class).drop("node_index")


def link_stream(stream: DataFrame, rules: Callable[[], DataFrame], settings: Settings, out: str, checkpoint: str):
    """Start a query that links each micro-batch and appends it to parquet under ``out``.

    A batch is written to a folder of its own number, so a batch that is run again after a
    failure replaces its output instead of repeating it.
    """

    def each(batch: DataFrame, number: int) -> None:
        # Scanned and rendered: read once.
        batch.persist()
        try:
            link_batch(batch, rules(), settings).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def click_windows(clicks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, clicks): counts per window; clicks later than ``late`` are dropped.
    Works on a stream and on a table."""
    w = clicks.withWatermark("ts", late) if clicks.isStreaming else clicks
    g = w.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("clicks"))
    return g.select(F.col("w.start").alias("start"), "event_type", "clicks")


def click_payload(events: DataFrame, col: str = "payload", url: str = "url") -> DataFrame:
    """Click events from JSON: link_type, matched_term, destination, post_id, topic_id; the topic
    falls back to the one in the page's path."""
    schema = "link_type string, matched_term string, destination string, post_id string, topic_id string"
    e = events.withColumn("p", F.from_json(col, schema))
    path = F.nullif(F.regexp_extract(url, r"/t/(?:[^/]+/)?(\d+)", 1), F.lit(""))
    return e.select("p.link_type", "p.matched_term", "p.destination", "p.post_id", F.coalesce("p.topic_id", path).alias("topic_id"))
