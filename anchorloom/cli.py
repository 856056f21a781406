"""python -m anchorloom.cli report|preview FOLDER: text reports over a folder of tables;
python -m anchorloom.cli sync FOLDER --source URL TYPE ...: one pass over a versioned catalog."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import functions as F

from anchorloom.operators import reports
from anchorloom.operators.control import RunControl
from anchorloom.operators.phrases import generate_terms
from anchorloom.pipeline import Fetcher, SyncReport, sync_catalog
from anchorloom.runtime import local_session
from anchorloom.settings import Settings
from anchorloom.sources.catalog import Catalog
from anchorloom.sources.snapshots import SnapshotStore


def report(c: Catalog, n: int) -> None:
    reports.stats_pages(c.entries).show()
    reports.stats_keywords(c.terms).show()
    reports.stats_sitemaps(c.sitemaps).show()
    c.runs.orderBy(F.desc("started_at")).select("id", "started_at", "success", "partial").show(10)
    c.entries.orderBy("id").select("id", "content_type", "title", "url").show(n, truncate=60)


def preview(c: Catalog, n: int) -> None:
    """Phrases that the first ``n`` titles would give; nothing is written."""
    first = c.entries.orderBy("id").limit(min(max(n, 1), 50))
    generate_terms(first).orderBy("entry_id", "ordinal").show(500, truncate=60)


def sync(store: SnapshotStore, sources: list[tuple[str, str]], enabled: list[str], get: Callable[[str], bytes | None] | None = None, delay: float = 0.5) -> SyncReport:
    """One pass that fetches its documents and pages, under the lock of the catalog's folder."""
    spark = store.spark
    fetcher = Fetcher(spark, get, delay)
    sitemaps = spark.createDataFrame([(u, "enabled") for u in enabled], "url string, status string")
    docs = fetcher.documents(sources, sitemaps)
    report = sync_catalog(spark, store, sources, docs, fetcher.pages, sitemaps, Settings(), datetime.now(timezone.utc).replace(tzinfo=None), control=RunControl(f"{store.root}/control"))
    print(report)
    fetcher.telemetry().show(truncate=80)
    fetcher.work.clear()
    return report


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["report", "preview", "sync"])
    p.add_argument("folder")
    p.add_argument("-n", type=int, default=10)
    p.add_argument("--source", nargs=2, action="append", default=[], metavar=("URL", "TYPE"))
    p.add_argument("--enabled", action="append", default=[], metavar="URL", help="a child sitemap to read")
    a = p.parse_args(argv)
    if a.command == "sync":
        sync(SnapshotStore(local_session("cli"), a.folder), [tuple(s) for s in a.source], a.enabled)
        return
    {"report": report, "preview": preview}[a.command](Catalog(local_session("cli"), a.folder), a.n)


if __name__ == "__main__":
    main()
