"""Fetching pages over HTTP, as a function that runs on executors or is replaced by a table."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_BYTES, SITEMAP_BYTES, SECONDS, REDIRECTS = 512 * 1024, 8 * 1024 * 1024, 30.0, 3


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def http_get(url: str, max_bytes: int = PAGE_BYTES, redirects: int = REDIRECTS, seconds: float = SECONDS, stop: bytes = b"</title>") -> bytes | None:
    """The body, or null on any error. Reads until the cap, the deadline that all redirects
    share, or the end of the title; success statuses only; no retries."""
    deadline = time.monotonic() + seconds
    opener = urllib.request.build_opener(_NoRedirect)
    for _ in range(redirects + 1):
        left = deadline - time.monotonic()
        if left <= 0 or not url.lower().startswith(("http://", "https://")):
            return None
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": "anchorloom"}), timeout=left) as r:
                body = b""
                while len(body) < max_bytes and time.monotonic() < deadline:
                    chunk = r.read(min(65536, max_bytes - len(body)))
                    body += chunk
                    if not chunk or stop and stop in body.lower():
                        break
                return body
        except urllib.error.HTTPError as e:
            target = e.headers.get("Location") if 300 <= e.code < 400 else None
            if not target:
                return None
            url = urljoin(url, target)
        except Exception:
            return None
    return None


def fetch_urls(urls: DataFrame, get: Callable[[str], bytes | None] = http_get, delay_seconds: float = 0.5) -> DataFrame:
    """(url, body, seconds): the urls of a host are fetched by one task, one after the other with
    ``delay_seconds`` between them; null body: failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                t = time.monotonic()
                rows.append((u, get(u), time.monotonic() - t))
                time.sleep(delay_seconds)
            yield pd.DataFrame(rows, columns=["url", "body", "seconds"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][^:]*://([^/?#]*)", 1))
    return urls.select("url").repartition(host).mapInPandas(run, "url string, body binary, seconds double")


def fetch_telemetry(fetched: DataFrame, slowest: int = 5) -> DataFrame:
    """One row of what ``fetch_urls`` gave: n_fetches, n_failed, total_seconds, mean_seconds and
    the ``slowest`` fetches as (seconds, url), the slowest first, ties by url."""
    top = fetched.select("url", "seconds").orderBy(F.desc("seconds"), "url").limit(slowest)
    agg = fetched.agg(F.count(F.lit(1)).alias("n_fetches"), F.count_if(F.col("body").isNull()).alias("n_failed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"), F.avg("seconds").alias("mean_seconds"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("seconds")).alias("s"), "url"))), lambda x: F.struct((-x["s"]).alias("seconds"), x["url"].alias("url")))
    one = F.lit(1).alias("k")
    return agg.select("*", one).join(top.agg(listed.alias("slowest")).select("*", one), "k").drop("k")
