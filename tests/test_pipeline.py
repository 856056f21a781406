"""A catalog through several passes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anchorloom.operators.control import RunControl

from anchorloom.pipeline import catalog_rules, link_posts, sync_catalog
from anchorloom.settings import Settings
from anchorloom.sources.snapshots import SnapshotStore

T = datetime(2025, 1, 1)


def urlset(*urls, cut=False):
    body = "".join(f"<url><loc>{u}</loc><lastmod>{m}</lastmod></url>" for u, m in urls)
    return f"<urlset>{body}" + ("" if cut else "</urlset>")


def test_passes(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "cat"))
    maps = spark.createDataFrame([("https://a/kids.xml", "enabled")], "url string, status string")
    src = [("https://a/s.xml", "docs"), ("https://a/i.xml", "wiki")]
    s = Settings(excluded_url_patterns=("/tag/",), title_suffixes=("| A",), auto_rebake_on_changes=True)

    def run(docs, pages, day, sources=src):
        d = spark.createDataFrame(docs, "url string, xml string")
        w = spark.createDataFrame(pages, "url string, html string")
        return sync_catalog(spark, store, sources, d, w, maps, s, T + timedelta(days=day))

    index = ("https://a/i.xml", "<sitemapindex><sitemap><loc>https://a/kids.xml</loc></sitemap></sitemapindex>")
    kids = ("https://a/kids.xml", urlset(("https://a/x", "1"), ("https://a/z", "1")))
    docs = [("https://a/s.xml", urlset(("https://a/x/", "1"), ("https://a/y-page", "1"), ("https://a/tag/q", "1"))), index, kids]
    pages = [("https://a/x", "<title>Widget Frame Kit | A</title>"), ("https://a/z", "<title>Zephyr Pump House</title>")]
    r = run(docs, pages, 0)
    assert r.clean and r.version == 1
    assert {k: r.counts[k] for k in ("seen", "excluded", "added", "removed", "retitled")} == {"seen": 3, "excluded": 1, "added": 3, "removed": 0, "retitled": 0}
    e = {x["url"]: x for x in store.read("entries").collect()}
    assert (e["https://a/x"]["title"], e["https://a/x"]["content_type"]) == ("Widget Frame Kit", "docs")
    assert (e["https://a/y-page"]["title"], e["https://a/y-page"]["title_source"], e["https://a/y-page"]["title_fetch_failures"]) == ("Y Page", "slug", 1)
    assert e["https://a/z"]["content_type"] == "wiki" and len({x["id"] for x in e.values()}) == 3
    assert store.read("memberships").count() == 4

    # The page that failed is not due yet; a changed one is fetched again; nothing else changes.
    docs[0] = ("https://a/s.xml", urlset(("https://a/x/", "2"), ("https://a/y-page", "1")))
    r = run(docs, [("https://a/x", "<title>Gadget Frame Kit</title>")], 0.5)
    assert (r.counts["retitled"], r.counts["added"], r.counts["removed"]) == (1, 0, 0)
    phrases = {x["normalized_phrase"] for x in store.read("terms").collect()}
    assert "gadget frame kit" in phrases and "widget frame kit" not in phrases

    # A cut-off document is an error: nothing is removed.
    r = run([("https://a/s.xml", urlset(("https://a/x", "2"), cut=True)), index, kids], [], 2)
    assert not r.clean and r.counts["removed"] == 0
    assert not run([], [], 2, sources=[]).clean

    # A complete pass removes what is no longer listed, and its rows of sitemaps read in full.
    r = run([("https://a/s.xml", urlset(("https://a/x", "2"))), index, ("https://a/kids.xml", urlset(("https://a/x", "1")))], [], 3)
    assert r.counts["removed"] == 2
    assert {x["url"] for x in store.read("entries").where("removed_from_source").collect()} == {"https://a/y-page", "https://a/z"}
    assert store.read("memberships").count() == 2
    runs = store.read("runs").orderBy("started_at").collect()
    assert [r["removed"] for r in runs] == [0, 0, 0, 0, 2] and [r["success"] for r in runs] == [True, True, False, False, True]

    posts = spark.createDataFrame([(1, "A gadget frame kit and a zephyr pump house.", "regular", 1, None, False)], "id bigint, raw string, post_type string, topic_id bigint, category_id bigint, private boolean")
    cats = spark.createDataFrame([], "id bigint, parent_id bigint")
    out = link_posts(posts, cats, catalog_rules(spark, store, s), s).first()
    assert out["n_links"] == 1 and "zephyr pump house." in out["rendered"]

    # Listed again: restored, and linked again.
    r = run([("https://a/s.xml", urlset(("https://a/x", "2"), ("https://a/z", "1"))), index, kids], [], 4)
    assert r.counts["restored"] == 1
    out = link_posts(posts, cats, catalog_rules(spark, store, s), s).first()
    assert out["n_links"] == 2
    assert store.read("changes").where(F.col("change") == "restored").count() == 1


def test_emptied_sitemap_and_control(spark, tmp_path):
    """A sitemap read in full that lists nothing any more keeps no memberships; a run that is
    stopped removes nothing; two runs do not go side by side."""
    store = SnapshotStore(spark, str(tmp_path / "cat"))
    maps = spark.createDataFrame([], "url string, status string")
    web = spark.createDataFrame([], "url string, html string")
    control = RunControl(str(tmp_path / "control"))

    def run(urls, day):
        docs = spark.createDataFrame([("https://a/s.xml", urlset(*urls)), ("https://a/t.xml", urlset(("https://a/t", "1")))], "url string, xml string")
        return sync_catalog(spark, store, [("https://a/s.xml", "wiki"), ("https://a/t.xml", "wiki")], docs, web, maps, Settings(), T + timedelta(days=day), control=control)

    run([("https://a/x", "1")], 0)
    control.cancel()
    r = run([], 1)
    assert not r.clean and r.counts["removed"] == 0 and store.read("memberships").count() == 2
    (tmp_path / "control" / "cancel").unlink()
    with control.lock(), pytest.raises(RuntimeError):
        run([], 2)
    r = run([], 2)
    assert r.clean and r.counts["removed"] == 1
    assert [m["sitemap_url"] for m in store.read("memberships").collect()] == ["https://a/t.xml"]


def test_cli(spark, capsys):
    from anchorloom.cli import preview, report
    from anchorloom.sources.catalog import Catalog

    c = Catalog(spark, "/root/testdata/sf0.001")
    report(c, 3)
    preview(c, 3)
    assert "auto_active" in capsys.readouterr().out


def test_cli_sync(spark, tmp_path, capsys):
    """A pass that fetches: sources, their enabled children, then the pages that are due."""
    from anchorloom.cli import sync

    web = {
        "https://a/i.xml": "<sitemapindex><sitemap><loc>https://a/k.xml</loc></sitemap><sitemap><loc>https://a/off.xml</loc></sitemap></sitemapindex>",
        "https://a/k.xml": urlset(("https://a/x", "1"), ("https://a/y-page", "1")), "https://a/x": "<title>Caf&#xe9; Widget</title>",
    }
    store = SnapshotStore(spark, str(tmp_path / "cat"))
    get = lambda u: web[u].encode() if u in web else None
    r = sync(store, [("https://a/i.xml", "wiki")], ["https://a/k.xml"], get, 0)
    assert r.clean and r.counts["added"] == 2
    assert {e["url"]: e["title"] for e in store.read("entries").collect()} == {"https://a/x": "Café Widget", "https://a/y-page": "Y Page"}
    assert "n_fetches" in capsys.readouterr().out
    # An enabled child that does not answer: nothing is removed.
    del web["https://a/k.xml"]
    r = sync(store, [("https://a/i.xml", "wiki")], ["https://a/k.xml"], get, 0)
    assert not r.clean and r.counts["removed"] == 0


def test_unread_children_keep_their_pages(spark, tmp_path):
    """Children beyond the cap and enabled ones that fail make a pass unclean: nothing is removed."""
    kid = lambda k: f"https://a/k{k}.xml"
    index = lambda ks: ("https://a/i.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>{kid(k)}</loc></sitemap>" for k in ks) + "</sitemapindex>")
    page = lambda k, cut=False: (kid(k), urlset((f"https://a/p{k}", "1"), cut=cut))
    maps = spark.createDataFrame([(kid(k), "enabled") for k in range(102)] + [(kid(900), "pending")], "url string, status string")
    web = spark.createDataFrame([], "url string, html string")
    store = SnapshotStore(spark, str(tmp_path / "cat"))

    def run(docs, day):
        return sync_catalog(spark, store, [("https://a/i.xml", "wiki")], spark.createDataFrame(docs, "url string, xml string"), web, maps, Settings(), T + timedelta(days=day))

    # A pending child that is not there is no failure.
    r = run([index([0, 101, 900]), page(0), page(101)], 0)
    assert r.clean and r.counts["added"] == 2
    # The child is now behind the cap; its page stays.
    r = run([index(range(102)), *[page(k) for k in range(102)]], 1)
    assert not r.clean and r.counts["removed"] == 0 and not r.errors and "102" in r.notes[0]
    r = run([index([0, 101]), page(0), page(101, cut=True)], 2)
    assert not r.clean and r.counts["removed"] == 0 and kid(101) in r.errors[0]
