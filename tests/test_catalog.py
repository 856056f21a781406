"""Sync, mutations, waves, control, stores, streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anchorloom.operators import mutations, rebake, reports, sync
from anchorloom.operators.control import RunControl
from anchorloom.operators.posts import excluded_categories, linkable_posts
from anchorloom.settings import Settings
from anchorloom.sources import sitemaps as sm
from anchorloom.sources.http import fetch_telemetry, fetch_urls
from anchorloom.sources.snapshots import SnapshotStore
from anchorloom.streaming.posts import RulesetCache, click_payload, click_windows, link_stream

T = datetime(2025, 1, 1)


def test_parse_sitemap(spark):
    xml = "<urlset><URL><loc> https://a/?x=1&amp;y=2 </loc><lastmod>2025</lastmod></url><url></url><url><loc>https://b</loc></url></urlset>"
    df = spark.createDataFrame([("s", xml), ("n", None), ("e", "")], "url string, xml string")
    assert [tuple(r) for r in sm.parse_sitemap(df).collect()] == [("s", 0, "https://a/?x=1&y=2", "2025"), ("s", 2, "https://b", None)]
    assert {r["url"]: r["url_count_partial"] for r in sm.measure(df).collect()} == {"s": False, "n": True, "e": True}


def test_expand_cap(spark):
    kids = "".join(f"<sitemap><loc>c{k}</loc></sitemap>" for k in range(5))
    docs = [("i", f"<sitemapindex>{kids}</sitemapindex>"), *[(f"c{k}", f"<urlset><url><loc>p{k}</loc></url></urlset>") for k in range(4)], ("c4", "<sitemapindex></sitemapindex>")]
    docs = spark.createDataFrame(docs, "url string, xml string")
    maps = spark.createDataFrame([("c0", "enabled"), ("c1", "pending"), ("c2", "enabled"), ("c4", "enabled")], "url string, status string")
    src = spark.createDataFrame([("i",), ("gone",)], "url string")
    assert sorted(r["loc"] for r in sm.expand(src, docs, maps).collect()) == ["p0", "p2"]
    assert sorted(r["loc"] for r in sm.expand(src, docs, maps, cap=2).collect()) == ["p0"]


def test_admission_and_removal(spark):
    rows = [(1, "https://a/", "x", None, 1), (2, "https://a", "y", "m", 2), (3, "https://a/tag/1", "x", None, 1), (4, "https://a/tag/1", "x", None, 2), (5, "ftp://z", "x", None, 1), (6, " ", "x", None, 1)]
    listing = spark.createDataFrame(rows, "ordinal int, loc string, content_type string, lastmod string, sitemap_id int")
    ad = sync.admission(listing, Settings(excluded_url_patterns=("/tag/",)))
    assert {r["url"]: (r["content_type"], r["n_listed"], r["excluded"]) for r in ad.collect()} == {"https://a": ("x", 2, False), "https://a/tag/1": ("x", 2, True), "ftp://z": ("x", 1, True)}
    assert tuple(sync.admission_counts(ad).first()) == (1, 3)
    e = spark.createDataFrame([(1, "https://a", "q", "sitemap", True, True), (2, "https://a/tag/1", "x", "sitemap", True, False), (3, "https://m", "x", "manual", False, False)], "id int, url string, content_type string, source string, auto_discovered boolean, removed_from_source boolean")
    got = {r["url"]: (r["change"], r["retyped"]) for r in sync.diff(ad, e).collect()}
    assert got == {"https://a": ("restored", True), "https://a/tag/1": ("removed", False), "https://m": ("untouched", False)}
    seen = ad.where("not excluded")
    assert [r["entry_id"] for r in sync.mark_removed(e, seen, True).collect()] == [2]
    assert sync.mark_removed(e, seen, False).count() == 0


def test_refetch(spark):
    later = T + timedelta(days=1)
    e = spark.createDataFrame(
        [(1, "a", "A", "page", "m1", None, 0), (2, "b", "B", "slug", None, later, 3), (3, "c", "C", "slug", None, None, 1), (4, "d", "D", "page", "m", None, 0), (5, "e", "E", "slug", None, T, 0)],
        "id int, url string, title string, title_source string, lastmod string, next_title_fetch_at timestamp_ntz, title_fetch_failures int",
    )
    ad = spark.createDataFrame([("a", "m2", False), ("b", "", False), ("c", None, False), ("d", "m", False), ("e", None, False), ("x", None, True)], "url string, lastmod string, excluded boolean")
    plan = sync.refetch_plan(ad, e, F.lit(T).cast("timestamp_ntz"))
    assert {r["url"]: r["decision"] for r in plan.collect()} == {"a": "refetch", "b": "deferred", "c": "refetch", "d": "unchanged", "e": "refetch"}
    titles = spark.createDataFrame([("a", "New", "page"), ("c", "C", "page"), ("e", "slug", "slug")], "url string, title string, title_source string")
    got = {r["entry_id"]: (r["title"], r["title_source"], r["failures"], r["retry_days"], r["outcome"]) for r in sync.refetch_outcome(plan, titles, e).collect()}
    assert got == {1: ("New", "page", 0, None, "retitled"), 3: ("C", "page", 0, None, "healed"), 5: ("E", "slug", 1, 1, "failed")}


def test_categories_and_posts(spark):
    cats = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 7)], "id bigint, parent_id bigint")
    assert sorted(r["id"] for r in excluded_categories(cats, (1,)).collect()) == [1, 2, 3, 4, 5]
    assert excluded_categories(cats, ()).count() == 0
    posts = spark.createDataFrame([(1, "x", "regular", 1, None, False), (2, " ", "regular", 1, None, False), (3, "x", "whisper", 1, None, False), (4, "x", "regular", None, None, False), (5, "x", "regular", 1, 3, False), (6, "x", "regular", 1, None, True), (7, None, "regular", 1, None, False)], "id int, raw string, post_type string, topic_id int, category_id int, private boolean")
    assert sorted(r["id"] for r in linkable_posts(posts, cats, Settings(excluded_categories=(1,))).collect()) == [1]
    assert sorted(r["id"] for r in linkable_posts(posts, cats, Settings(include_private=True)).collect()) == [1, 5, 6]


def test_mutations(spark):
    e = spark.createDataFrame([(1, "u1", "t", "c", "sitemap", True, False), (2, "u2", "t", "c", "sitemap", True, True)], "id bigint, url string, title string, content_type string, source string, enabled boolean, removed_from_source boolean")
    t = spark.createDataFrame([(1, 1, "P", "p", "auto_active", "generated"), (2, 2, "Q", "q", "approved", "manual")], "id bigint, entry_id bigint, phrase string, normalized_phrase string, state string, origin string")
    m = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "entry_id bigint, sitemap_id bigint")
    new = mutations.create_entry(e, " u3 ", "T", "c")
    assert {r["id"]: r["url"] for r in new.collect()}[3] == "u3"
    for bad in (("u1", "t", "c"), ("", "t", "c")):
        with pytest.raises(ValueError):
            mutations.create_entry(e, *bad)
    assert [len(x.collect()) for x in mutations.purge(e, t, m)] == [1, 1, 2]
    off = spark.createDataFrame([(10,)], "sitemap_id bigint")
    assert [r["entry_id"] for r in mutations.detach(m, e, off).collect()] == [2]
    add = spark.createDataFrame([(1, "P"), (1, " X’s"), (1, " X's"), (1, "  ")], "entry_id bigint, phrase string")
    assert [r["normalized_phrase"] for r in mutations.add_terms(t, add).collect()] == [" x's"]
    with pytest.raises(ValueError):
        mutations.set_state_of(t, list(range(1001)), "approved")
    assert {r["id"]: r["state"] for r in mutations.set_state_of(t, [1], "disabled").collect()} == {1: "disabled", 2: "approved"}


def test_waves(spark):
    posts = spark.createDataFrame([(i, f"Foreman’s Field {i}" if i % 2 else "none 100%", None) for i in range(1, 21)] + [(30, "foreman's field", T), (31, None, None)], "id bigint, raw string, deleted_at timestamp_ntz")
    ph = rebake.wave_phrases(spark.createDataFrame([("foreman's field",), (" foreman's field ",), ("ab",), (None,)], "phrase string"))
    assert ph.count() == 1
    wave, got = rebake.Wave(Settings(max_rebakes_per_job_run=4), max_posts=7), []
    while not wave.done:
        ids = [r["id"] for r in rebake.batch(posts, ph, wave.after_id, wave.budget).collect()]
        got += ids
        wave.advance(ids)
    assert got == [1, 3, 5, 7, 9, 11, 13]
    assert rebake.candidates(posts, ph.limit(0)).count() == 0
    g = lambda n: rebake.gate(spark.range(n).select(F.col("id").cast("string").alias("phrase")), Settings()).first()["decision"]
    assert (g(0), g(50), g(51)) == ("none", "rebake", "skip")


def test_run_result(spark):
    df = spark.createDataFrame([(True, False, T, T, T), (False, True, T, T, T), (True, True, T, T, T), (False, False, None, T, T), (False, False, None, T, T + timedelta(seconds=100))], "success boolean, partial boolean, finished_at timestamp_ntz, started_at timestamp_ntz, updated_at timestamp_ntz")
    at = F.lit(T + timedelta(seconds=120)).cast("timestamp_ntz")
    assert [r[0] for r in df.select(reports.run_result(at)).collect()] == ["ok", "failed", "partial", "interrupted", "running"]
    assert reports.types_mismatch(0, 3) and not reports.types_mismatch(1, 3)


def test_control(tmp_path):
    now = [1000.0]
    c = RunControl(str(tmp_path), 1, clock=lambda: now[0])
    with c.lock():
        with pytest.raises(RuntimeError), RunControl(str(tmp_path), 1, clock=lambda: now[0]).lock():
            pass
        assert c.heartbeat(1) and not c.heartbeat(2)
        c.cancel()
        assert c.cancelled()
        now[0] += 601
        assert not c.cancelled() and c.out_of_time() and not c.locked()
    assert not c.locked()


def test_store(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "cat"))
    assert s.version() == 0
    assert s.commit({"terms": spark.range(3)}, 0) == 1
    assert s.read("terms").count() == 3
    with pytest.raises(RuntimeError):
        s.commit({"terms": spark.range(1)}, 0)


def test_fetch(spark):
    out = fetch_urls(spark.createDataFrame([("a",), ("b",)], "url string"), lambda u: b"x" if u == "a" else None, 0)
    assert {r["url"]: r["body"] for r in out.collect()} == {"a": bytearray(b"x"), "b": None}
    seen = spark.createDataFrame([(f"u{k}", b"x" if k % 2 else None, k / 2) for k in range(8)], "url string, body binary, seconds double")
    t = fetch_telemetry(seen).first()
    assert (t["n_fetches"], t["n_failed"], t["total_seconds"], [x["url"] for x in t["slowest"]]) == (8, 4, 14.0, ["u7", "u6", "u5", "u4", "u3"])
    assert fetch_telemetry(seen.limit(0)).first()["slowest"] == []


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "my bow saw"), (1, "my bow saw"), (2, None), (3, "x")], "id bigint, raw string").write.parquet(src)
    r = spark.createDataFrame([("bow saw", "/t/1", "t", None, None)], "phrase string, url string, type string, priority int, entry_id bigint")
    calls = []
    cache = RulesetCache(lambda: calls.append(1) or r)
    stream = spark.readStream.schema("id bigint, raw string").parquet(src)
    q = link_stream(stream, lambda: cache.get(1, Settings()), Settings(), out, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {x["id"]: x["n_links"] for x in spark.read.parquet(out).collect()} == {1: 1, 3: 0}
    cache.get(1, Settings(min_phrase_length=3))
    assert len(calls) == 1
    cache.get(2, Settings())
    assert len(calls) == 2
    ev = spark.createDataFrame([(T, "c"), (T + timedelta(minutes=5), "c"), (T + timedelta(hours=2), "d")], "ts timestamp, event_type string")
    assert sorted(x["clicks"] for x in click_windows(ev).collect()) == [1, 2]
    p = spark.createDataFrame([('{"link_type":"a","destination":"u"}', "/t/slug/42"), ("broken", "/x")], "payload string, url string")
    assert [(x["link_type"], x["topic_id"]) for x in click_payload(p).collect()] == [("a", "42"), (None, None)]


def test_two_writers(spark, tmp_path):
    """The slower of two writers of one version fails and leaves the winner's files alone."""
    a, b = SnapshotStore(spark, str(tmp_path / "cat")), SnapshotStore(spark, str(tmp_path / "cat"))
    version = b.version
    b.version = lambda: 0
    assert a.commit({"terms": spark.range(3)}, 0) == 1
    with pytest.raises(RuntimeError):
        b.commit({"terms": spark.range(9)}, 0)
    b.version = version
    assert a.read("terms").count() == b.read("terms").count() == 3


def test_stale_lock(tmp_path):
    now = [1000.0]
    run = lambda: RunControl(str(tmp_path), 1, clock=lambda: now[0])
    with run().lock():
        now[0] += 10_000
        with run().lock():
            with pytest.raises(RuntimeError), run().lock():
                pass
        assert not run().locked()
        # The lock of a run that took over is not given back by the run it was taken from.
        fresh = run().lock()
        fresh.__enter__()
    assert run().locked()
    fresh.__exit__(None, None, None)
    assert not run().locked()


def test_references(spark):
    from anchorloom.functions.text import title_from_html, unescape_html

    cases = {
        "Caf&#xe9;": "Café", "x &#128512; y": "x 😀 y", "&#X27;a": "'a", "&amp;lt;": "&lt;", "&amp;#39;": "&#39;", "&nbsp; &copy;": "&nbsp; &copy;", "&#x110000;&#xD800;&#99999999999;": "&#x110000;&#xD800;&#99999999999;",
        "&#0000000065;&lt;&gt;&quot;&apos;": "A<>\"'", "a & b": "a & b", "": "", "&#x1F527;&#8217;&#x41;": "🔧’A", "&AMP;": "&AMP;",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, w string")
    assert [tuple(r) for r in df.where(~unescape_html("t").eqNullSafe(F.col("w"))).collect()] == []
    html = spark.createDataFrame([("<title>Don&#x2019;t &#x1F600;</title>",)], "h string")
    assert html.select(title_from_html("h")).first()[0] == "Don’t 😀"
    assert sm.parse_sitemap(spark.createDataFrame([("s", "<urlset><url><loc>https://a/&#x62;?q=1&amp;r=&#50;</loc></url></urlset>")], "url string, xml string")).first()["loc"] == "https://a/b?q=1&r=2"


def test_waves_of_any_size(spark):
    """More phrases than one automaton holds, against plain containment."""
    posts = spark.createDataFrame([(k, f"text with w{k:04d}x inside", None) for k in range(0, 4000, 3)] + [(9000, None, None), (9001, "w0001x", T)], "id bigint, raw string, deleted_at timestamp_ntz")
    ph = rebake.wave_phrases(spark.range(3000).select(F.format_string("w%04dx", "id").alias("phrase")))
    want = set(range(0, 3000, 3))
    assert ph.count() == 3000
    for most in (rebake.SLICE_CHARS, 4000):
        assert {r["id"] for r in rebake.candidates(posts, ph, most).collect()} == want


def test_suffixes_without_end(spark):
    from anchorloom.functions.text import clean_title

    df = spark.createDataFrame([("Bow Saw" + " | A" * 120,), ("Bow Saw",), ("| A",)], "t string")
    assert [r[0] for r in df.select(clean_title("t", ("| A",))).collect()] == ["Bow Saw", "Bow Saw", None]


def test_updates(spark):
    e = spark.createDataFrame([(1, "https://a", "A", None, True, False, "sitemap"), (2, "https://b", "B", 3, True, False, "sitemap"), (3, "https://c", "C", None, True, True, "sitemap")], "id bigint, url string, title string, priority int, enabled boolean, removed_from_source boolean, source string")
    got = {r["id"]: r for r in mutations.update_entry(e, 2, {"enabled": False, "priority": None, "title": "New", "url": " "}).collect()}
    assert (got[2]["enabled"], got[2]["priority"], got[2]["title"], got[2]["url"], got[1]["title"]) == (False, None, "New", "https://b", "A")
    for bad in ((2, {"url": "https://a/"}), (9, {"title": "x"}), (1, {"id": 5})):
        with pytest.raises(ValueError):
            mutations.update_entry(e, *bad)
    t = spark.createDataFrame([(1, 1, "Bow Saw", "bow saw", "pending_review"), (2, 3, "X", "x", "approved")], "id bigint, entry_id bigint, phrase string, normalized_phrase string, state string")
    one = {r["id"]: r for r in mutations.update_term(t, 1, "approved", "Foreman’s Saw").collect()}
    assert (one[1]["state"], one[1]["normalized_phrase"], one[2]["phrase"]) == ("approved", "foreman's saw", "X")
    m = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 10)], "entry_id bigint, sitemap_id bigint")
    left = [df.count() for df in mutations.destroy_entry(e, t, m, 3)]
    assert left == [2, 1, 3]
    with pytest.raises(ValueError):
        mutations.destroy_entry(e, t, m, 1)
    s = spark.createDataFrame([(10, "enabled"), (11, "enabled")], "id bigint, status string")
    s2, m2, e2 = mutations.set_sitemap_status(s, m, e, 10, "ignored")
    assert {r["id"] for r in e2.where("removed_from_source").collect()} == {1, 3} and m2.count() == 1 and s2.where("status = 'ignored'").count() == 1
    assert mutations.set_sitemap_status(s, m, e, 10, "enabled")[1].count() == 4
