"""Snapshots, hierarchies and references on small tables with every awkward case."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anchorloom.operators.current import current_rows
from anchorloom.operators.hierarchy import descendants, hierarchy, url_links
from anchorloom.operators.orphans import orphan_references, orphan_report
from anchorloom.operators.skew import hot_keys, lookup
from anchorloom.operators.snapshots import snapshot_changes

T = datetime(2025, 1, 1)
SNAP = "run_id bigint, entry_id bigint, sitemap_id bigint, url string, title string, last_seen_at timestamp_ntz, delivered_at timestamp_ntz, extra string"
RUNS = "id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, success boolean, partial boolean, url string"


def runs(spark, *rows):
    return spark.createDataFrame([(i, T + timedelta(days=d), T if done else None, ok, part, "x") for i, d, done, ok, part in rows], RUNS)


def snap(spark, rows):
    return spark.createDataFrame([(r, 1, None, u, t, None if s is None else T + timedelta(days=s), T + timedelta(days=60 + k), "e") for k, (r, u, t, s) in enumerate(rows)], SNAP)


def found(df):
    return sorted(tuple(r) for r in df.select("run_id", "url", "change_type").collect())


def test_snapshot_cases(spark):
    # Run 9 is the first by time; 2 and 4 are not complete; a run may be delivered twice.
    rs = runs(spark, (9, 0, True, True, False), (9, 0, True, True, False), (2, 1, True, True, True), (3, 2, True, True, False), (4, 3, False, True, False), (1, 4, True, True, False))
    rows = [
        (9, "http://a/x/", "Old  title ", 0), (3, " http://a/x", "Old title", 2), (1, "http://a/x//\n", "old title", 4),
        (9, "http://a/gone", "G", 0), (2, "http://a/gone", "G", 1), (1, "http://a/gone", "G", 4),
        (3, "http://a/late", "N", 1), (1, "http://a/late", "N", None),  # not seen by its run
        (9, "http://a/null", None, 0), (3, "http://a/null", "now", 2), (1, "http://a/null", "now", 4),
        (3, "http://a/two", "first", 2), (3, "http://a/two", "second", 3), (1, "http://a/two", "second", 5),
        (9, None, "t", 0), (9, " / ", "t", 0), (7, "http://a/unknown", "t", 0),
    ]
    want = [(1, "http://a/gone", "added"), (1, "http://a/x", "changed"), (3, "http://a/gone", "removed"), (3, "http://a/null", "changed"), (3, "http://a/two", "added")]
    for per_leaf in (1, 4, 1000):
        assert found(snapshot_changes(spark, snap(spark, rows), rs, per_leaf)) == want


def test_snapshot_empty(spark):
    rs = runs(spark, (1, 0, True, True, False), (2, 1, True, True, False))
    assert found(snapshot_changes(spark, snap(spark, []), rs)) == []
    assert found(snapshot_changes(spark, snap(spark, [(1, "u", "t", 0)]), rs)) == [(2, "u", "removed")]
    assert found(snapshot_changes(spark, snap(spark, [(1, "u", "t", 0)]), runs(spark))) == []


def test_snapshot_random(spark):
    rnd = random.Random(5)
    rs = runs(spark, *[(i, i, True, True, False) for i in range(4)])
    rows, state = [], {f"u{k}": "t" for k in range(300)}
    dumps = []
    for r in range(4):
        for u in list(state):
            x = rnd.random()
            if x < 0.02:
                del state[u]
            elif x < 0.05:
                state[u] = f"t{r}{rnd.random()}"
        state |= {f"n{r}{k}": "t" for k in range(5)}
        dumps.append(dict(state))
        # A third of all rows belong to one page.
        rows += [(r, u, t, r) for u, t in state.items()] + [(r, "u0", state.get("u0", "z"), r)] * 150
        if "u0" not in state:
            state["u0"] = dumps[-1]["u0"] = "z"
    want = []
    for r in range(1, 4):
        a, b = dumps[r - 1], dumps[r]
        want += [(r, u, "added") for u in b.keys() - a.keys()] + [(r, u, "removed") for u in a.keys() - b.keys()] + [(r, u, "changed") for u in a.keys() & b.keys() if a[u] != b[u]]
    assert found(snapshot_changes(spark, snap(spark, rows), rs, 4)) == sorted(want)


def brute_tree(parent):
    out = {}
    for n in parent:
        path, seen, x = [], set(), n
        while x is not None and x in parent and x not in seen:
            seen.add(x)
            path.append(x)
            x = parent[x]
        if x is not None and x in seen:
            loop = path[path.index(x) :]
            out[n] = (min(loop), -1, n in loop)
        else:
            out[n] = (path[-1], len(path) - 1, False)
    return out


@pytest.mark.parametrize("per_task", [1, 3, 200_000])
def test_hierarchy_random(spark, per_task):
    rnd = random.Random(per_task)
    parent = {i: (None if i < 3 else rnd.choice([0, rnd.randrange(i), rnd.randrange(60), 999])) for i in range(60)}
    parent |= {100: 100, 101: 102, 102: 101, 103: 102} | {200 + i: 199 + i for i in range(1, 15)} | {200: None}
    df = spark.createDataFrame(list(parent.items()), "id bigint, parent bigint").withColumn("parent", F.when(F.col("parent") != 999, F.col("parent")))
    parent = {k: None if v == 999 else v for k, v in parent.items()}
    tree = hierarchy(spark, df, hot_rows=per_task)
    got = {r["id"]: (r["root_id"], r["depth"], r["in_cycle"]) for r in tree.collect()}
    assert got == brute_tree(parent)
    pairs = {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in descendants(tree).collect()}
    assert (200, 214, 14) in pairs and (213, 214, 1) in pairs
    assert len(pairs) == sum(max(0, d) for _, d, _ in got.values())


def test_hierarchy_deep_chain(spark):
    """2,000 levels in rounds of doubling, beside a loop, without paths."""
    links = [(k, k - 1 if k else None) for k in range(2000)] + [(5000 + k, 5000 + (k + 1) % 3) for k in range(3)] + [(5010, 5001)]
    df = spark.createDataFrame(links, "id bigint, parent bigint")
    got = {r["id"]: (r["root_id"], r["depth"], r["in_cycle"]) for r in hierarchy(spark, df, paths=False).collect()}
    assert all(got[k] == (0, k, False) for k in range(2000))
    assert got[5010] == (5000, -1, False) and got[5002] == (5000, -1, True)


def test_hierarchy_empty_and_roots(spark):
    assert hierarchy(spark, spark.createDataFrame([], "id bigint, parent bigint")).count() == 0
    assert [tuple(r) for r in hierarchy(spark, spark.createDataFrame([(5, None)], "id bigint, parent bigint")).select("root_id", "depth", "path").collect()] == [(5, 0, [5])]
    assert [tuple(r) for r in hierarchy(spark, spark.createDataFrame([(5, 5)], "id bigint, parent bigint")).select("root_id", "depth", "path", "in_cycle").collect()] == [(5, -1, None, True)]


def test_url_links(spark):
    rows = [
        (1, "HTTP://A.example/Root.xml/", None, 1), (2, " http://a.example/Root.xml ", "x", 0), (2, "http://b/2", "http://A.EXAMPLE/Root.xml//", 5), (3, "http://b/3", "http://a.example/root.xml", 1),
        (4, "http://b/4", "  ", 1), (5, "http://b/2/", "http://b/2", 1), (6, None, "http://b/2", 1), (None, "http://b/7", None, 1), (6, None, "http://b/2", 1),
    ]
    df = spark.createDataFrame([(i, u, p, T + timedelta(days=d)) for i, u, p, d in rows], "id bigint, url string, parent_url string, updated_at timestamp_ntz")
    got = {r["id"]: r["parent"] for r in url_links(df).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: 2, 6: 2}  # ids 2 and 5 share a url: the smaller one is the parent


def test_orphans(spark):
    m = spark.createDataFrame(
        [(1, 10, 20, T, T), (1, 99, 20, T, T - timedelta(days=1)), (2, 0, -5, T, T), (3, None, 21, T, T), (4, 11, None, None, T), (5, 12, 22, T, T), (5, 12, 22, T, T), (None, 1, 1, T, T)],
        "id bigint, entry_id bigint, sitemap_id bigint, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    e = spark.createDataFrame([(10, T, T), (11, T + timedelta(days=9), T), (12, T + timedelta(days=1), T), (21, T, T)], "id bigint, created_at timestamp_ntz, updated_at timestamp_ntz")
    s = spark.createDataFrame([(20, T, T)], "id bigint, created_at timestamp_ntz, updated_at timestamp_ntz")
    d = spark.createDataFrame([("sitemap_autolink_sitemaps", 22), ("sitemap_autolink_sitemaps", 22), ("sitemap_autolink_entries", 21), (None, 5)], "table_name string, record_id bigint")
    parents = {"sitemap_autolink_entries": e, "sitemap_autolink_sitemaps": s}
    got = sorted(tuple(r) for r in orphan_references(m, parents, d).collect())
    assert got == [
        (2, "entry_id", "missing", "2025-01"), (2, "sitemap_id", "missing", "2025-01"), (3, "sitemap_id", "missing", "2025-01"),
        (5, "entry_id", "late", "2025-01"), (5, "sitemap_id", "deleted", "2025-01"),
    ]
    report = {tuple(r) for r in orphan_report(orphan_references(m, parents, d)).collect()}
    assert ("sitemap_autolink_sitemaps", "sitemap_id", "missing", "2025-01", 2) in report
    empty = {k: v.limit(0) for k, v in parents.items()}
    assert orphan_references(m, empty, d.limit(0)).count() == 8
    assert orphan_references(m.limit(0), parents, d).count() == 0


def test_current_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (1, "z", None), (2, None, None), (None, "x", 9)], "id int, v string, updated_at int")
    assert sorted(tuple(r) for r in current_rows(df).select("id", "v").collect()) == [(1, "b"), (2, None)]


def test_lookup_with_hot_key(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k")).withColumn("k", F.when(F.col("id") == 5, None).otherwise(F.col("k")))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert len(hot_keys(big, ["k"], 100)) == 1
    for how in ("inner", "left"):
        a = sorted((r["id"], r["v"] or -1) for r in lookup(big, small, ["k"], how, "id", hot_rows=100).collect())
        b = sorted((r["id"], r["v"] or -1) for r in big.join(small, ["k"], how).collect())
        assert a == b
