"""Parent-child links to full hierarchies: paths, depths, roots, descendants, loops."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.urls import resource_key
from anchorloom.operators.current import current_rows
from anchorloom.operators.skew import HOT_ROWS, lookup
from anchorloom.runtime import Workspace

def url_links(rows: DataFrame, id_col: str = "id", url: str = "url", parent_url: str = "parent_url", updated_at: str = "updated_at") -> DataFrame:
    """(id, parent): the current row of each id and the id of its parent, null for a root.

    Urls match if they differ only in surrounding white space, trailing slashes or the
    letter case of scheme and host. A null or blank parent url, and one that no current
    row has, make a root. If several ids share a url, children go to the smallest id.
    """
    now = current_rows(rows, id_col, updated_at, [url, parent_url]).select(F.col(id_col).alias("id"), resource_key(url).alias("own"), resource_key(parent_url).alias("key"))
    owners = now.where(F.col("own").isNotNull()).groupBy(F.col("own").alias("key")).agg(F.min("id").alias("parent"))
    return lookup(now.select("id", "key"), owners, ["key"], "left", spread="id").select("id", "parent")


def _ids(base: DataFrame) -> str:
    return f"array<{dict(base.dtypes)['id']}>"


def hierarchy(spark: SparkSession, links: DataFrame, paths: bool = True, hot_rows: int = HOT_ROWS, work: Workspace | None = None) -> DataFrame:
    """One row (id, parent, root_id, depth, path, in_cycle) per node of (id, parent).

    ``parent`` null, or not among the ids, makes a root: depth 0, its own root. Every other
    node starts on its parent, and each round joins the frontier, the nodes whose ancestor
    is not yet a root, to the ancestor pairs known so far, so that it advances by 1, 2, 4 ...
    levels: as many rounds as the depth has binary digits. ``path`` is the array of ids
    from the root down to the node, null if ``paths`` is false. Depths have no gaps, so once
    a round brings no node to a root, the rest is on a loop or below one: depth -1,
    ``root_id`` the smallest id on that loop, ``path`` null, ``in_cycle`` true on the loop
    itself. Ids must be unique and not null. A parent with very many children, or a root
    of very many nodes, is spread over tasks by a salt. Empty input gives no rows.
    """
    work = work or Workspace(spark, "hierarchy")
    base = work.write(links.select("id", "parent"), "links")
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    nodes = lookup(base, known, ["parent"], "left", spread="id", hot_rows=hot_rows)
    # path holds the ids below the ancestor ``up``; a root is its own ancestor.
    root = F.col("known").isNull()
    none = F.lit(None).cast(_ids(base))
    state = nodes.select(
        "id", "parent", F.when(root, F.col("id")).otherwise(F.col("parent")).alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth"),
        (F.when(root, F.array().cast(_ids(base))).otherwise(F.array("id")) if paths else none).alias("path"), root.alias("done"),
    )
    state = work.write(state, "state")
    done, open_ = state.where("done"), state.where(~F.col("done"))
    left = open_.count()
    while left:
        # The ancestor's own way, from the last round.
        above = done.unionByName(open_).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"), F.col("done").alias("done2"))
        step = lookup(open_, above, ["up"], spread="id", hot_rows=hot_rows, rows=left).select(
            "id", "parent", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.concat("path2", "path") if paths else none).alias("path"), F.col("done2").alias("done")
        )
        step = work.write(step, "state")
        open_ = step.where(~F.col("done"))
        still = open_.count()
        if still == left:
            break
        done, left = done.unionByName(step.where("done")), still
    out = done.select("id", "parent", F.col("up").alias("root_id"), "depth", (F.concat(F.array("up"), "path") if paths else none).alias("path"), F.lit(False).alias("in_cycle"))
    if not left:
        return out
    loops = _loops(work, open_.select("id", "parent"), left, hot_rows)
    return out.unionByName(loops.select("id", "parent", "root_id", F.lit(-1).cast("long").alias("depth"), none.alias("path"), "in_cycle"))


def _loops(work: Workspace, loose: DataFrame, n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nodes on or below loops. After k rounds a node knows its ancestor 2^k steps up and
    the smallest id on the way; with 2^k >= n that ancestor is on the loop, and its own
    way covers the whole loop. An ancestor after 2^k steps is on a loop, and every node of
    a loop is such an ancestor of some node of it."""
    ways = loose.select("id", F.col("parent").alias("up"), F.col("id").alias("least"))
    for _ in range(max(1, math.ceil(math.log2(n))) if n > 1 else 0):
        above = ways.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        new = work.write(lookup(ways, above, ["up"], spread="id", hot_rows=hot_rows, rows=n).select("id", F.col("up2").alias("up"), F.least("least", "least2").alias("least")), "ways")
        work.drop(ways)
        ways = new
    own = ways.select(F.col("id").alias("up"), F.col("least").alias("root_id"))
    on_loop = ways.select(F.col("up").alias("id")).distinct().withColumn("on", F.lit(True))
    named = lookup(ways.select("id", "up"), own, ["up"], spread="id", hot_rows=hot_rows, rows=n)
    return loose.join(named.select("id", "root_id"), "id").join(on_loop, "id", "left").select("id", "parent", "root_id", F.coalesce("on", F.lit(False)).alias("in_cycle"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every node in a tree, from its path.

    The pairs are as many as the depths add up to. Loops have no descendants here.
    """
    p = tree.where(F.size("path") > 1)
    return p.select(F.col("id").alias("descendant_id"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "ancestor_id"), "depth").select(
        "ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance")
    )
