"""What changed between consecutive full snapshots: a Merkle tree over hash ranges.

One pass reduces each snapshot to one row per page and writes it with a 64-bit key
hash and a row hash. A second, narrow pass reads only those two hashes and folds
them into leaf digests, one per snapshot and hash range. Digests of inner nodes are
hashes over their children's digests. The trees of two consecutive snapshots are
compared from the root; only children of differing nodes are looked at, and only
rows in differing leaves are read with url and title and compared.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorloom.functions.urls import page_url, squeeze
from anchorloom.runtime import Workspace

#: Rows a leaf should hold on average. Small leaves keep the share of rows that are
#: compared close to the share that changed; their digests stay 1/ROWS_PER_LEAF of the rows.
ROWS_PER_LEAF = 16
#: Bits by which the tree widens from level to level.
FAN_BITS = 4


def complete_runs(runs: DataFrame) -> DataFrame:
    """Runs with success, not partial and finished, each with the next by ``started_at``
    (ties by id): columns run_id, started_at, next_run_id. A run delivered twice counts once."""
    good = runs.where(F.col("success") & ~F.col("partial") & F.col("finished_at").isNotNull() & F.col("started_at").isNotNull() & F.col("id").isNotNull())
    one = good.groupBy(F.col("id").alias("run_id")).agg(F.max("started_at").alias("started_at"))
    # One row per sync run, so one ordered partition is small at any number of pages.
    order = Window.partitionBy(F.lit(0)).orderBy("started_at", "run_id")
    return one.withColumn("next_run_id", F.lead("run_id").over(order))


def page_states(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """One row (run_id, url, title) per page that a complete run saw.

    A row counts if its last_seen_at is not null and not before the run's start; the
    title is that of the latest such row, ties going to the later delivery and then the
    greater title. Rows with a null or blank url name no page and are left out; a null
    title stays null. The aggregate combines on the map side, so many rows of one page,
    or of one sitemap, do not gather in one task.
    """
    seen = (
        snapshots.select("run_id", "url", "title", "last_seen_at", "delivered_at")
        .join(runs.select("run_id", "started_at"), "run_id")
        .where(F.col("last_seen_at") >= F.col("started_at"))
        .select("run_id", page_url("url").alias("url"), F.struct("last_seen_at", "delivered_at", squeeze("title").alias("title")).alias("state"))
        .where(F.col("url") != "")
    )
    return seen.groupBy("run_id", "url").agg(F.max("state").alias("state")).select("run_id", "url", F.col("state.title").alias("title"))


def _leaf(key_hash: str, bits: int):
    return F.shiftrightunsigned(F.col(key_hash), 64 - bits) if bits else F.lit(0).cast("long")


def _sides(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Each row of a run once as the new side of its own pair and once as the old side
    of the next run's. ``pair`` is the later run. The first run is no pair's new side."""
    pairs = runs.withColumn("first", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("started_at", "run_id")) == 1)
    sides = pairs.select(
        "run_id",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.when(~F.col("first"), F.col("run_id")).alias("pair"), F.lit(1).alias("side")),
                    F.struct(F.col("next_run_id").alias("pair"), F.lit(0).alias("side")),
                ),
                lambda s: s["pair"].isNotNull(),
            )
        ).alias("s"),
    ).select("run_id", "s.pair", "s.side")
    return df.join(sides, "run_id").drop("run_id")


def merkle_levels(leaves: DataFrame, bits: int) -> list[tuple[int, DataFrame]]:
    """(bits of the level, digests (run_id, node, digest, n)), root first.

    ``leaves`` are the digests at ``bits``. An inner digest hashes node ids and digests
    of its children; XOR makes it independent of their order.
    """
    levels = [(bits, leaves)]
    while bits > 0:
        step = min(FAN_BITS, bits)
        below, bits = levels[0][1], bits - step
        up = below.groupBy("run_id", F.shiftrightunsigned("node", step).alias("node")).agg(
            F.bit_xor(F.xxhash64("node", "digest", "n")).alias("digest"), F.sum("n").alias("n")
        )
        levels.insert(0, (bits, up))
    return levels


def differing_leaves(leaves: DataFrame, runs: DataFrame, bits: int) -> DataFrame:
    """(pair, node) of the leaves whose digests differ, found from the root down."""
    frontier, above = None, 0
    for level_bits, digests in merkle_levels(leaves, bits):
        nodes = _sides(digests, runs)
        if frontier is not None:
            step = level_bits - above
            parents = frontier.withColumnRenamed("node", "parent")
            nodes = nodes.withColumn("parent", F.shiftrightunsigned("node", step)).join(parents, ["pair", "parent"], "left_semi")
        both = nodes.groupBy("pair", "node").agg(
            *[F.max(F.when(F.col("side") == s, F.struct("digest", "n"))).alias(f"d{s}") for s in (0, 1)]
        )
        frontier, above = both.where(~F.col("d0").eqNullSafe(F.col("d1"))).select("pair", "node"), level_bits
    return frontier


def snapshot_changes(spark: SparkSession, snapshots: DataFrame, sync_runs: DataFrame, rows_per_leaf: int = ROWS_PER_LEAF) -> DataFrame:
    """(run_id, url, change_type) between consecutive complete runs.

    change_type is added, removed or changed (title differs, letter case included; null
    and a text differ). run_id is the later run; the first complete run gives no rows.
    A complete run whose dump is empty removes every page. Empty tables give no rows.
    """
    work = Workspace(spark, "snapshots")
    runs = work.write(complete_runs(sync_runs), "runs")
    states = page_states(snapshots, runs).withColumns(
        {"key_hash": F.xxhash64("url"), "row_hash": F.xxhash64(F.lit(7), "title", "url")}
    )
    states = work.write(states, "states")
    # The number of rows is in the files' footers.
    rows = states.count()
    n_runs = max(1, runs.count())
    bits = min(40, max(0, math.ceil(math.log2(max(1, rows / n_runs / rows_per_leaf)))))
    leaves = states.groupBy("run_id", _leaf("key_hash", bits).alias("node")).agg(
        F.bit_xor("row_hash").alias("digest"), F.count(F.lit(1)).alias("n")
    )
    leaves = work.write(leaves, "leaves")
    differing = work.write(differing_leaves(leaves, runs, bits), "differing")
    work.drop(leaves)
    rows_in = _sides(states.select("run_id", "url", "title", _leaf("key_hash", bits).alias("node")), runs).join(
        differing, ["pair", "node"], "left_semi"
    )
    # A page is present on a side if it has a row there; its title may be null.
    both = rows_in.groupBy("pair", "url").agg(
        *[F.max(F.when(F.col("side") == s, F.struct(F.lit(True).alias("here"), "title"))).alias(f"s{s}") for s in (0, 1)]
    )
    kind = (
        F.when(F.col("s0").isNull(), F.lit("added"))
        .when(F.col("s1").isNull(), F.lit("removed"))
        .when(~F.col("s0.title").eqNullSafe(F.col("s1.title")), F.lit("changed"))
    )
    return both.select(F.col("pair").alias("run_id"), "url", kind.alias("change_type")).where(F.col("change_type").isNotNull())
