"""Lookup joins that survive a key holding a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: A key is hot when it holds more rows than this and more than 1/HOT_SHARE of the
#: table; hence there are never more than HOT_SHARE hot keys, whatever the data.
HOT_ROWS = 500_000
HOT_SHARE = 1_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, counted: DataFrame | None = None) -> list[tuple]:
    """At most ``HOT_SHARE`` rows ``(*key, salts)``.

    One pass, combined on the map side; ``counted`` (keys, n) saves it where the counts are
    known already. The total comes with the same job.
    """
    if counted is None:
        counted = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    top = counted.select(*keys, "n").observe(seen, F.sum("n").alias("total")).orderBy(F.desc("n")).limit(HOT_SHARE).collect()
    floor = max(hot_rows, (seen.get["total"] or 0) // HOT_SHARE)
    return [(*[r[k] for k in keys], math.ceil(r["n"] / floor) + 1) for r in top if r["n"] > floor]


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", spread: str | None = None, hot_rows: int = HOT_ROWS, counted: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Join ``df`` to ``table``, whose ``keys`` are unique, on equally named ``keys``.

    Rows of a hot key are spread over several partitions by a salt (hash of
    ``spread``, or of all columns) and only the matching rows of ``table`` are
    repeated for it. Without hot keys this is the plain join, which Spark turns into
    a broadcast only if the measured size of ``table`` is below its threshold.
    ``how`` is ``inner`` or ``left``. Null keys match nothing. Nothing is dropped. ``rows``
    is the number of rows of ``df`` where it is known: so few cannot hold a hot key.
    """
    hot = [] if rows is not None and rows <= hot_rows else hot_keys(df, keys, hot_rows, counted)
    if not hot:
        return df.join(table, keys, how)
    spark = df.sparkSession
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", __salts int"
    salts = F.broadcast(spark.createDataFrame(hot, schema))  # at most HOT_SHARE rows
    source = F.col(spread) if spread else F.struct(*df.columns)
    left = df.join(salts, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(source), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    right = table.join(salts, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
