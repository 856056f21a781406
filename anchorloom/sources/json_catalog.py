"""A catalog from JSON: {types: [..], entries: [[path, type index]..], aliases: {phrase: entry index}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.text import normalize_text

SCHEMA = "types array<string>, entries array<array<string>>, aliases map<string,int>"


def rules_from_json(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Rules (phrase, url, type, priority, entry_id, seq): priority is the type's index plus one."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    a = doc.select("types", "entries", F.explode("aliases").alias("alias", "i"))
    e = F.get("entries", F.col("i"))
    kind = F.get(e, F.lit(1)).cast("int")
    return a.select(
        normalize_text("alias").alias("phrase"), F.concat(F.lit(base), F.get(e, F.lit(0))).alias("url"), F.get("types", kind).alias("type"),
        (kind + 1).alias("priority"), F.col("i").cast("long").alias("entry_id"), F.xxhash64("alias").alias("seq"),
    )
