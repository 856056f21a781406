"""References to records that do not exist, by field, cause and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.operators.current import current_rows
from anchorloom.operators.skew import lookup
from anchorloom.runtime import Workspace

#: Reference field of a membership -> table its values are ids of.
REFERENCES = {"entry_id": "sitemap_autolink_entries", "sitemap_id": "sitemap_autolink_sitemaps"}


def orphan_references(memberships: DataFrame, parents: dict[str, DataFrame], deletions: DataFrame, references: dict[str, str] = REFERENCES) -> DataFrame:
    """(membership_id, ref_field, orphan_cause, ref_month), one row per id and field.

    ``parents`` maps a table name to its rows (id, created_at, updated_at). The distinct
    non-null keys are reduced first, combined on the map side; the anti-join against
    the parents' keys and the test for parents created later run on those, so a key that
    a third of all rows refer to is one row there. Only the suspicious keys are joined
    back to the rows, spread by a salt where one of them is hot. A null is no reference;
    zero and negative ids are. ``late`` needs both creation times: where one is null the
    record counts as in time. A null creation time of the membership gives a null month.
    Empty tables are fine: with no parents every reference is an orphan.
    """
    fields = list(references)
    current = current_rows(memberships, columns=[*fields, "created_at"])
    refs = current.select(
        F.col("id").alias("membership_id"),
        F.col("created_at").alias("made_at"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).cast("long").alias("ref_id")) for f in fields])).alias("r"),
    ).select("membership_id", "made_at", "r.ref_field", "r.ref_id").where(F.col("ref_id").isNotNull())
    keys = refs.groupBy("ref_field", "ref_id").agg(F.min("made_at").alias("first_ref"), F.count(F.lit(1)).alias("n"))
    # One row per distinct reference; read by the anti-join, the test for late parents and
    # the search for hot keys.
    keys = Workspace(memberships.sparkSession, "references").write(keys, "keys")
    known, gone = None, None
    for field, table in references.items():
        k = current_rows(parents[table], columns=["created_at"]).select(F.lit(field).alias("ref_field"), F.col("id").alias("ref_id"), F.col("created_at").alias("parent_at"))
        g = deletions.where((F.col("table_name") == table) & F.col("record_id").isNotNull()).select(F.lit(field).alias("ref_field"), F.col("record_id").alias("ref_id"))
        known, gone = (k, g) if known is None else (known.unionByName(k), gone.unionByName(g))
    missing = (
        keys.join(known.select("ref_field", "ref_id"), ["ref_field", "ref_id"], "left_anti")
        .join(gone.distinct().withColumn("logged", F.lit(True)), ["ref_field", "ref_id"], "left")
        .select("ref_field", "ref_id", F.when(F.col("logged"), "deleted").otherwise("missing").alias("orphan_cause"), F.lit(None).cast("timestamp_ntz").alias("parent_at"))
    )
    late = (
        keys.join(known, ["ref_field", "ref_id"])
        .where(F.col("parent_at") > F.col("first_ref"))
        .select("ref_field", "ref_id", F.lit("late").alias("orphan_cause"), F.col("parent_at").cast("timestamp_ntz").alias("parent_at"))
    )
    suspects = missing.unionByName(late)
    hit = lookup(refs, suspects, ["ref_field", "ref_id"], spread="membership_id", counted=keys)
    return hit.where(F.col("parent_at").isNull() | (F.col("parent_at") > F.col("made_at").cast("timestamp_ntz"))).select(
        "membership_id", "ref_field", "orphan_cause", F.date_format("made_at", "yyyy-MM").alias("ref_month")
    )


def orphan_report(found: DataFrame, references: dict[str, str] = REFERENCES) -> DataFrame:
    """Counts per parent table, cause and month."""
    table = F.coalesce(*[F.when(F.col("ref_field") == f, t) for f, t in references.items()])
    return found.groupBy(table.alias("table_name"), "ref_field", "orphan_cause", "ref_month").agg(F.count(F.lit(1)).alias("n_refs"))
