"""Archives, labels, tenants, users and keys as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions.scalars import is_live, label_of


def list_archives(archives: DataFrame, labels: DataFrame, stats: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant's archives with label and statistics; archives without either are listed too."""
    own = archives.where(F.col("tenant_id") == tenant_id)
    set_label = labels.groupBy("archive_id").agg(F.max_by("label", "updated_at").alias("_own"))
    joined = own.join(set_label, "archive_id", "left").join(stats, "archive_id", "left")
    return joined.withColumn("name", label_of(F.col("_own"), F.col("label"), F.col("encrypted"), F.col("archive_id"))).drop("_own")


def upsert_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """labels (archive_id, label, updated_at) after changes of the same form: the last write of an archive wins, ties by label."""
    both = labels.select("archive_id", "label", "updated_at").unionByName(changes.select("archive_id", "label", "updated_at"))
    last = both.groupBy("archive_id").agg(F.max(F.struct("updated_at", "label")).alias("_l"))
    return last.select("archive_id", "_l.label", "_l.updated_at")


def issue(archives: DataFrame, new: DataFrame) -> DataFrame:
    """archives with the new, empty ones; an empty label, owner or note is none. An id that exists is not issued again."""
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in ("label", "owner", "notes")}
    return archives.unionByName(new.join(archives.select("archive_id"), "archive_id", "left_anti").withColumns(blank), allowMissingColumns=True)


def resolve_keys(keys: DataFrame, users: DataFrame, tenants: DataFrame, now: int) -> DataFrame:
    """Live API keys with their active user and tenant."""
    live = keys.where(is_live(F.col("revoked"), F.col("expires_at"), F.lit(now)))
    active = users.where("active").select(F.col("id").alias("user_id"), "email")
    named = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant"))
    return live.join(active, "user_id").join(named, "tenant_id").select("key_hash", "user_id", "email", "tenant_id", "tenant")


def by_creation(rows: DataFrame) -> DataFrame:
    return rows.orderBy("created_at", "id")
