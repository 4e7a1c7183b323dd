"""User reports: vetoes on register records. reports: report_id, source, record_key, status, created_at[, signature, cell_x, cell_y]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["active", "expired", "revoked"]


def resolve(targets: DataFrame, live: DataFrame) -> DataFrame:
    """targets (record_key, ...) with accepted and, from live (record_key, signature, cell_x, cell_y), what a report stores."""
    known = live.select("record_key", "signature", "cell_x", "cell_y", F.lit(True).alias("accepted"))
    good = F.trim("record_key") != ""
    return targets.join(known, "record_key", "left").withColumn("accepted", F.coalesce(F.col("accepted") & good, F.lit(False)))


def reconcile(reports: DataFrame, live: DataFrame, source: str) -> DataFrame:
    """reports of the source, active ones expired if their record is gone or has another signature."""
    now = live.select("record_key", F.col("signature").alias("_now"), F.lit(True).alias("_there"))
    out = reports.join(now, "record_key", "left")
    stale = (F.col("source") == source) & (F.col("status") == "active") & (F.col("_there").isNull() | ~F.col("signature").eqNullSafe(F.col("_now")))
    return out.withColumn("status", F.when(stale, "expired").otherwise(F.col("status"))).select(*reports.columns)


def revoke(reports: DataFrame, which: Column) -> DataFrame:
    """Active reports that `which` selects are revoked."""
    return reports.withColumn("status", F.when((F.col("status") == "active") & F.coalesce(which, F.lit(False)), "revoked").otherwise(F.col("status")))


def counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("source", "status").agg(F.count("*").alias("n"))


def listed(reports: DataFrame, status: str | None = None, source: str | None = None, limit: int | None = None) -> DataFrame:
    out = reports if status is None else reports.filter(F.col("status") == status)
    out = out if source is None else out.filter(F.col("source") == source)
    out = out.orderBy(F.desc("created_at"), F.desc("report_id"))
    return out if limit is None else out.limit(limit)


def export_lines(reports: DataFrame) -> DataFrame:
    return reports.select(F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("value"))


def import_lines(lines: DataFrame, schema: str, existing: DataFrame) -> DataFrame:
    """Reports from JSON lines under new ids."""
    from .change import next_ids

    read = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return next_ids(existing, read, "report_id", ["created_at", "record_key"]).select(*read.columns)
