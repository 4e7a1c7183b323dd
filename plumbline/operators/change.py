"""What changed between two snapshots of a register, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygon
from ..functions.text import content_hash


def diff(live: DataFrame, staging: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """keys, kind: added, modified or removed. Only keys and a hash of what is compared meet in the join."""
    side = lambda df, tag: df.select(*keys, content_hash(*(F.col(c) for c in compared)).alias(tag))
    both = side(live, "_old").join(side(staging, "_new"), keys, "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified")
    return both.select(*keys, kind.alias("kind")).filter("kind IS NOT NULL")


def changed(a: DataFrame, b: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """The definition of modified, row by row and null-safe; slower than `diff`, which must agree."""
    pair = a.join(b.select(*keys, *(F.col(c).alias(f"_{c}") for c in compared)), keys)
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return pair.filter(~same).select(*keys)


def diff_tolerant(live: DataFrame, staging: DataFrame, keys: list[str], compared: list[str], metres: float, rings: str = "rings") -> DataFrame:
    """As `diff`, where geometry counts as changed from so many metres on: a grid digest finds candidates, which alone are
    joined again with their geometry."""
    side = lambda df, tag: df.select(*keys, content_hash(*(F.col(c) for c in compared)).alias(f"_a{tag}"), polygon.grid_digest(F.col(rings)).alias(f"_g{tag}"), F.lit(True).alias(f"_in{tag}"))
    both = side(live, "0").join(side(staging, "1"), keys, "full_outer")
    sure = F.when(F.col("_in0").isNull(), "added").when(F.col("_in1").isNull(), "removed").when(F.col("_a0") != F.col("_a1"), "modified").when(~F.col("_g0").eqNullSafe(F.col("_g1")), "check")
    kinds = both.select(*keys, sure.alias("kind")).filter("kind IS NOT NULL")
    shapes = kinds.filter("kind = 'check'").select(*keys).join(live.select(*keys, F.col(rings).alias("_a")), keys).join(staging.select(*keys, F.col(rings).alias("_b")), keys)
    return kinds.filter("kind <> 'check'").unionByName(shapes.filter(polygon.moved(F.col("_a"), F.col("_b"), metres)).select(*keys, F.lit("modified").alias("kind")))


def changed_cells(live: DataFrame, staging: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """cell_x, cell_y, added, modified, removed: new places of added and modified rows, old places of removed and modified ones."""
    cell = ["cell_x", "cell_y"]
    new = staging.select(*keys, *cell).join(changes.filter("kind <> 'removed'"), keys)
    old = live.select(*keys, *cell).join(changes.filter("kind <> 'added'"), keys)
    each = new.unionByName(old).select(*keys, *cell, "kind").distinct()
    return each.groupBy(*cell).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "removed")))


def apply_delta(live: DataFrame, staging: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    out = live.join(changes.filter("kind <> 'added'").select(*keys), keys, "left_anti")
    return out.unionByName(staging.join(changes.filter("kind <> 'removed'").select(*keys), keys, "left_semi").select(*live.columns))


def shift_histogram(live: DataFrame, staging: DataFrame, keys: list[str], bands: list[float], rings: str = "rings") -> DataFrame:
    """band, n: rows of both snapshots by their largest vertex shift in metres ("structure" where it differs)."""
    both = live.select(*keys, F.col(rings).alias("_a")).join(staging.select(*keys, F.col(rings).alias("_b")), keys)
    shift = polygon.largest_shift(F.col("_a"), F.col("_b"))
    band = F.when(shift.isNull(), "structure")
    for top in bands:
        band = band.when(shift < top, f"< {top}")
    return both.select(band.otherwise(f">= {bands[-1]}").alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, whole; combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def last_id(existing: DataFrame | None, column: str) -> int:
    return (existing.agg(F.max(column)).first()[0] or 0) if existing is not None else 0


def numbered(new: DataFrame, column: str, order: list[str], after: int) -> DataFrame:
    """new with ids that follow `after`, in an order: rows are numbered within range partitions, whose bases are the sizes of those before."""
    from ..sources.scratch import written

    ranged = written(new.drop(column).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    bases = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row a partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(bases), "_p").withColumn(column, (F.col("_base") + within + after).cast("long")).drop("_p", "_base")


def next_ids(existing: DataFrame, new: DataFrame, column: str, order: list[str]) -> DataFrame:
    """new with ids that follow the largest of existing."""
    return numbered(new, column, order, last_id(existing, column))


def history_row(changes: DataFrame, live_rows: int, etag: str | None, at: Column) -> DataFrame:
    """added, modified, removed, warned, etag, applied_at of a refresh."""
    one = changes.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "removed")))
    return one.withColumn("warned", (F.col("added") + F.col("modified") + F.col("removed")) > F.lit(live_rows) * 0.5).withColumn("etag", F.lit(etag)).withColumn("applied_at", at)


def refresh(live: DataFrame, staging: DataFrame, keys: list[str], compared: list[str], reports: DataFrame | None = None, source: str = "", signed: DataFrame | None = None, etag: str | None = None, at: Column | None = None) -> dict[str, DataFrame]:
    """Guards, then everything that a refresh writes: changes, cells, table, the history row (with `at`) and, with the new table's
    `signed` keys (record_key, signature), the reports of the source, expired where their record changed. Raises `Refused` and leaves live as it is."""
    from .quality import check_schema, refuse_empty

    refuse_empty(staging)
    check_schema(live, staging)
    found = diff(live, staging, keys, compared)
    out = {"changes": found, "table": apply_delta(live, staging, found, keys)}
    if "cell_x" in live.columns:
        out["cells"] = changed_cells(live, staging, found, keys)
    if at is not None:
        out["history"] = history_row(found, live.count(), etag, at)
    if reports is not None and signed is not None:
        from .reports import reconcile

        out["reports"] = reconcile(reports, signed, source)
    return out


def expire(df: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """Retention: rows from cutoff on."""
    return df.filter(F.col(column) >= cutoff)
