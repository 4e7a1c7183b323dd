"""Completeness figures, rankings, tiles and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tilemath


def ratio(n: Column, total: Column) -> Column:
    """Unmatched share, at most 1; -1 without a denominator."""
    return F.when(total > 0, F.least(n / total, F.lit(1.0))).otherwise(F.lit(-1.0))


def rank_areas(rows: DataFrame, unmatched: DataFrame, by: list[str], sort: str = "ratio", descending: bool = True, within: str | None = None, page: int = 1, per_page: int = 50, total_items: bool = False) -> DataFrame:
    """by, total, unmatched, ratio: areas of rows, one page. Areas that only unmatched rows have are left out. With total_items: the
    number of all areas beside each row; a page beyond the last has one row, with that number alone."""
    if not 1 <= per_page <= 200 or page < 1:
        raise ValueError("page from 1, per_page from 1 to 200")
    if within is not None:
        if len(within) not in (2, 4, 7):
            raise ValueError("a code prefix has 2, 4 or 7 digits")
        rows, unmatched = (df.filter(F.startswith(F.col(by[0]), F.lit(within))) for df in (rows, unmatched))
    out = rows.groupBy(*by).agg(F.count("*").alias("total")).join(unmatched.groupBy(*by).agg(F.count("*").alias("unmatched")), by, "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(0)))
    out = out.withColumn("ratio", ratio(F.col("unmatched"), F.col("total")))
    one = out.orderBy(F.desc(sort) if descending else F.asc(sort), *by).offset((page - 1) * per_page).limit(per_page)
    if not total_items:
        return one
    everything = rows.select(*by).distinct().agg(F.count("*").alias("total_items"))
    return everything.join(F.broadcast(one), F.lit(True), "left").select(*one.columns, "total_items")  # one row, and at most 200


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def bins(unmatched: DataFrame, totals: DataFrame, zoom: int) -> DataFrame:
    """bin_x, bin_y, unmatched, total, ratio at a coarser zoom. unmatched and totals: cell_x, cell_y and a row each (or n)."""
    shift = tilemath.CELL_ZOOM - zoom
    coarse = lambda df, u, t: df.select(F.shiftright("cell_x", shift).alias("bin_x"), F.shiftright("cell_y", shift).alias("bin_y"), u.cast("long").alias("u"), t.cast("long").alias("t"))
    both = coarse(unmatched, F.lit(1), F.lit(0)).unionByName(coarse(totals, F.lit(0), F.col("total")))
    out = both.groupBy("bin_x", "bin_y").agg(F.sum("u").alias("unmatched"), F.sum("t").alias("total"))
    return out.withColumn("ratio", ratio(F.col("unmatched"), F.col("total")))


def with_change_times(binned: DataFrame, changes: DataFrame, zoom: int, since: Column) -> DataFrame:
    """binned with changed_at: epoch seconds of the bin's latest change since then, 0 if none; changes make no bins."""
    shift = tilemath.CELL_ZOOM - zoom
    last = changes.filter(F.col("detected_at") >= since).groupBy(F.shiftright("cell_x", shift).alias("bin_x"), F.shiftright("cell_y", shift).alias("bin_y")).agg(F.unix_timestamp(F.max("detected_at")).alias("changed_at"))
    return binned.join(last, ["bin_x", "bin_y"], "left").withColumn("changed_at", F.coalesce("changed_at", F.lit(0).cast("long")))


def register_bins(registers: dict[str, tuple[DataFrame, DataFrame]], changes: DataFrame, zoom: int, since: Column) -> DataFrame:
    """bin_x, bin_y, the bin's corners, and for each source s unmatched_s, total_s, ratio_s and changed_s (epoch seconds of the latest change
    since then, 0 if none). registers: unmatched rows (cell_x, cell_y) and cell totals by source; changes: source, cell_x, cell_y, detected_at.
    Changes make no bins."""
    shift, place = tilemath.CELL_ZOOM - zoom, ["bin_x", "bin_y"]
    coarse = lambda df, *more: df.select(F.shiftright("cell_x", shift).alias("bin_x"), F.shiftright("cell_y", shift).alias("bin_y"), *more)
    rows = None
    for source, (unmatched, totals) in registers.items():
        one = coarse(unmatched, F.lit(source).alias("s"), F.lit(1).cast("long").alias("u"), F.lit(0).cast("long").alias("t")).unionByName(coarse(totals, F.lit(source).alias("s"), F.lit(0).cast("long").alias("u"), F.col("total").cast("long").alias("t")))
        rows = one if rows is None else rows.unionByName(one)
    of = lambda s, c: F.sum(F.when(F.col("s") == s, F.col(c)).otherwise(0))
    out = rows.groupBy(*place).agg(*(x for s in registers for x in (of(s, "u").alias(f"unmatched_{s}"), of(s, "t").alias(f"total_{s}"))))
    recent = coarse(changes.filter(F.col("detected_at") >= since), "source", "detected_at").groupBy(*place).agg(*(F.unix_timestamp(F.max(F.when(F.col("source") == s, F.col("detected_at")))).alias(f"changed_{s}") for s in registers))
    out = out.join(recent, place, "left")
    for s in registers:
        out = out.withColumn(f"ratio_{s}", ratio(F.col(f"unmatched_{s}"), F.col(f"total_{s}"))).withColumn(f"changed_{s}", F.coalesce(f"changed_{s}", F.lit(0).cast("long")))
    return tile_corners(out, zoom, "bin_x", "bin_y")


def map_summary(addresses: DataFrame, buildings: DataFrame, former: DataFrame, reports: DataFrame, top: int = 10) -> DataFrame:
    """section, value, detail, n: addresses and buildings of the map by object type, former buildings, the commonest building values, and
    reports by source and status."""
    none = F.lit(None).cast("string")
    by = lambda df, name: df.groupBy(F.col("osm_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "value", none.alias("detail"), "n")
    all_former = former.agg(F.count("*").alias("n")).select(F.lit("former").alias("section"), none.alias("value"), none.alias("detail"), "n")
    values = top_values(buildings, "building", top).select(F.lit("building value").alias("section"), "value", none.alias("detail"), "n")
    told = reports.groupBy("source", "status").agg(F.count("*").alias("n")).select(F.lit("reports").alias("section"), F.col("source").alias("value"), F.col("status").alias("detail"), "n")
    return by(addresses, "addresses").unionByName(by(buildings, "buildings")).unionByName(all_former).unionByName(values).unionByName(told)


def point_tiles(df: DataFrame, zoom: int, tiles: DataFrame | None = None, extent: int = 4096) -> DataFrame:
    """z, x, y, n, points (key, px, py in tile units, in stable order); tiles (x, y) without points are answered too if given."""
    fx, fy = tilemath.x_frac(F.col("lon"), zoom), tilemath.y_frac(F.col("lat"), zoom)
    unit = lambda f: F.floor((f - F.floor(f)) * extent).cast("int")
    each = df.select(F.floor(fx).cast("int").alias("x"), F.floor(fy).cast("int").alias("y"), F.struct(unit(fy).alias("py"), unit(fx).alias("px"), F.col("key")).alias("p"))
    out = each.groupBy("x", "y").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p")).alias("points"))
    if tiles is not None:
        out = tiles.select("x", "y").distinct().join(out, ["x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("points", F.coalesce("points", F.array().cast(out.schema["points"].dataType)))
    return out.withColumn("z", F.lit(zoom))


def tile_corners(df: DataFrame, zoom: int, x: str, y: str) -> DataFrame:
    return df.withColumn("_b", tilemath.tile_bbox(F.lit(zoom), F.col(x), F.col(y))).select("*", "_b.*").drop("_b")


def clipped(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rings cut to a box, one side after another; rings that leave it vanish."""

    def side(pts: Column, inside, meet) -> Column:
        n = F.greatest(F.size(pts) - 1, F.lit(0))
        cut = F.flatten(F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda p, q: F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(meet(p, q))).when(inside(q), F.array(meet(p, q), q)).otherwise(F.slice(F.array(p), 1, 0))))
        open_ring = F.filter(cut, lambda p, i: (i == 0) | (p != F.element_at(cut, F.greatest(i, F.lit(1)))))
        return F.when(F.size(open_ring) > 2, F.concat(open_ring, F.slice(open_ring, 1, 1))).otherwise(F.slice(open_ring, 1, 0))

    at = lambda p, q, t: F.struct((p.x + (q.x - p.x) * t).alias("x"), (p.y + (q.y - p.y) * t).alias("y"))
    out = rings
    for axis, low, bound in (("x", True, x0), ("x", False, x1), ("y", True, y0), ("y", False, y1)):
        inside = lambda p, a=axis, w=low, b=bound: (p[a] >= b) if w else (p[a] <= b)
        meet = lambda p, q, a=axis, b=bound: at(p, q, (b - p[a]) / (q[a] - p[a]))
        out = _each_ring(out, side, inside, meet)
    return F.filter(out, lambda r: F.size(r.pts) > 3)


def _each_ring(rings: Column, side, inside, meet) -> Column:
    return F.transform(rings, lambda r: F.struct(r.hole.alias("hole"), side(r.pts, lambda p: inside(p), lambda p, q: meet(p, q)).alias("pts")))


def tile_geometry(rings: Column, zoom: int, x: Column, y: Column, extent: int = 4096, buffer: int = 256) -> Column:
    """Rings in tile units, clipped to the tile and its buffer, rounded."""
    px = lambda p: (tilemath.x_frac(p.x, zoom) - x) * F.lit(float(extent))
    py = lambda p: (tilemath.y_frac(p.y, zoom) - y) * F.lit(float(extent))
    scaled = F.transform(rings, lambda r: F.struct(r.hole.alias("hole"), F.transform(r.pts, lambda p: F.struct(px(p).alias("x"), py(p).alias("y"))).alias("pts")))
    low, high = F.lit(float(-buffer)), F.lit(float(extent + buffer))
    cut = clipped(scaled, low, low, high, high)
    return F.transform(cut, lambda r: F.struct(r.hole.alias("hole"), F.transform(r.pts, lambda p: F.struct(F.round(p.x).cast("int").alias("x"), F.round(p.y).cast("int").alias("y"))).alias("pts")))


def tile_features(rows: DataFrame, zoom: int, layer: str) -> DataFrame:
    """z, x, y, layer, features (south and west edge, key, tags, rings) from rows (key, tags, rings, x0, y0, x1, y1), clipped, in stable order."""
    tiles = F.flatten(F.transform(F.sequence(tilemath.cell_x(F.col("x0"), zoom), tilemath.cell_x(F.col("x1"), zoom)), lambda x: F.transform(F.sequence(tilemath.cell_y(F.col("y1"), zoom), tilemath.cell_y(F.col("y0"), zoom)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    each = rows.withColumn("_t", F.explode(tiles)).withColumn("_g", tile_geometry(F.col("rings"), zoom, F.col("_t.x"), F.col("_t.y"))).filter(F.size("_g") > 0)
    feature = F.struct(F.col("y0").alias("south"), F.col("x0").alias("west"), "key", "tags", F.col("_g").alias("rings"))
    return each.groupBy(F.lit(zoom).alias("z"), F.col("_t.x").alias("x"), F.col("_t.y").alias("y"), F.lit(layer).alias("layer")).agg(F.sort_array(F.collect_list(feature)).alias("features"))


def covered_tiles(totals: DataFrame) -> DataFrame:
    return totals.select(F.explode(tilemath.tiles_for_cell(F.col("cell_x"), F.col("cell_y"))).alias("t")).select("t.*").distinct()


def queue_depth(queue: DataFrame) -> DataFrame:
    """source, cells, oldest of a queue (source, cell_x, cell_y, enqueued_at) in which cells repeat."""
    return queue.groupBy("source").agg(F.countDistinct("cell_x", "cell_y").alias("cells"), F.min("enqueued_at").alias("oldest"))


def oldest_cells(queue: DataFrame, n: int) -> DataFrame:
    """The n cells longest in the queue, in blocks of neighbours among equals."""
    each = queue.groupBy("source", "cell_x", "cell_y").agg(F.min("enqueued_at").alias("oldest"))
    return each.orderBy("oldest", F.shiftright("cell_x", 3), F.shiftright("cell_y", 3), "cell_x", "cell_y", "source").limit(n)


def summary(sources: dict[str, tuple[DataFrame, DataFrame]], refreshes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """source, comparable, unmatched, refreshed_at[, imported_at] (null if never). sources: comparable rows and unmatched rows of each; refreshes:
    source, finished_at; imports: source, value (a time as text; what is none is passed over)."""
    tagged = lambda df, name, kind: df.select(F.lit(name).alias("source"), F.lit(kind).alias("_kind"))
    rows = None
    for name, frames in sources.items():
        for kind, df in zip(("comparable", "unmatched"), frames, strict=True):
            each = tagged(df, name, kind)
            rows = each if rows is None else rows.unionByName(each)
    counted = rows.groupBy("source").agg(*(F.count_if(F.col("_kind") == k).alias(k) for k in ("comparable", "unmatched")))
    out = counted.join(refreshes.groupBy("source").agg(F.max("finished_at").alias("refreshed_at")), "source", "left")
    return out if imports is None else out.join(imports.groupBy("source").agg(F.max(F.col("value").try_cast("timestamp")).alias("imported_at")), "source", "left")


def freshness(queue: DataFrame, runs: DataFrame, stamps: DataFrame, now: Column) -> DataFrame:
    """source, cells, oldest, outcome, lag_seconds: queue depth, outcome of the last run (source, run_id, outcome) and age of the last
    stamp (source, stamped_at), for every source that any of them names."""
    last = runs.groupBy("source").agg(F.max_by("outcome", "run_id").alias("outcome"))
    age = stamps.groupBy("source").agg((F.unix_timestamp(now) - F.unix_timestamp(F.max("stamped_at"))).alias("lag_seconds"))
    both = queue_depth(queue).join(last, "source", "full_outer").join(age, "source", "full_outer")
    return both.withColumn("cells", F.coalesce("cells", F.lit(0).cast("long")))


def lag_seconds(now: Column, stamp: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(stamp.try_cast("timestamp"))
