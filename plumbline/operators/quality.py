"""Checks and repairs at load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metric, polygon, tilemath


class Refused(ValueError):
    """A load that must not replace what is there."""


def require_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def count_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(F.count_if(_any_null(keys)).alias("null_keys"))


def _any_null(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def drop_missing_coordinates(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def drop_invalid_geometry(df: DataFrame, rings: str = "rings") -> DataFrame:
    return df.filter(F.col(rings).isNull() | polygon.is_valid(F.col(rings)))


def drop_oversized(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Without shapes that span a whole cell or more on an axis; null geometry stays."""
    b = polygon.bbox(F.col(rings))
    wide = tilemath.x_frac(b.x1) - tilemath.x_frac(b.x0) >= 1
    high = tilemath.y_frac(b.y0) - tilemath.y_frac(b.y1) >= 1
    return df.filter(F.coalesce(~(wide | high), F.lit(True)))


def drop_undersized(df: DataFrame, rings: str = "rings", least: float = 1.0) -> DataFrame:
    """Without shapes below so many square metres; null geometry stays."""
    b = polygon.bbox(F.col(rings))
    m2 = metric.area_m2(polygon.area(F.col(rings)), (b.y0 + b.y1) / 2)
    return df.filter(F.col(rings).isNull() | F.coalesce(m2 >= least, F.lit(False)))


def only_standing(df: DataFrame, state: str = "state") -> DataFrame:
    return df.filter(F.col(state) == "eksploatowany")


def dedupe_by_key(df: DataFrame, keys: list[str], version: str, tiebreak: Column) -> DataFrame:
    """One row a key: the latest version, nulls last, ties by tiebreak. One exchange, before which each task keeps only its own
    candidates of a key; rows with a null in the key all stay, each as a group of its own."""
    alone = F.when(_any_null(keys), F.monotonically_increasing_id())
    first = F.row_number().over(Window.partitionBy(*keys, "_alone").orderBy(F.col(version).desc_nulls_last(), tiebreak))
    return df.withColumn("_alone", alone).withColumn("_r", first).filter("_r = 1").drop("_alone", "_r")


def drop_reasons(df: DataFrame, reasons: list[tuple[str, Column]], key: Column, examples: int = 20) -> DataFrame:
    """reason, n, examples (smallest keys) of rows that the first true condition drops; reasons are disjoint by order."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        reason = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(reason)
    marked = df.select(reason.alias("reason"), key.cast("string").alias("key")).filter("reason IS NOT NULL")
    few = marked.filter("key IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy("key"))).filter(F.col("_r") <= examples).groupBy("reason").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return marked.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


REASONS = ["no key", "no coordinates", "invalid geometry", "oversized", "undersized", "duplicate key"]


def load_checked(df: DataFrame, keys: list[str], version: str, tiebreak: Column, rings: str | None = None, lon: str | None = None, lat: str | None = None, examples: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows to load, and reason, n, examples, told of those left out, by the first of REASONS that holds: a null in the key; no place (lon,
    lat); a polygon that is invalid, spans a cell or more, or is below a square metre; a row of a key that is not its latest. Without rings (or
    lon, lat) the rules on them are not asked. The rules are asked once; null polygons stay."""
    key = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys))
    no = F.lit(False)
    place = F.col(lon).isNull() | F.col(lat).isNull() if lon and lat else no
    invalid = wide = tiny = no
    if rings:
        b, shape = polygon.bbox(F.col(rings)), F.col(rings).isNotNull()
        invalid = shape & ~polygon.is_valid(F.col(rings))
        wide = shape & ((tilemath.x_frac(b.x1) - tilemath.x_frac(b.x0) >= 1) | (tilemath.y_frac(b.y0) - tilemath.y_frac(b.y1) >= 1))
        tiny = shape & ~F.coalesce(metric.area_m2(polygon.area(F.col(rings)), (b.y0 + b.y1) / 2) >= 1.0, no)
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(zip(REASONS, (_any_null(keys), place, invalid, wide, tiny), strict=False))):
        reason = F.when(F.coalesce(rule, no), name).otherwise(reason)
    marked = df.withColumn("_reason", reason)
    later = F.row_number().over(Window.partitionBy(*keys, "_ok").orderBy(F.col(version).desc_nulls_last(), tiebreak)) > 1
    marked = marked.withColumn("_ok", F.when(F.col("_reason").isNotNull(), F.monotonically_increasing_id())).withColumn("_reason", F.coalesce("_reason", F.when(later, REASONS[5]))).drop("_ok")
    dropped = marked.filter("_reason IS NOT NULL").select(F.col("_reason").alias("reason"), key.alias("key"))
    few = dropped.withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy("key"))).filter(F.col("_r") <= examples).groupBy("reason").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    counts = dropped.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason")
    more = F.when(F.col("n") > F.size("examples"), F.concat(F.lit(", +"), (F.col("n") - F.size("examples")).cast("string"), F.lit(" more"))).otherwise("")
    told = F.concat(F.lit("skipped "), F.col("n").cast("string"), F.lit(" rows, "), F.col("reason"), F.lit(" (ids: "), F.array_join("examples", ", "), more, F.lit(")"))
    return marked.filter("_reason IS NULL").drop("_reason"), counts.withColumn("told", told)


def check_schema(live: DataFrame, staging: DataFrame) -> None:
    if live.dtypes != staging.dtypes:
        raise Refused(f"staged columns {staging.dtypes} differ from live {live.dtypes}")


def refuse_empty(staging: DataFrame) -> None:
    if staging.isEmpty():
        raise Refused("the staged table is empty")


def churn(changes: int, live: int, most: float = 0.5) -> bool:
    """Whether so many changes deserve a warning."""
    return live > 0 and changes > most * live


def check_axis_order(df: DataFrame, lon: str = "lon", lat: str = "lat", most: float = 0.001) -> DataFrame:
    """n, outside, outside_exchanged, ok: points outside the country's box, as they are and with axes exchanged."""
    box = lambda x, y: F.col(x).between(14.0, 24.2) & F.col(y).between(49.0, 54.9)
    one = drop_missing_coordinates(df, lon, lat).agg(F.count("*").alias("n"), F.count_if(~box(lon, lat)).alias("outside"), F.count_if(~box(lat, lon)).alias("outside_exchanged"))
    return one.withColumn("ok", F.col("outside") <= F.col("n") * most)


def grid_extent(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """x0, y0, x1, y1, ok: extent, and whether it is finite and within the globe."""
    one = df.agg(F.min(lon).alias("x0"), F.min(lat).alias("y0"), F.max(lon).alias("x1"), F.max(lat).alias("y1"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < 1e9)
    return one.withColumn("ok", F.coalesce(finite(F.col("x0")) & finite(F.col("x1")) & (F.col("x0") >= -180) & (F.col("x1") <= 180) & (F.col("y0") >= -90) & (F.col("y1") <= 90), F.lit(False)))


def mapping_violations(mappings: DataFrame) -> DataFrame:
    """rule, n for street mappings: empty names, doubled (name, settlement), untrimmed names (counted, not refused)."""
    name, to = F.col("prg_street_name"), F.col("osm_street_name")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    empty = mappings.agg(F.count_if(blank(name) | blank(to)).alias("n")).select(F.lit("empty").alias("rule"), "n")
    twice = mappings.groupBy(F.lower(name), "teryt_simc_code").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("rule"), "n")
    loose = mappings.agg(F.count_if((name != F.trim(name)) | (to != F.trim(to))).alias("n")).select(F.lit("untrimmed").alias("rule"), "n")
    return empty.unionByName(twice).unionByName(loose)


def type_violations(types: DataFrame, adjacency: str, tiers: int = 2) -> DataFrame:
    """rule, n for building types (tier, key, min_levels, max_levels, max_neighbours, tags)."""
    from ..functions.text import parse_tags

    given = sum((F.col(c).isNotNull().cast("int") for c in ("min_levels", "max_levels", "max_neighbours")), F.lit(0))
    tags = parse_tags(F.col("tags"))
    rules = {
        "tier": ~F.col("tier").between(1, tiers), "key": F.coalesce(F.trim("key") == "", F.lit(True)), "tags": tags.isNull() | ~F.coalesce(F.map_contains_key(tags, "building"), F.lit(False)),
        "levels": F.col("min_levels") > F.col("max_levels"), "neighbours": (F.col("max_neighbours") < 0) | (F.col("max_neighbours").isNotNull() & (F.col("key") != adjacency)),
    }
    counts = types.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    ties = types.withColumn("_n", given).groupBy("tier", "key", "_n", "min_levels", "max_levels", "max_neighbours").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("tie").alias("rule"), "n")
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules)))).unionByName(ties)


def check_area_geometry(areas: DataFrame, rings: str = "rings") -> DataFrame:
    """areas with geometry_problem: null if valid, or if invalid but of positive area once repaired; else "unreadable" (no geometry) or
    "degenerate". Repair is `polygon.repaired`, so a crossing ring counts with its net area."""
    mended = polygon.area(polygon.repaired(F.col(rings))) > 0
    problem = F.when(F.col(rings).isNull(), "unreadable").when(~polygon.is_valid(F.col(rings)) & ~F.coalesce(mended, F.lit(False)), "degenerate")
    return areas.withColumn("geometry_problem", problem)


def parse_areas(areas: DataFrame, text: str = "text", most: float = 0.04) -> DataFrame:
    """areas with rings, x0, y0, x1, y1 and problem (null if usable) of a box "x0,y0,x1,y1" or a GeoJSON Polygon or Feature."""
    parts = F.split(text, ",")
    v = [F.get(parts, i).try_cast("double") for i in range(4)]
    boxed = F.when((F.size(parts) == 4) & ~F.contains(text, F.lit("{")), F.struct(*(c.alias(n) for c, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True))))
    shape = "struct<type:string,coordinates:array<array<array<double>>>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
    raw = F.from_json(text, shape)
    lines = F.coalesce(F.when(raw.type == "Polygon", raw.coordinates), F.when(raw.geometry.type == "Polygon", raw.geometry.coordinates))
    rings = F.transform(lines, lambda ring, i: F.struct((i > 0).alias("hole"), F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("pts")))
    own = areas.withColumn("_b", boxed).withColumn("rings", F.when(F.col("_b").isNotNull(), polygon.box(F.col("_b.x0"), F.col("_b.y0"), F.col("_b.x1"), F.col("_b.y1"))).otherwise(rings))
    b = polygon.bbox(F.col("rings"))
    own = own.select(*areas.columns, "rings", *(b.getField(n).alias(n) for n in ("x0", "y0", "x1", "y1")), "_b")
    wide = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    problem = (
        F.when(F.col("x0").isNull() | F.col("y1").isNull() | F.col("x1").isNull() | F.col("y0").isNull(), "unreadable")
        .when((F.col("x0") < -180) | (F.col("x1") > 180) | (F.col("y0") < -90) | (F.col("y1") > 90), "out of range")
        .when(F.col("_b").isNotNull() & ((F.col("_b.x0") >= F.col("_b.x1")) | (F.col("_b.y0") >= F.col("_b.y1"))), "degenerate")
        .when(polygon.area(F.col("rings")) <= 0, "degenerate")
        .when(wide > most, "too large")
    )
    return own.withColumn("problem", problem).drop("_b")
