"""Register classes and streets into map tags; exports, nearest buildings and mapping reloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metric, polygon, text, tilemath
from ..sources.scratch import large
from .matching import BOX, by_cell, meeting, resolve_streets


def symmetric_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.subtract(new).unionByName(new.subtract(old))


def reload_street_mappings(old: DataFrame, new: DataFrame, addresses: DataFrame) -> DataFrame:
    """cell_x, cell_y of addresses whose registered street has a mapping that changed (in their settlement, or in all)."""
    names = symmetric_difference(old, new).select(F.lower("prg_street_name").alias("_n"), "teryt_simc_code").distinct()
    hit = addresses.join(names, (F.lower("ulica") == F.col("_n")) & F.coalesce(names.teryt_simc_code == F.col("teryt_miejscowosc"), F.lit(True)), "left_semi")
    return hit.select("cell_x", "cell_y").distinct()


def reload_building_types(old: DataFrame, new: DataFrame, buildings: DataFrame, codes: list[str]) -> DataFrame:
    """z, x, y: tiles to draw again (nothing is matched again) for buildings whose class of a tier has a type row of that tier that changed.
    codes: the class column of each tier, from 1. buildings: cell_x, cell_y. The new types are checked first; raises `Refused`."""
    from .quality import Refused, type_violations

    wrong = {r.rule: r.n for r in type_violations(new, "", len(codes)).collect() if r.n and r.rule != "neighbours"}
    if wrong:
        raise Refused(f"building types: {wrong}")
    keys = symmetric_difference(old, new).select("tier", "key").distinct()
    own = buildings.select("cell_x", "cell_y", F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), F.col(c).alias("key")) for i, c in enumerate(codes, 1)))).alias("_k")).select("cell_x", "cell_y", "_k.*")
    cells = own.join(keys, ["tier", "key"], "left_semi").select("cell_x", "cell_y").distinct()
    return cells.select(F.explode(tilemath.tiles_for_cell(F.col("cell_x"), F.col("cell_y"))).alias("t")).select("t.*").distinct()


def mapping_drift(mappings: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """side, keys, rows: mapped keys that no data row has, and data keys (and their rows) that no mapping has."""
    unused = mappings.join(data, key, "left_anti").agg(F.countDistinct(key).alias("keys"), F.count("*").alias("rows"))
    bare = data.filter(F.col(key).isNotNull()).join(mappings, key, "left_anti").agg(F.countDistinct(key).alias("keys"), F.count("*").alias("rows"))
    return unused.select(F.lit("unused").alias("side"), "keys", "rows").unionByName(bare.select(F.lit("uncovered").alias("side"), "keys", "rows"))


def neighbours(buildings: DataFrame, register: DataFrame, key: str, other_by: str | None = None) -> DataFrame:
    """key, neighbours: buildings of the register that touch it, by another centroid, or by another value of the column other_by (which is
    unique in the register). Both with rings and shape columns. Equal shapes of the register are counted first and met once."""
    told = [] if other_by else ["cx", "cy"]
    shapes = by_cell(register.select("rings", *told, *BOX)).repartition("cell_x", "cell_y")
    shapes = shapes.groupBy(*shapes.columns).agg(F.count("*").alias("n"))
    both = meeting(by_cell(buildings.select(key, "rings", *told, *BOX)), shapes)
    if told:
        both = both.filter("cx <> _cx OR cy <> _cy")
    out = both.filter(polygon.touching(F.col("rings"), F.col("_rings"))).groupBy(key).agg(F.sum("_n").alias("neighbours"))
    if other_by:  # all that touch it, less itself
        same = buildings.select(key, other_by, "rings").join(large(register.select(other_by, F.col("rings").alias("_rings"))), other_by).filter(polygon.touching(F.col("rings"), F.col("_rings")))
        out = out.join(large(same.groupBy(key).agg(F.count("*").alias("_own"))), key, "left").select(key, (F.col("neighbours") - F.coalesce("_own", F.lit(0))).alias("neighbours"))
    return out.filter("neighbours > 0")


def tag_buildings(buildings: DataFrame, register: DataFrame, types: DataFrame, key: str, codes: list[Column], levels: str, adjacency: Column, source: str, other_by: str | None = None) -> DataFrame:
    """buildings with neighbours, type_tags and tags. codes: the class by tier; the lowest tier wins, then the row with most
    conditions. register rows for which `adjacency` holds count, as `neighbours` has it. types: a curated table, which is broadcast."""
    counted = buildings.join(large(neighbours(buildings, register.filter(adjacency), key, other_by)), key, "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("long"))
    limits = ["min_levels", "max_levels", "max_neighbours"]
    given = sum((F.col(c).isNotNull().cast("int") for c in limits), F.lit(0))
    rules = types.select("tier", "key", F.struct("tier", (-given).alias("given"), "tags", *limits).alias("r")).groupBy("tier", "key").agg(F.collect_list("r").alias("r"))
    out = counted
    for tier, code in enumerate(codes, 1):
        own = rules.filter(F.col("tier") == tier).select(F.col("key").alias(f"_key{tier}"), F.col("r").alias(f"_rules{tier}"))
        out = out.withColumn("_code", code).join(F.broadcast(own), F.col("_code") == F.col(f"_key{tier}"), "left").drop("_code", f"_key{tier}")
    mine = [f"_rules{tier}" for tier in range(1, len(codes) + 1)]
    every = F.concat(*(F.coalesce(c, F.array().cast(rules.schema["r"].dataType)) for c in mine))
    within = lambda r: (r.min_levels.isNull() | (F.col(levels) >= r.min_levels)) & (r.max_levels.isNull() | (F.col(levels) <= r.max_levels)) & (r.max_neighbours.isNull() | (F.col("neighbours") <= r.max_neighbours))
    best = F.array_min(F.transform(F.filter(every, within), lambda r: F.struct(r.tier.alias("tier"), r.given.alias("given"), r.tags.alias("tags")))).getField("tags")
    out = out.withColumn("type_tags", best).drop(*mine)
    return out.withColumn("tags", text.building_tags(text.parse_tags(F.col("type_tags")), F.col(levels), source))


def address_features(addresses: DataFrame, mappings: DataFrame, source: str) -> DataFrame:
    """addresses with street (resolved) and tags."""
    out = resolve_streets(addresses, mappings)
    return out.withColumn("tags", text.address_tags(F.col("numer_porzadkowy"), F.col("street"), F.col("miejscowosc"), F.col("kod_pocztowy"), F.col("teryt_miejscowosc"), source))


def rows_in_areas(areas: DataFrame, df: DataFrame, area_key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df joined with each area that holds its point. areas: area_key, rings, x0, y0, x1, y1; large ones are cut into cells of zoom 10."""
    z = 10
    span = F.flatten(F.transform(F.sequence(tilemath.cell_x(F.col("x0"), z), tilemath.cell_x(F.col("x1"), z)), lambda x: F.transform(F.sequence(tilemath.cell_y(F.col("y1"), z), tilemath.cell_y(F.col("y0"), z)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    left = areas.select(area_key, F.col("rings").alias("_rings"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(span).alias("_t"))
    right = df.withColumn("_t", F.struct(tilemath.cell_x(F.col(lon), z).alias("x"), tilemath.cell_y(F.col(lat), z).alias("y")))
    inside = F.col(lon).between(F.col("_x0"), F.col("_x1")) & F.col(lat).between(F.col("_y0"), F.col("_y1"))
    both = right.join(left, "_t").filter(inside)
    return both.filter(polygon.contains(F.col("_rings"), F.col(lon), F.col(lat))).drop("_t", "_rings", "_x0", "_y0", "_x1", "_y1")


def _metres_to_sides(rings, lon, lat, k):
    """Metres from a point to the nearest side, on a plane scaled at the point."""
    at = lambda p: F.struct(((p.x - lon) * k.lon).alias("x"), ((p.y - lat) * k.lat).alias("y"))
    sides = F.flatten(F.transform(rings, lambda r: polygon._sides(F.transform(r.pts, at))))

    def squared(s):
        dx, dy = s.q.x - s.p.x, s.q.y - s.p.y
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(s.p.x * dx + s.p.y * dy), dx * dx + dy * dy))), F.lit(0.0))
        return F.pow(s.p.x + t * dx, 2.0) + F.pow(s.p.y + t * dy, 2.0)

    return F.sqrt(F.array_min(F.transform(sides, squared)))


def nearest_building(points: DataFrame, buildings: DataFrame, point_key: str, key: str, radius: float = 50.0) -> DataFrame:
    """point_key, key, metres: the building whose footprint is nearest, closer than the radius, ties by key; 0 inside. Metres are those of
    a plane scaled at the point, to the thousandth of a millimetre. buildings: key, rings, x0, y0, x1, y1. A building goes to the cells
    that its box touches when widened by the radius, a point to its own; boxes decide before sides do."""
    cells = tilemath.cells_for_bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), radius / 30_000.0)
    right = buildings.select(key, "rings", "x0", "y0", "x1", "y1", F.explode(cells).alias("_cell"))
    left = points.select(point_key, "lon", "lat", F.struct(tilemath.cell_x(F.col("lon")).alias("cell_x"), tilemath.cell_y(F.col("lat")).alias("cell_y")).alias("_cell"))
    both = left.join(right, "_cell").withColumn("_k", metric.metres_per_degree(F.col("lat")))
    beyond = lambda v, low, high: F.greatest(F.col(low) - F.col(v), F.col(v) - F.col(high), F.lit(0.0))
    both = both.filter(F.pow(beyond("lon", "x0", "x1") * F.col("_k.lon"), 2.0) + F.pow(beyond("lat", "y0", "y1") * F.col("_k.lat"), 2.0) < radius**2)
    away = _metres_to_sides(F.col("rings"), F.col("lon"), F.col("lat"), F.col("_k"))
    both = both.withColumn("metres", F.when(polygon.contains(F.col("rings"), F.col("lon"), F.col("lat")), F.lit(0.0)).otherwise(F.round(away, 6))).filter(F.col("metres") < radius)
    return both.groupBy(point_key).agg(F.min_by(F.struct(key, "metres"), F.struct("metres", key)).alias("_r")).select(point_key, f"_r.{key}", "_r.metres")


def mapping_agreement(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n, agreeing, share of paired buildings whose two classes map to one tag."""
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(a).eqNullSafe(F.col(b))).alias("agreeing"))
    return out.withColumn("share", F.col("agreeing") / F.col("n"))


def register_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """a_key, b_key where the centroid of a lies in the polygon of b."""
    left = a.select(a_key, "cx", "cy", F.struct(tilemath.cell_x(F.col("cx")).alias("cell_x"), tilemath.cell_y(F.col("cy")).alias("cell_y")).alias("_cell"))
    right = b.select(b_key, "rings", "x0", "y0", "x1", "y1", F.explode(tilemath.cells_for_bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("_cell"))
    return left.join(right, "_cell").filter("cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1").filter(polygon.contains(F.col("rings"), F.col("cx"), F.col("cy"))).select(a_key, b_key)


def propose_global(rows: DataFrame) -> DataFrame:
    """teryt_simc_code, prg_street_name, osm_street_name: a name on which every settlement agrees becomes one row without settlement;
    others keep their own."""
    n = F.lower(F.trim("prg_street_name"))
    agreed = rows.groupBy(n.alias("_n")).agg(F.min("prg_street_name").alias("prg_street_name"), F.min("osm_street_name").alias("osm_street_name"), F.count_distinct("osm_street_name").alias("_d")).filter("_d = 1")
    one = agreed.select(F.lit(None).cast("string").alias("teryt_simc_code"), "prg_street_name", "osm_street_name")
    rest = rows.withColumn("_n", n).join(agreed.select("_n"), "_n", "left_anti").select("teryt_simc_code", "prg_street_name", "osm_street_name")
    return one.unionByName(rest.distinct())


def plain_name(c: Column) -> Column:
    """A name without case, full stops and doubled spaces."""
    return F.array_join(F.filter(F.split(F.lower(F.translate(c, ".", " ")), r"\s+"), lambda w: w != ""), " ")


def rekeyed(mappings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """mappings (teryt_simc_code or null, prg_street_name, osm_street_name) with current and outcome: which spelling of today's register
    (vocabulary: teryt_simc_code, name) a row stands for. A settlement's row looks among its own names, another among all: the same
    spelling (kept), else the one that differs in case, else in full stops and spaces (rekeyed; the first in order), else none (absent). A
    row without settlement that would map a name to itself is noop. Rows of one settlement and spelling (without case) that then agree
    are one; where they differ, all are conflict."""
    voc = vocabulary.select(F.coalesce("teryt_simc_code", F.lit("")).alias("_c"), "name").union(vocabulary.select(F.lit(""), "name")).filter("name IS NOT NULL").distinct()
    levels = {"_exact": lambda c: c, "_case": lambda c: F.lower(c), "_plain": plain_name}
    out = mappings.withColumn("_c", F.coalesce("teryt_simc_code", F.lit("")))
    for level, key in levels.items():
        names = voc.groupBy("_c", key(F.col("name")).alias("_k")).agg(F.min("name").alias(level))
        out = out.withColumn("_k", key(F.col("prg_street_name"))).join(names, ["_c", "_k"], "left").drop("_k")
    out = out.withColumn("current", F.coalesce(*levels))
    outcome = F.when(F.col("current").isNull(), "absent").when((F.col("_c") == "") & (F.col("current") == F.col("osm_street_name")), "noop").when(F.col("_exact").isNotNull(), "kept").otherwise("rekeyed")
    out = out.withColumn("outcome", outcome)
    live = out.filter("outcome IN ('kept', 'rekeyed')")
    torn = live.groupBy("_c", F.lower("current").alias("_l")).agg(F.countDistinct("osm_street_name").alias("_n")).filter("_n > 1").select("_c", "_l", F.lit(True).alias("_torn"))
    marked = out.withColumn("_l", F.when(F.col("outcome").isin("kept", "rekeyed"), F.lower("current"))).join(torn, ["_c", "_l"], "left").withColumn("outcome", F.when(F.col("_torn"), "conflict").otherwise(F.col("outcome")))
    columns = [*mappings.columns, "current", "outcome"]
    one = marked.filter("outcome IN ('kept', 'rekeyed')").groupBy("_c", "_l", "osm_street_name").agg(F.min(F.struct("outcome", "prg_street_name", *(c for c in columns if c not in ("outcome", "prg_street_name")))).alias("_r")).select("_r.*").select(*columns)
    return one.unionByName(marked.filter("outcome NOT IN ('kept', 'rekeyed')").select(*columns))


def threshold_sweep(fractions: DataFrame, key: str, thresholds: list[float]) -> DataFrame:
    """threshold, n: rows whose largest covered share reaches each threshold."""
    top = fractions.groupBy(key).agg(F.max("fraction").alias("_f"))
    counts = top.agg(*(F.count_if(F.col("_f") >= t).alias(f"_{i}") for i, t in enumerate(thresholds)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n")) for i, t in enumerate(thresholds)))))


def geojson(df: DataFrame, lon: str = "lon", lat: str = "lat", tags: str = "tags") -> DataFrame:
    """feature: one GeoJSON feature a row, tags sorted."""
    sorted_tags = F.map_from_entries(F.array_sort(F.map_entries(F.col(tags))))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"), sorted_tags.alias("properties"))).alias("feature"))


def export_log(areas: DataFrame, addresses: DataFrame, buildings: DataFrame, area_key: str, datasets: list[str], at: Column) -> DataFrame:
    """Rows to append to the log of exports: exported_at, area, rings, datasets, address_count, building_count of each area. addresses
    and buildings: exported rows with their area; rings are logged as `polygon.repaired` leaves them, as they were queried."""
    counted = lambda df, name: df.groupBy(area_key).agg(F.count("*").cast("int").alias(name))
    both = areas.join(counted(addresses, "address_count"), area_key, "left").join(counted(buildings, "building_count"), area_key, "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("address_count", "building_count")]
    return both.select(at.alias("exported_at"), F.col(area_key).alias("area"), polygon.repaired(F.col("rings")).alias("rings"), F.array(*(F.lit(d) for d in datasets)).alias("datasets"), *counts)


def recent_exports(log: DataFrame, now: Column, minutes: int, most: int = 1440) -> DataFrame:
    """Rows of the log of the last minutes (at least 1, at most `most`), newest first."""
    if not 1 <= minutes <= most:
        raise ValueError(f"minutes from 1 to {most}")
    return log.filter(F.col("exported_at") >= now - F.make_interval(mins=F.lit(minutes))).orderBy(F.desc("exported_at"), "area")
