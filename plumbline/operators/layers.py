"""What a map reader gets: the detail layers of zoom 14, and exports of areas with tags and outlines.

Layers are tables of features, a row for each feature and tile that it meets, in tile units; `tiled` makes the tiles of them. A point on
the side of two tiles is in both. Attributes that a register lacks are null in its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metric, polygon, text, tilemath
from . import enrich, matching, stats

ZOOM, EXTENT, BUFFER = 14, 4096, 256
#: Fixed value: the source that the tags of register addresses name.
ADDRESS_SOURCE = "gugik.gov.pl"


def _tiles_of(low: Column, high: Column) -> Column:
    """Tile numbers that a stretch of fractional tile numbers meets, sides included."""
    return F.sequence((F.ceil(low) - 1).cast("int"), F.floor(high).cast("int"))


def _tile_grid(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    xs, ys = _tiles_of(tilemath.x_frac(x0, ZOOM), tilemath.x_frac(x1, ZOOM)), _tiles_of(tilemath.y_frac(y1, ZOOM), tilemath.y_frac(y0, ZOOM))
    inside = lambda v: (v >= 0) & (v < (1 << ZOOM))
    return F.flatten(F.transform(F.filter(xs, inside), lambda x: F.transform(F.filter(ys, inside), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def point_features(df: DataFrame, layer: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df's rows in every tile that their point meets: z, x, y, layer, px, py and the columns of df."""
    each = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_t", F.explode(_tile_grid(F.col(lon), F.col(lat), F.col(lon), F.col(lat))))
    unit = lambda f, tile: F.round((f - tile) * F.lit(float(EXTENT))).cast("int")
    at = [unit(tilemath.x_frac(F.col(lon), ZOOM), F.col("_t.x")).alias("px"), unit(tilemath.y_frac(F.col(lat), ZOOM), F.col("_t.y")).alias("py")]
    return each.select(F.lit(ZOOM).alias("z"), F.col("_t.x").alias("x"), F.col("_t.y").alias("y"), F.lit(layer).alias("layer"), *at, *df.columns)


def polygon_features(df: DataFrame, layer: str) -> DataFrame:
    """df's rows in every tile that their polygon meets (its box is x0, y0, x1, y1): z, x, y, layer, shape (clipped to the tile and its buffer)
    and the columns of df."""
    each = df.withColumn("_t", F.explode(_tile_grid(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))
    b = tilemath.tile_bbox(F.lit(ZOOM), F.col("_t.x"), F.col("_t.y"))
    each = each.withColumn("_b", b)
    own = polygon.box(F.col("_b.min_lon"), F.col("_b.min_lat"), F.col("_b.max_lon"), F.col("_b.max_lat"))
    within = (F.col("x0") >= F.col("_b.min_lon")) & (F.col("x1") <= F.col("_b.max_lon")) & (F.col("y0") >= F.col("_b.min_lat")) & (F.col("y1") <= F.col("_b.max_lat"))
    each = each.filter(within | polygon.touching(F.col("rings"), own)).withColumn("shape", stats.tile_geometry(F.col("rings"), ZOOM, F.col("_t.x"), F.col("_t.y"), EXTENT, BUFFER))
    return each.select(F.lit(ZOOM).alias("z"), F.col("_t.x").alias("x"), F.col("_t.y").alias("y"), F.lit(layer).alias("layer"), "shape", *df.columns)


def addresses_layer(unmatched: DataFrame, mappings: DataFrame) -> DataFrame:
    """Addresses that the map lacks, with their resolved street and the tags that they would get."""
    return point_features(enrich.address_features(unmatched, mappings, ADDRESS_SOURCE), "addresses")


def buildings_layer(parts: dict[str, DataFrame]) -> DataFrame:
    """Buildings that the map lacks, of all registers: rows of `enrich.tag_buildings` by source, which must have a column `key`. Neighbours are
    counted over the whole register there, so a tile's border changes nothing."""
    out = None
    for source, df in parts.items():
        one = df.withColumn("source", F.lit(source)).withColumn("approx_area_m2", metric.approx_area_m2(F.col("area"), (F.col("y0") + F.col("y1")) / 2))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return polygon_features(out, "buildings")


def addresses_all_layer(addresses: DataFrame, reports: DataFrame, key: str = "lokalny_id") -> DataFrame:
    """All register addresses; reported is true where an active report stands on the row, else null."""
    flagged = matching.flag_reported(addresses, reports, "prg", key).withColumn("reported", F.when(F.col("reported"), True))
    return point_features(flagged, "addresses_all")


def buildings_all_layer(registers: dict[str, tuple[DataFrame, str]], reports: DataFrame) -> DataFrame:
    """All register buildings, matched or not, of all registers (rows and key column by source); reported as in `addresses_all_layer`."""
    layer = matching.building_layer(registers, reports).withColumn("reported", F.when(F.col("reported"), True))
    return polygon_features(layer.withColumn("approx_area_m2", metric.approx_area_m2(F.col("area"), (F.col("y0") + F.col("y1")) / 2)), "buildings_all")


def tiled(features: DataFrame, order: list[str], told: list[str]) -> DataFrame:
    """z, x, y, layer, features: each tile's features (columns told) in a stable order."""
    each = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*told).alias("f"))
    return features.groupBy("z", "x", "y", "layer").agg(F.transform(F.array_sort(F.collect_list(each)), lambda e: e.f).alias("features"))


def covers(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a polygon or on one of its sides."""
    on = lambda s: ((s.q.x - s.p.x) * (y - s.p.y) == (s.q.y - s.p.y) * (x - s.p.x)) & x.between(F.least(s.p.x, s.q.x), F.greatest(s.p.x, s.q.x)) & y.between(F.least(s.p.y, s.q.y), F.greatest(s.p.y, s.q.y))
    return polygon.contains(rings, x, y) | F.exists(F.flatten(F.transform(rings, lambda r: polygon._sides(r.pts))), on)


def _by_tile(areas: DataFrame, area_key: str, zoom: int) -> DataFrame:
    xs = F.sequence(tilemath.cell_x(F.col("x0"), zoom), tilemath.cell_x(F.col("x1"), zoom))
    ys = F.sequence(tilemath.cell_y(F.col("y1"), zoom), tilemath.cell_y(F.col("y0"), zoom))
    grid = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return areas.select(F.col(area_key).alias("area"), F.col("rings").alias("_rings"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(grid).alias("_t"))


def points_in_areas(areas: DataFrame, df: DataFrame, area_key: str, zoom: int = 10) -> DataFrame:
    """area and the columns of df for every area that a row's point is in or on."""
    right = df.withColumn("_t", F.struct(tilemath.cell_x(F.col("lon"), zoom).alias("x"), tilemath.cell_y(F.col("lat"), zoom).alias("y")))
    both = right.join(_by_tile(areas, area_key, zoom), "_t").filter("lon BETWEEN _x0 AND _x1 AND lat BETWEEN _y0 AND _y1")
    return both.filter(covers(F.col("_rings"), F.col("lon"), F.col("lat"))).select("area", *df.columns)


def polygons_in_areas(areas: DataFrame, df: DataFrame, area_key: str, zoom: int = 10) -> DataFrame:
    """area and the columns of df for every area that a row's polygon meets, were it in one point. A row that meets several of an area's tiles
    is taken in the first that both have."""
    cells = F.flatten(F.transform(F.sequence(tilemath.cell_x(F.col("x0"), zoom), tilemath.cell_x(F.col("x1"), zoom)), lambda x: F.transform(F.sequence(tilemath.cell_y(F.col("y1"), zoom), tilemath.cell_y(F.col("y0"), zoom)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    both = df.withColumn("_t", F.explode(cells)).join(_by_tile(areas, area_key, zoom), "_t").filter("x0 <= _x1 AND _x0 <= x1 AND y0 <= _y1 AND _y0 <= y1")
    first = (F.col("_t.x") == tilemath.cell_x(F.greatest("x0", "_x0"), zoom)) & (F.col("_t.y") == tilemath.cell_y(F.least("y1", "_y1"), zoom))
    return both.filter(first).filter(polygon.touching(F.col("rings"), F.col("_rings"))).select("area", *df.columns)


def geometry_json(rings: Column) -> Column:
    """A polygon as a GeoJSON MultiPolygon: every outer ring with the holes that lie in it."""
    line = lambda r: F.transform(r.pts, lambda p: F.array(p.x, p.y))
    first = lambda r: F.element_at(r.pts, 1)
    middle = lambda r: F.struct(((first(r).x + F.element_at(r.pts, 2).x) / 2).alias("x"), ((first(r).y + F.element_at(r.pts, 2).y) / 2).alias("y"))
    holes = lambda o: F.filter(rings, lambda h: h.hole & polygon.contains(F.array(o), middle(h).x, middle(h).y))
    parts = F.transform(F.filter(rings, lambda r: ~r.hole), lambda o: F.concat(F.array(line(o)), F.transform(holes(o), line)))
    return F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))


def feature_lines(df: DataFrame, geometry: Column) -> Column:
    """A row's GeoJSON feature, its tags sorted."""
    tags = F.map_from_entries(F.array_sort(F.map_entries("tags")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), tags.alias("properties")))


def export_areas(areas: DataFrame, addresses: DataFrame, buildings: dict[str, DataFrame], area_key: str) -> DataFrame:
    """area, dataset, key, tags, feature: what is missing on the map in each area, with the tags that it would get and its outline. addresses:
    rows of `enrich.address_features` with key; buildings: rows of `enrich.tag_buildings` with key, rings and box, by source. An address
    counts if its point is in the area or on its side, a building if any part of it is. Areas: rings, valid, and x0, y0, x1, y1."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    rows = points_in_areas(areas, addresses.select("key", "tags", "lon", "lat"), area_key)
    out = rows.select("area", F.lit("prg").alias("dataset"), "key", "tags", feature_lines(rows, point).alias("feature"))
    for source, df in buildings.items():
        rows = polygons_in_areas(areas, df.select("key", "tags", "rings", "x0", "y0", "x1", "y1"), area_key)
        out = out.unionByName(rows.select("area", F.lit(source).alias("dataset"), "key", "tags", feature_lines(rows, geometry_json(F.col("rings"))).alias("feature")))
    return out


def write_exports(exported: DataFrame, dest: str) -> None:
    """One GeoJSON feature a line, in a folder for each area."""
    exported.select("area", F.col("feature").alias("value")).write.partitionBy("area").text(dest)


def nearest_with_tags(points: DataFrame, buildings: DataFrame, register: DataFrame, types: DataFrame, point_key: str, key: str, codes: list[Column], levels: str, adjacency: Column, source: str, radius: float = 50.0) -> DataFrame:
    """point_key, key, metres, tags: each point's nearest building within the radius, with the tags that it would get; only buildings that
    some point is nearest to are tagged."""
    found = enrich.nearest_building(points, buildings, point_key, key, radius)
    chosen = buildings.join(found.select(key).distinct(), key, "left_semi")
    return found.join(enrich.tag_buildings(chosen, register, types, key, codes, levels, adjacency, source).select(key, "tags"), key).select(point_key, key, "metres", "tags")
