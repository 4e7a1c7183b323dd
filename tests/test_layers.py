import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import polygon
from plumbline.operators import arrangement, enrich, layers, quality


def ring(hole, *pts):
    return (hole, [(float(x), float(y)) for x, y in [*pts, pts[0]]])


def test_geometry_with_holes_and_parts(spark):
    outer, hole, other = ring(False, (0, 0), (4, 0), (4, 4), (0, 4)), ring(True, (1, 1), (1, 2), (2, 2), (2, 1)), ring(False, (6, 0), (7, 0), (7, 1), (6, 1))
    df = spark.createDataFrame([(1, [other, outer, hole], {"b": "2", "a": "1"})], "k int, rings " + polygon.TYPE + ", tags map<string,string>")
    feature = json.loads(df.select(layers.feature_lines(df, layers.geometry_json(F.col("rings")))).first()[0])
    assert list(feature["properties"].items()) == [("a", "1"), ("b", "2")] and feature["geometry"]["type"] == "MultiPolygon"
    assert [[len(r) for r in part] for part in feature["geometry"]["coordinates"]] == [[5], [5, 5]]
    points = [(2.0, 3.0), (1.5, 1.5), (1.0, 1.5), (4.0, 4.0), (5.0, 0.5), (6.5, 1.0)]
    got = spark.createDataFrame(points, "x double, y double").crossJoin(df).select(layers.covers(F.col("rings"), F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in got] == [True, False, True, True, False, True]


def test_points_and_polygons_on_tile_sides(spark):
    lon = -180 + 360 * 9000 / 16384
    rows = spark.createDataFrame([("a", lon, 52.0), ("b", lon + 1e-6, 52.0), ("c", None, 52.0)], "key string, lon double, lat double")
    got = sorted((r.key, r.x, r.px) for r in layers.point_features(rows, "l").collect())
    assert got == [("a", 8999, 4096), ("a", 9000, 0), ("b", 9000, 0)]
    box = spark.createDataFrame([("p", lon - 0.001, 52.0, lon, 52.001), ("q", lon - 0.001, 52.0, lon + 0.001, 52.001)], "key string, x0 double, y0 double, x1 double, y1 double")
    shapes = layers.polygon_features(box.withColumn("rings", polygon.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))), "l")
    assert sorted((r.key, r.x) for r in shapes.collect()) == [("p", 8999), ("p", 9000), ("q", 8999), ("q", 9000)]
    tiles = layers.tiled(shapes, ["y0", "x0", "key"], ["key", "shape"]).collect()
    assert len(tiles) == 2 and all([f.key for f in t.features] == ["p", "q"] for t in tiles)


def test_large_polygons_are_judged_by_slabs(spark):
    n = 20_000
    circle = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    crossed = [*circle]
    crossed[10], crossed[11] = crossed[11], crossed[10]
    small = [(0, 0), (2, 2), (2, 0), (0, 2)]
    df = spark.createDataFrame([("good", [ring(False, *circle)]), ("crossed", [ring(False, *crossed)]), ("bow", [ring(False, *small)]), ("none", None)], "k string, rings " + polygon.TYPE)
    assert sorted(r.k for r in arrangement.invalid(df, "k").collect()) == ["bow", "crossed"]


def test_load_reasons_say_what_was_left_out(spark):
    s = 2.0**-12
    box = lambda i, w=s: [ring(False, (21, 52 + i * 0.01), (21 + w, 52 + i * 0.01), (21 + w, 52 + i * 0.01 + s), (21, 52 + i * 0.01 + s))]
    rows = [("a", 1, box(1)), ("a", 2, box(1)), ("b", 1, box(2, 1.0)), ("c", 1, box(3, 1e-9)), (None, 1, box(4)), ("d", 1, [ring(False, (21, 52), (22, 53), (22, 52), (21, 53))]), ("e", 1, None)]
    df = spark.createDataFrame(rows, "k string, v int, rings " + polygon.TYPE)
    kept, reasons = quality.load_checked(df, ["k"], "v", F.col("v"), rings="rings", examples=1)
    assert sorted((r.k, r.v) for r in kept.collect()) == [("a", 2), ("e", 1)]
    assert {r.reason: r.told for r in reasons.collect()} == {"duplicate key": "skipped 1 rows, duplicate key (ids: a)", "oversized": "skipped 1 rows, oversized (ids: b)", "undersized": "skipped 1 rows, undersized (ids: c)", "no key": "skipped 1 rows, no key (ids: -)", "invalid geometry": "skipped 1 rows, invalid geometry (ids: d)"}


def test_type_reload_by_tier(spark):
    schema = "tier int, key string, min_levels int, max_levels int, max_neighbours int, tags string"
    old = spark.createDataFrame([(1, "a", None, None, None, "building=yes"), (2, "b", None, None, None, "building=house")], schema)
    new = spark.createDataFrame([(1, "a", None, None, None, "building=yes"), (2, "b", None, None, None, "building=barn")], schema)
    buildings = spark.createDataFrame([("b", "x", 100, 100), ("a", "b", 200, 200)], "detail string, general string, cell_x int, cell_y int")
    tiles = enrich.reload_building_types(old, new, buildings, ["detail", "general"]).collect()
    assert {(t.z, t.x) for t in tiles} == {(14, 199), (14, 200), (14, 201), (13, 100), (12, 50)}
    with pytest.raises(quality.Refused):
        enrich.reload_building_types(old, new.withColumn("tags", F.lit("oops")), buildings, ["detail", "general"])
