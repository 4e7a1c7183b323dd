"""More registered queries: detail layers, exports with outlines, shapes of relations, and what is kept current in a store.

As in `catalog`, every query derives its input from the given tables and applies operators of this package to all of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _AREAS, _CLASSES, _PRG, _STREET, _TYPES, _UNMATCHED, SQL, _boxes, _classes, _prg, _staged, _unmatched, query
from .functions import metric, polygon, text
from .operators import current, enrich, layers, matching, quality, stats
from .plans.derived import prelude, views
from .sources import osm
from .sources.scratch import scratch, written
from .sources.store import Store
from .streaming import upkeep

_FX, _FY = "(lon + 180) / 360 * 16384", "(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384"
_POINT_TILES = f"""SELECT *, CAST(round((fx - x) * 4096) AS INT) AS px, CAST(round((fy - y) * 4096) AS INT) AS py FROM (SELECT *, unnest(generate_series(CAST(ceil(fx) - 1 AS INT), CAST(floor(fx) AS INT)))::INT AS x, fy FROM
    (SELECT *, {_FX} AS fx, {_FY} AS fy FROM {{t}})) CROSS JOIN LATERAL (SELECT unnest(generate_series(CAST(ceil(fy) - 1 AS INT), CAST(floor(fy) AS INT)))::INT AS y)"""


@query(_UNMATCHED + f""", r AS (SELECT *, nullif(trim({_STREET}), '') AS street FROM unmatched a), t AS ({_POINT_TILES.format(t="r")})
SELECT x, y, lokalny_id, px, py, street, CASE WHEN street IS NOT NULL THEN miejscowosc END AS city, (2 + (street IS NOT NULL)::INT + (miejscowosc IS NOT NULL)::INT + (kod_pocztowy IS NOT NULL)::INT + 1)::INT AS n_tags FROM t""")
def z14_addresses(spark, sf_dir):
    out = layers.addresses_layer(_unmatched(spark, sf_dir), views(spark, sf_dir, "street_mappings")[0])
    tag = lambda k, n: F.element_at("tags", k).alias(n)
    return out.select("x", "y", "lokalny_id", "px", "py", tag("addr:street", "street"), tag("addr:city", "city"), F.size("tags").alias("n_tags"))


@query(prelude("gov_addresses", "reports") + f""", {_PRG}, t AS ({_POINT_TILES.format(t="prg")})
SELECT x, y, lokalny_id, px, py, CASE WHEN lokalny_id IN (SELECT record_key FROM reports WHERE source = 'prg' AND status = 'active') THEN true END AS reported FROM t""")
def z14_addresses_all(spark, sf_dir):
    return layers.addresses_all_layer(_prg(spark, sf_dir), views(spark, sf_dir, "reports")[0]).select("x", "y", "lokalny_id", "px", "py", "reported")


_L = lambda p: ((f"{p}.x0", f"{p}.y0", f"{p}.x1", f"{p}.ym"), (f"{p}.x0", f"{p}.ym", f"{p}.xm", f"{p}.y1"))  # noqa: E731  an L is a wide box below and a narrow one above
_MEET = lambda a, b: f"({a[0]} <= {b[2]} AND {b[0]} <= {a[2]} AND {a[1]} <= {b[3]} AND {b[1]} <= {a[3]})"
_MEETS = lambda a, b: "(" + " OR ".join(_MEET(x, y) for x in a for y in b) + ")"
_OVER = lambda a, b: f"greatest(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}), 0) * greatest(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}), 0)"
_BOX = lambda p: (tuple(f"{p}.{c}" for c in ("x0", "y0", "x1", "y1")),)
_W = f"(1 - {metric.E2!r}::DOUBLE * pow(sin(radians((y0 + y1) / 2)), 2))"
_L_M2 = f"CAST(round(((x1 - x0) * (ym - y0) + (xm - x0) * (y1 - ym)) * {metric.LON_METRES * metric.LAT_METRES!r}::DOUBLE * cos(radians((y0 + y1) / 2)) / ({_W} * {_W})) AS INT)"
_TILES = """SELECT *, tx / 16384e0 * 360 - 180 AS t0, degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 16384e0)))) AS u0, (tx + 1) / 16384e0 * 360 - 180 AS t1, degrees(atan(sinh(pi() * (1 - 2 * ty / 16384e0)))) AS u1
    FROM (SELECT *, unnest(generate_series(CAST(ceil((x0 + 180) / 360 * 16384) - 1 AS INT), CAST(floor((x1 + 180) / 360 * 16384) AS INT)))::INT AS tx FROM {t}) CROSS JOIN LATERAL (SELECT unnest(generate_series(
    CAST(ceil((1 - ln(tan(radians(y1)) + 1 / cos(radians(y1))) / pi()) / 2 * 16384) - 1 AS INT), CAST(floor((1 - ln(tan(radians(y0)) + 1 / cos(radians(y0))) / pi()) / 2 * 16384) AS INT)))::INT AS ty)"""
_TILE = (("q.t0", "q.u0", "q.t1", "q.u1"),)
_TOPO_UNMATCHED = f"""u AS (SELECT * FROM topo_buildings b WHERE KATEGORIAISTNIENIA = 'eksploatowany' AND NOT EXISTS (SELECT 1 FROM osm_buildings o WHERE o.x0 < b.x1 AND b.x0 < o.x1 AND o.y0 < b.y1 AND b.y0 < o.y1
    AND {" + ".join(_OVER(x, _BOX("o")[0]) for x in _L("b"))} >= 0.1 * ((b.x1 - b.x0) * (b.ym - b.y0) + (b.xm - b.x0) * (b.y1 - b.ym))))"""


def _ells(df, *parts):
    """L-shaped outlines from x0, y0, x1, y1 and the inner corner xm, ym."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "ym"), ("xm", "ym"), ("xm", "y1"), ("x0", "y1"), ("x0", "y0")]
    return matching.with_shape(df.withColumn("rings", F.array(F.struct(F.lit(False).alias("hole"), F.array(*(at(*c) for c in corners)).alias("pts")))), parts=parts or ("box", "centroid", "area"))


_FUNCTIONS = [(1, "machinery", None, None, 0, "building=garage"), (1, "machinery", None, None, None, "building=warehouse"), (2, "business", 3, None, None, "building=apartments"), (2, "business", None, None, None, "building=house")]
_TYPE_SCHEMA = "tier int, key string, min_levels int, max_levels int, max_neighbours int, tags string"


def _topo_layer(spark, sf_dir):
    topo, osm_boxes = views(spark, sf_dir, "topo_buildings", "osm_buildings")
    register = _ells(topo)
    none = spark.createDataFrame([], "osm_type string, osm_id long, x0 double, y0 double, x1 double, y1 double")
    vetoes = spark.createDataFrame([], "source string, record_key string, status string")
    named = register.withColumn("key", F.concat_ws("/", "PRZESTRZENNAZW", "LOKALNYID"))
    missing = matching.building_classes(named.filter("KATEGORIAISTNIENIA = 'eksploatowany'"), _boxes(osm_boxes, "box"), _boxes(none, "box"), vetoes, "bdot10k", "key").filter("class = 'unmatched'").drop("class")
    missing = _ells(written(missing.select("key", "LOKALNYID", "detail", "general", "storeys", "x0", "y0", "x1", "y1", "xm", "ym"), "missing"))
    codes = [F.lower(F.trim("detail")), F.lower(F.trim("general"))]
    return enrich.tag_buildings(missing, named, spark.createDataFrame(_FUNCTIONS, _TYPE_SCHEMA), "key", codes, "storeys", F.lower(F.trim("detail")) == "machinery", "register 1", "LOKALNYID")


def _egib_layer(spark, sf_dir):
    gov = _boxes(views(spark, sf_dir, "gov_buildings")[0]).withColumn("code", text.class_code(F.col("rodzaj"))).withColumnRenamed("id_budynku", "key")
    missing = _classes(spark, sf_dir).filter("class = 'unmatched'").select("id_budynku", "rodzaj", "storeys", "x0", "y0", "x1", "y1")
    missing = _boxes(written(missing, "missing")).withColumn("code", text.class_code(F.col("rodzaj"))).withColumnRenamed("id_budynku", "key")
    return enrich.tag_buildings(missing, gov, spark.createDataFrame(_TYPES, _TYPE_SCHEMA), "key", [F.col("code")], "storeys", F.col("code") == "m", "register 2")


_EGIB_TAGS = """g AS (SELECT *, CASE WHEN rodzaj IN ('m', 'Budynki mieszkalne jednorodzinne') THEN 'm' WHEN rodzaj = 'biurowy' THEN 'b' WHEN rodzaj = 'g - produkcyjne (12)' THEN 'g' WHEN rodzaj = 'k1.' THEN 'k' END AS code FROM gov_buildings),
n AS (SELECT a.id_budynku, count(*) AS neighbours FROM g a JOIN g b ON b.code = 'm' AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND (a.x0 + a.x1 <> b.x0 + b.x1 OR a.y0 + a.y1 <> b.y0 + b.y1) GROUP BY 1),
e AS (SELECT g.*, CASE code WHEN 'm' THEN CASE WHEN storeys BETWEEN 1 AND 2 THEN CASE WHEN neighbours IS NULL THEN 'detached' ELSE 'house' END WHEN storeys >= 4 THEN 'apartments' ELSE 'residential' END WHEN 'b' THEN 'office' WHEN 'g' THEN 'outbuilding' ELSE 'yes' END AS building FROM g LEFT JOIN n USING (id_budynku))"""
_BASE = prelude("gov_buildings", "osm_buildings", "former_buildings", "reports")


@query(prelude("gov_buildings", "osm_buildings", "former_buildings", "reports", "topo_buildings") + _CLASSES.removeprefix(_BASE) + f""", {_EGIB_TAGS}, {_TOPO_UNMATCHED},
tn AS (SELECT a.PRZESTRZENNAZW, a.LOKALNYID, count(*) AS neighbours FROM topo_buildings a JOIN topo_buildings b ON lower(trim(b.detail)) = 'machinery' AND b.LOKALNYID <> a.LOKALNYID AND {_MEETS(_L("a"), _L("b"))} GROUP BY ALL),
t AS (SELECT u.*, CASE WHEN lower(trim(detail)) = 'machinery' THEN CASE WHEN neighbours IS NULL THEN 'garage' ELSE 'warehouse' END WHEN lower(trim(general)) = 'business' THEN CASE WHEN storeys >= 3 THEN 'apartments' ELSE 'house' END ELSE 'yes' END AS building FROM u LEFT JOIN tn USING (PRZESTRZENNAZW, LOKALNYID)),
k AS (SELECT 'egib' AS source, e.id_budynku AS key, e.x0, e.y0, e.x1, e.y1, e.x1 AS xm, e.y1 AS ym, building, storeys FROM e JOIN classes c ON c.id_budynku = e.id_budynku AND c.class = 'unmatched'
    UNION ALL SELECT 'bdot10k', PRZESTRZENNAZW || '/' || LOKALNYID, x0, y0, x1, y1, xm, ym, building, storeys FROM t), q AS ({_TILES.format(t="k")})
SELECT tx AS x, ty AS y, source, key, {_L_M2} AS approx_area_m2, building, CASE WHEN storeys >= 1 THEN storeys::VARCHAR END AS levels FROM q WHERE {_MEETS(_L("q"), _TILE)}""")
def z14_buildings(spark, sf_dir):
    out = layers.buildings_layer({"bdot10k": _topo_layer(spark, sf_dir), "egib": _egib_layer(spark, sf_dir)})
    return out.select("x", "y", "source", "key", "approx_area_m2", F.element_at("tags", "building").alias("building"), F.element_at("tags", "building:levels").alias("levels"))


@query(prelude("gov_buildings", "reports", "topo_buildings") + f""", k AS (SELECT 'egib' AS source, id_budynku AS key, x0, y0, x1, y1, x1 AS xm, y1 AS ym, id_budynku IN (SELECT record_key FROM reports WHERE source = 'egib' AND status = 'active') AS r FROM gov_buildings
    UNION ALL SELECT 'bdot10k', LOKALNYID, x0, y0, x1, y1, xm, ym, false FROM topo_buildings), q AS ({_TILES.format(t="k")})
SELECT tx AS x, ty AS y, source, key, {_L_M2} AS approx_area_m2, CASE WHEN r THEN true END AS reported FROM q WHERE {_MEETS(_L("q"), _TILE)}""")
def z14_buildings_all(spark, sf_dir):
    gov, topo, vetoes = views(spark, sf_dir, "gov_buildings", "topo_buildings", "reports")
    out = layers.buildings_all_layer({"bdot10k": (_ells(topo), "LOKALNYID"), "egib": (_boxes(gov), "id_budynku")}, vetoes)
    return out.select("x", "y", "source", "key", "approx_area_m2", "reported")


_AREA_PARTS = (("a.x0", "a.y0", "a.x0 + 0.25e0", "a.y0 + 0.125e0"), ("a.x0", "a.y0 + 0.125e0", "a.x0 + 0.125e0", "a.y0 + 0.25e0"))  # an L, with a hole in its corner
_HOLE = ("a.x0 + 0.03125e0", "a.y0 + 0.03125e0", "a.x0 + 0.0625e0", "a.y0 + 0.0625e0")


def _areas(spark, sf_dir):
    rows = spark.sql(f"WITH {_AREAS.replace('FROM nation', 'FROM {nation}')} SELECT area, x0, y0, x0 + 0.25e0 AS x1, y0 + 0.25e0 AS y1, x0 + 0.125e0 AS xm, y0 + 0.125e0 AS ym, x0 + 0.03125e0 AS h0, y0 + 0.03125e0 AS k0, x0 + 0.0625e0 AS h1, y0 + 0.0625e0 AS k1 FROM areas", nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    hole = F.struct(F.lit(True).alias("hole"), F.array(*(at(*c) for c in (("h0", "k0"), ("h0", "k1"), ("h1", "k1"), ("h1", "k0"), ("h0", "k0")))).alias("pts"))
    return _ells(rows, "box").withColumn("rings", F.array_append("rings", hole)).select("area", "rings", "x0", "y0", "x1", "y1")


@query(prelude("gov_addresses", "osm_addresses", "street_mappings", "reports", "gov_buildings", "osm_buildings", "former_buildings") + _UNMATCHED.removeprefix(prelude("gov_addresses", "osm_addresses", "street_mappings", "reports")) + _CLASSES.removeprefix(_BASE) + f""", {_AREAS}, {_EGIB_TAGS},
p AS (SELECT area, 'prg' AS dataset, lokalny_id AS key, 3 + (nullif(trim({_STREET.replace("a.", "u.")}), '') IS NOT NULL)::INT + (miejscowosc IS NOT NULL)::INT + (kod_pocztowy IS NOT NULL)::INT AS n_tags FROM unmatched u JOIN areas a
    ON {" OR ".join(f"(lon BETWEEN {x[0]} AND {x[2]} AND lat BETWEEN {x[1]} AND {x[3]})" for x in _AREA_PARTS)} WHERE NOT (lon > {_HOLE[0]} AND lon < {_HOLE[2]} AND lat > {_HOLE[1]} AND lat < {_HOLE[3]})),
b AS (SELECT area, 'egib' AS dataset, e.id_budynku AS key, 2 + (storeys >= 1)::INT AS n_tags FROM e JOIN classes c ON c.id_budynku = e.id_budynku AND c.class = 'unmatched' JOIN areas a ON {_MEETS(_BOX("e"), _AREA_PARTS)} WHERE NOT (e.x0 > {_HOLE[0]} AND e.x1 < {_HOLE[2]} AND e.y0 > {_HOLE[1]} AND e.y1 < {_HOLE[3]}))
SELECT area, dataset, count(*) AS n, min(key) AS first_key, sum(n_tags)::BIGINT AS n_tags FROM (SELECT * FROM p UNION ALL SELECT * FROM b) GROUP BY area, dataset""")
def exported_features(spark, sf_dir):
    """Exports of areas with a concave side and a hole: addresses on a side count, buildings count where any part of them is."""
    homes = enrich.address_features(_unmatched(spark, sf_dir), views(spark, sf_dir, "street_mappings")[0], layers.ADDRESS_SOURCE).withColumnRenamed("lokalny_id", "key")
    out = layers.export_areas(_areas(spark, sf_dir), homes, {"egib": _egib_layer(spark, sf_dir)}, "area")
    return out.filter(F.get_json_object("feature", "$.type") == "Feature").groupBy("area", "dataset").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.sum(F.size("tags")).alias("n_tags"))


@query(SQL["nearest_buildings"].replace(" SELECT c_custkey, id_budynku, round(m, 3) AS metres", "").replace("SELECT c_custkey, id_budynku, round(m, 3) AS metres FROM", f", {_EGIB_TAGS} SELECT c_custkey, id_budynku, building, CASE WHEN storeys >= 1 THEN storeys::VARCHAR END AS levels FROM").replace("WHERE r = 1", "JOIN e USING (id_budynku) WHERE r = 1"))
def nearest_tagged(spark, sf_dir):
    points = spark.sql("SELECT c_custkey, 16e0 + (c_custkey * 37) % 8192 / 4096e0 AS lon, 50e0 + (c_custkey * 101 + CAST(floor(c_custkey / 8192e0) AS BIGINT)) % 8192 / 4096e0 AS lat FROM {customer}", customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    gov = _boxes(views(spark, sf_dir, "gov_buildings")[0]).withColumn("code", text.class_code(F.col("rodzaj")))
    out = layers.nearest_with_tags(points, gov, gov, spark.createDataFrame(_TYPES, _TYPE_SCHEMA), "c_custkey", "id_budynku", [F.col("code")], "storeys", F.col("code") == "m", "register", 30.0)
    return out.select("c_custkey", "id_budynku", F.element_at("tags", "building").alias("building"), F.element_at("tags", "building:levels").alias("levels"))


_SHAPES = """s AS (SELECT c_custkey AS k, 0e0 AS ax0, 0e0 AS ay0, 2e0 AS ax1, 1e0 + c_custkey % 2 AS ay1, c_custkey % 6 / 2e0 AS bx0, c_custkey % 5 / 4e0 AS by0, c_custkey % 6 / 2e0 + 1 AS bx1, c_custkey % 5 / 4e0 + 1.5e0 AS by1, 0.25e0 AS cx0, 0.5e0 AS cy0, 0.75e0 + c_custkey % 3 AS cx1, 0.75e0 + c_custkey % 4 / 2e0 AS cy1 FROM customer)"""


def _common(*names: str) -> str:
    if len(names) == 1:
        (n,) = names
        return f"({n}x1 - {n}x0) * ({n}y1 - {n}y0)"
    side = lambda c: f"greatest(least({', '.join(f'{n}{c}1' for n in names)}) - greatest({', '.join(f'{n}{c}0' for n in names)}), 0)"
    return f"{side('x')} * {side('y')}"


@query(f"WITH {_SHAPES} SELECT k AS osm_id, CAST(round(({_common('a')} + {_common('b')} - {_common('a', 'b')} - {_common('a', 'c')} - {_common('b', 'c')} + {_common('a', 'b', 'c')}) * 1000000) AS BIGINT) AS micro_area FROM s")
def relation_shapes(spark, sf_dir):
    """Multipolygons of two outer ways that overlap, touch or lie apart, and an inner way across them."""
    shapes = spark.sql(f"WITH {_SHAPES.replace('FROM customer', 'FROM {customer}')} SELECT * FROM s", customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    ring = lambda n: [(f"{n}x0", f"{n}y0"), (f"{n}x1", f"{n}y0"), (f"{n}x1", f"{n}y1"), (f"{n}x0", f"{n}y1")]
    corners = [c for n in "abc" for c in ring(n)]
    node = F.explode(F.array(*(F.struct((F.col("k") * 100 + i).alias("id"), F.col(x).alias("lon"), F.col(y).alias("lat")) for i, (x, y) in enumerate(corners)))).alias("n")
    no_tags = F.create_map().cast("map<string,string>")
    nodes = shapes.select(node).select("n.*", no_tags.alias("tags"))
    refs = lambda j: F.array(*(F.col("k") * 100 + 4 * j + i for i in (0, 1, 2, 3, 0)))
    ways = shapes.select(F.explode(F.array(*(F.struct((F.col("k") * 100 + j).alias("id"), refs(j).alias("refs")) for j in range(3)))).alias("w")).select("w.*", no_tags.alias("tags"))
    member = lambda j, role: F.struct(F.lit("way").alias("type"), (F.col("k") * 100 + j).alias("ref"), F.lit(role).alias("role"))
    relations = shapes.select(F.col("k").alias("id"), F.array(member(0, "outer"), member(1, ""), member(2, "inner")).alias("members"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"))
    out = osm.relation_buildings(upkeep._elements(nodes, ways, relations))
    return out.select("osm_id", F.round(polygon.area(F.col("rings")) * 1_000_000).cast("long").alias("micro_area"))


@query("""SELECT c_custkey AS rel, ['no ways', 'missing ways', 'open rings', 'missing nodes', 'no area', 'not found'][NULLIF(c_custkey % 7, 0)] AS problem, CASE c_custkey % 7 WHEN 2 THEN CAST(c_custkey * 10 + 9 AS VARCHAR) WHEN 3 THEN CAST(c_custkey * 10 AS VARCHAR) || ',' || CAST(c_custkey * 10 + 2 AS VARCHAR) WHEN 4 THEN CAST(c_custkey * 10 + 8 AS VARCHAR) END AS ids, CASE WHEN c_custkey % 7 = 0 THEN 2000000 END::BIGINT AS micro_area FROM customer""")
def relation_problems(spark, sf_dir):
    """Areas of relations, or what stands in their way: each kind of failure in a seventh of the relations."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("long").alias("c_custkey")).withColumn("m", k % 7)
    no_tags = F.create_map().cast("map<string,string>")
    at = [(0, 0), (2, 0), (2, 1), (0, 1)]
    nodes = rows.select(F.explode(F.array(*(F.struct((k * 10 + i).alias("id"), F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for i, (x, y) in enumerate(at)))).alias("n")).select("n.*", no_tags.alias("tags"))
    one, two = F.array(k * 10, k * 10 + 1, k * 10 + 2), F.when(F.col("m") == 4, F.array(k * 10 + 2, k * 10 + 8, k * 10)).when(F.col("m") == 5, F.array(k * 10, k * 10 + 1, k * 10 + 2)).otherwise(F.array(k * 10, k * 10 + 3, k * 10 + 2))
    ways = rows.select(F.explode(F.array(F.struct((k * 10).alias("id"), one.alias("refs")), F.struct((k * 10 + 1).alias("id"), two.alias("refs")))).alias("w")).select("w.*", no_tags.alias("tags"))
    member = lambda ref, role: F.struct(F.lit("way").alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    first, second = member(k * 10, "outer"), member(k * 10 + 1, "inner")
    members = F.when(F.col("m") == 1, F.array(member(k * 10, "label"))).when(F.col("m") == 2, F.array(first, second, member(k * 10 + 9, "outer"))).when(F.col("m") == 3, F.array(first)).otherwise(F.array(first, second, first))
    relations = rows.filter("m <> 6").select(k.alias("id"), members.alias("members"), no_tags.alias("tags"))
    out = osm.relation_areas(rows.select(k.alias("rel")), upkeep._elements(nodes, ways, relations))
    return out.select("rel", "problem", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.round(polygon.area(F.col("rings")) * 1_000_000).cast("long").alias("micro_area"))


@query(_CLASSES + " SELECT id_budynku, cell_x FROM (SELECT id_budynku, class, CAST(floor(((x0 + x1) / 2 + 180) / 360 * 16384) AS INT) AS cell_x FROM classes) WHERE class = 'unmatched' AND cell_x % 3 = 0")
def recomputed_cells(spark, sf_dir):
    """Unmatched buildings of every third column of cells, matched anew from what their boxes reach."""
    gov, osm_boxes, former, vetoes = views(spark, sf_dir, "gov_buildings", "osm_buildings", "former_buildings", "reports")
    own = matching.with_cell(_boxes(quality.only_standing(gov)), "cx", "cy")
    cells = own.filter("cell_x % 3 = 0").select(*current.CELL).distinct()
    unmatched, _ = current.buildings_of_cells(own, _boxes(osm_boxes, "box"), _boxes(former, "box"), vetoes, "egib", "id_budynku")(cells)
    return unmatched.select("id_budynku", "cell_x")


@query(SQL["snapshot_applied"])
def refreshed_register(spark, sf_dir):
    """The register after two refreshes of a store."""
    live, staged = _staged(spark, sf_dir)
    with_cells = lambda df: df.select("*", F.lit(0).alias("cell_x"), (F.col("k") % 16).cast("int").alias("cell_y"))
    store, register = Store(spark, scratch(spark, "registers")), current.Register("egib", ["k"], ["a", "b"])
    for rows, etag in ((live, "1"), (staged, "2")):
        current.refresh(store, register, with_cells(rows), F.current_timestamp(), etag, blocks=16)
    return store.read("register_egib").drop("cell_x", "cell_y")


@query(prelude("ways", "nodes") + """, m AS (SELECT node, CASE WHEN node % 10 = 1 THEN lon + 1 ELSE lon END AS lon, lat FROM nodes WHERE node % 10 <> 0),
o AS (SELECT way, node, row_number() OVER (PARTITION BY way ORDER BY ord, node) AS ord FROM ways), r AS (SELECT * FROM o WHERE way % 20 > 1 OR (way % 20 = 1 AND ord <= 2)),
p AS (SELECT r.way, ord, lon, lat, count(*) OVER (PARTITION BY r.way) AS n, count(lon) OVER (PARTITION BY r.way) AS f, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM r LEFT JOIN m USING (node) WINDOW w AS (PARTITION BY r.way ORDER BY ord)),
l AS (SELECT *, sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)) AS d FROM p WHERE n = f AND n >= 2),
c AS (SELECT way, sum(d) AS d, sum(d * (lon + lon2) / 2) AS x, sum(d * (lat + lat2) / 2) AS y, arg_min(lon, ord) AS x1, arg_min(lat, ord) AS y1 FROM l GROUP BY way)
SELECT way AS osm_id, CAST(round(CASE WHEN d > 0 THEN x / d ELSE x1 END * 100000) AS BIGINT) AS lon5, CAST(round(CASE WHEN d > 0 THEN y / d ELSE y1 END * 100000) AS BIGINT) AS lat5 FROM c""")
def map_after_batch(spark, sf_dir):
    """Addresses of ways after a batch that deletes and moves nodes, and deletes and cuts ways."""
    refs, nodes = views(spark, sf_dir, "ways", "nodes")
    tags = F.create_map(F.lit("addr:housenumber"), F.lit("1"))
    no_tags = F.create_map().cast("map<string,string>")
    nodes = nodes.select(F.col("node").alias("id"), F.lit(1).cast("long").alias("version"), "lon", "lat", no_tags.alias("tags"))
    ways = refs.groupBy(F.col("way").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "node"))).alias("r")).select("id", F.lit(1).cast("long").alias("version"), F.transform("r", lambda x: x.node).alias("refs"), tags.alias("tags"))
    relations = spark.createDataFrame([], f"id long, version long, members {osm.MEMBERS}, tags map<string,string>")
    store = Store(spark, scratch(spark, "map"))
    upkeep.load(store, nodes, ways, relations, blocks=16)
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, action, lon, lat, r, t: [F.lit(kind).alias("kind"), action.alias("action"), F.col("id"), F.lit(2).cast("long").alias("version"), F.lit(0).cast("long").alias("part"), lon.alias("lon"), lat.alias("lat"), r.alias("refs"), none(osm.MEMBERS).alias("members"), t.alias("tags")]
    changed = nodes.filter("id % 10 < 2").select(*row("node", F.when(F.col("id") % 10 == 0, "delete").otherwise("modify"), F.col("lon") + 1, F.col("lat"), none("array<bigint>"), no_tags))
    cut = ways.filter("id % 20 < 2").select(*row("way", F.when(F.col("id") % 20 == 0, "delete").otherwise("modify"), none("double"), none("double"), F.slice("refs", 1, 2), tags))
    upkeep.apply_batch(store, changed.unionByName(cut), F.current_timestamp())
    at = lambda c: F.round(F.col(c) * 100_000).cast("long").alias(f"{c}5")
    return store.read("addresses").select("osm_id", at("lon"), at("lat"))


@query(prelude("gov_buildings") + """, d AS (SELECT CASE WHEN storeys = 5 AND rodzaj = 'unknown' THEN NULL ELSE id_budynku END AS k, CASE WHEN storeys = 1 THEN x1 - x0 ELSE 0 END AS less, CASE WHEN storeys = 2 AND rodzaj = 'biurowy' THEN 1e0 ELSE 0e0 END AS more, rodzaj, storeys FROM gov_buildings UNION ALL SELECT id_budynku, 0, 0e0, rodzaj, -1 FROM gov_buildings WHERE rodzaj = 'm'),
r AS (SELECT coalesce(k, '-') AS k, CASE WHEN k IS NULL THEN 'no key' WHEN less > 0 AND rodzaj = 'm' THEN 'invalid geometry' WHEN more > 0 THEN 'oversized' WHEN less > 0 THEN 'undersized' WHEN storeys = -1 AND EXISTS (SELECT 1 FROM gov_buildings g WHERE g.id_budynku = k AND NOT (g.storeys = 1)) THEN 'duplicate key' END AS reason FROM d)
SELECT reason, count(*) AS n, min(k) AS first_example FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def load_reasons(spark, sf_dir):
    """Rows that a load leaves out: keys taken away, outlines folded, stretched or shrunk, and older doubles."""
    rows = views(spark, sf_dir, "gov_buildings")[0].select(F.when(~((F.col("storeys") == 5) & (F.col("rodzaj") == "unknown")), F.col("id_budynku")).alias("k"), "x0", "y0", "x1", "y1", "rodzaj", "storeys")
    rows = rows.unionByName(views(spark, sf_dir, "gov_buildings")[0].filter("rodzaj = 'm'").select(F.col("id_budynku").alias("k"), "x0", "y0", "x1", "y1", "rodzaj", F.lit(-1).alias("storeys")))
    x0, x1, one = F.col("x0"), F.col("x1"), F.col("storeys") == 1
    p = lambda x, y: F.struct(x.alias("x"), F.col(y).alias("y"))
    bow = F.array(F.struct(F.lit(False).alias("hole"), F.array(p(x0, "y0"), p(x1, "y1"), p(x1, "y0"), p(x0, "y1"), p(x0 + 0, "y0")).alias("pts")))
    wide = F.when((F.col("storeys") == 2) & (F.col("rodzaj") == "biurowy"), x1 + 1).when(one, x0 + 2.0**-40).otherwise(x1)
    rings = F.when(one & (F.col("rodzaj") == "m"), bow).otherwise(polygon.box(x0, F.col("y0"), wide, F.col("y1")))
    _, reasons = quality.load_checked(rows.withColumn("rings", rings), ["k"], "storeys", text.signature(F.col("rodzaj")), rings="rings")
    return reasons.select("reason", "n", F.get("examples", 0).alias("first_example"))


@query(f"""{prelude("gov_addresses")}, v AS (SELECT DISTINCT teryt_miejscowosc AS c, ulica AS name FROM gov_addresses WHERE ulica IS NOT NULL),
m AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN CAST(100000 + c_custkey % 20 AS STRING) END AS c, CASE c_custkey % 4 WHEN 0 THEN 'UL  STREET ' WHEN 1 THEN 'ul. Street ' WHEN 2 THEN 'UL. street ' ELSE 'Gone ' END || CAST(c_custkey % 50 AS STRING) AS prg, CASE WHEN c_custkey % 11 = 0 THEN 'Other' ELSE 'Avenue ' || CAST(c_custkey % 50 AS STRING) END AS osm FROM customer GROUP BY ALL),
w AS (SELECT c, name FROM v UNION SELECT NULL, name FROM v),
k AS (SELECT m.*, (SELECT min(name) FROM w WHERE w.c IS NOT DISTINCT FROM m.c AND name = prg) AS e, (SELECT min(name) FROM w WHERE w.c IS NOT DISTINCT FROM m.c AND lower(name) = lower(prg)) AS l, (SELECT min(name) FROM w WHERE w.c IS NOT DISTINCT FROM m.c AND trim(regexp_replace(lower(replace(name, '.', ' ')), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(replace(prg, '.', ' ')), '\\s+', ' ', 'g'))) AS p FROM m),
o AS (SELECT *, coalesce(e, l, p) AS current, CASE WHEN coalesce(e, l, p) IS NULL THEN 'absent' WHEN e IS NOT NULL THEN 'kept' ELSE 'rekeyed' END AS outcome FROM k),
t AS (SELECT *, count(*) OVER (PARTITION BY c, lower(current), outcome = 'absent') AS n FROM o), d AS (SELECT c, lower(current) AS lc, count(DISTINCT osm) AS n FROM o WHERE outcome <> 'absent' GROUP BY ALL)
SELECT outcome, current, count(*) AS n FROM (SELECT CASE WHEN d.n > 1 THEN 'conflict' ELSE o.outcome END AS outcome, current FROM o LEFT JOIN d ON d.c IS NOT DISTINCT FROM o.c AND d.lc = lower(o.current) WHERE o.outcome = 'absent' OR d.n > 1
    UNION ALL SELECT min(o.outcome), min(current) FROM o JOIN d ON d.c IS NOT DISTINCT FROM o.c AND d.lc = lower(o.current) WHERE o.outcome <> 'absent' AND d.n = 1 GROUP BY o.c, d.lc, o.osm) GROUP BY ALL""")
def rekeyed_mappings(spark, sf_dir):
    """Street mappings under older spellings, brought onto those of the register."""
    rows = spark.sql("SELECT CASE WHEN c_custkey % 3 > 0 THEN CAST(100000 + c_custkey % 20 AS STRING) END AS teryt_simc_code, CASE c_custkey % 4 WHEN 0 THEN 'UL  STREET ' WHEN 1 THEN 'ul. Street ' WHEN 2 THEN 'UL. street ' ELSE 'Gone ' END || CAST(c_custkey % 50 AS STRING) AS prg_street_name, CASE WHEN c_custkey % 11 = 0 THEN 'Other' ELSE 'Avenue ' || CAST(c_custkey % 50 AS STRING) END AS osm_street_name FROM {customer}", customer=spark.read.parquet(f"{sf_dir}/customer.parquet")).distinct()
    names = views(spark, sf_dir, "gov_addresses")[0].select(F.col("teryt_miejscowosc").alias("teryt_simc_code"), F.col("ulica").alias("name")).distinct()
    return enrich.rekeyed(rows, names).groupBy("outcome", "current").agg(F.count("*").alias("n"))


@query(prelude("osm_addresses", "osm_buildings", "former_buildings", "reports") + """, b AS (SELECT osm_type, CASE WHEN osm_id % 7 = 0 THEN 'house' WHEN osm_id % 3 = 0 THEN 'yes' ELSE 'garage' END AS building FROM osm_buildings)
SELECT 'addresses' AS section, osm_type AS value, NULL AS detail, count(*) AS n FROM osm_addresses GROUP BY osm_type UNION ALL SELECT 'buildings', osm_type, NULL, count(*) FROM b GROUP BY osm_type UNION ALL SELECT 'former', NULL, NULL, count(*) FROM former_buildings
UNION ALL (SELECT 'building value', building, NULL, count(*) AS n FROM b GROUP BY building ORDER BY n DESC, building LIMIT 10) UNION ALL SELECT 'reports', source, status, count(*) FROM reports GROUP BY source, status""")
def map_summary(spark, sf_dir):
    homes, boxes, former, vetoes = views(spark, sf_dir, "osm_addresses", "osm_buildings", "former_buildings", "reports")
    kinds = F.when(F.col("osm_id") % 7 == 0, "house").when(F.col("osm_id") % 3 == 0, "yes").otherwise("garage")
    return stats.map_summary(homes, boxes.withColumn("building", kinds), former, vetoes)


_BIN = lambda lon, lat: f"CAST(floor(({lon} + 180) / 360 * 16384) AS INT) >> 4 AS bin_x, CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 16384) AS INT) >> 4 AS bin_y"


@query(prelude("gov_addresses", "osm_addresses", "street_mappings", "reports", "gov_buildings", "osm_buildings", "former_buildings", "changes") + _UNMATCHED.removeprefix(prelude("gov_addresses", "osm_addresses", "street_mappings", "reports")) + _CLASSES.removeprefix(_BASE) + f""",
c AS (SELECT CASE WHEN id % 2 = 0 THEN 'egib' ELSE 'prg' END AS source, ts, {_BIN('lon', 'lat')} FROM changes WHERE ts >= TIMESTAMP '2024-01-10'),
u AS (SELECT {_BIN('lon', 'lat')}, 'prg' AS s, 0 AS u, 1 AS t FROM prg UNION ALL SELECT cell_x >> 4, cell_y >> 4, 'prg', 1, 0 FROM unmatched UNION ALL SELECT {_BIN('((x0 + x1) / 2)', '((y0 + y1) / 2)')}, 'egib', (class = 'unmatched')::INT, 1 FROM classes),
g AS (SELECT bin_x, bin_y, coalesce(sum(u) FILTER (WHERE s = 'egib'), 0)::BIGINT AS unmatched_egib, coalesce(sum(t) FILTER (WHERE s = 'egib'), 0)::BIGINT AS total_egib, coalesce(sum(u) FILTER (WHERE s = 'prg'), 0)::BIGINT AS unmatched_prg, coalesce(sum(t) FILTER (WHERE s = 'prg'), 0)::BIGINT AS total_prg FROM u GROUP BY bin_x, bin_y),
h AS (SELECT bin_x, bin_y, floor(epoch(max(ts) FILTER (WHERE source = 'egib')))::BIGINT AS ce, floor(epoch(max(ts) FILTER (WHERE source = 'prg')))::BIGINT AS cp FROM c GROUP BY bin_x, bin_y)
SELECT bin_x, bin_y, unmatched_egib, total_egib, unmatched_prg, total_prg, coalesce(ce, 0) AS changed_egib, coalesce(cp, 0) AS changed_prg, CASE WHEN total_egib > 0 THEN least(unmatched_egib / total_egib, 1) ELSE -1 END::DOUBLE AS ratio_egib, CASE WHEN total_prg > 0 THEN least(unmatched_prg / total_prg, 1) ELSE -1 END::DOUBLE AS ratio_prg, bin_x / 1024e0 * 360 - 180 AS min_lon FROM g LEFT JOIN h USING (bin_x, bin_y)""")
def register_bins(spark, sf_dir):
    """Bins of zoom 10 with both registers' figures, latest changes and corners."""
    buildings = matching.with_cell(matching.with_shape(_classes(spark, sf_dir), parts=("centroid",)), "cx", "cy")
    homes = matching.with_cell(_prg(spark, sf_dir))
    registers = {"egib": (buildings.filter("class = 'unmatched'"), matching.cell_totals(buildings, "egib")), "prg": (_unmatched(spark, sf_dir), matching.cell_totals(homes, "prg"))}
    changes = matching.with_cell(views(spark, sf_dir, "changes")[0].select(F.when(F.col("id") % 2 == 0, "egib").otherwise("prg").alias("source"), "lon", "lat", F.col("ts").alias("detected_at")))
    return stats.register_bins(registers, changes, 10, F.lit("2024-01-10").cast("timestamp")).drop("min_lat", "max_lat", "max_lon")
