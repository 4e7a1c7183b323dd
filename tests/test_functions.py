import math

from pyspark.sql import functions as F

from plumbline.functions import metric, polygon, text, tilemath
from plumbline.operators import stats


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring(*pts, hole=False):
    return F.struct(F.lit(hole).alias("hole"), F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [*pts, pts[0]])).alias("pts"))


def square(x, y, n=1.0):
    return ring((x, y), (x + n, y), (x + n, y + n), (x, y + n))


SHAPES = {
    "unit": lambda: [square(0, 0)], "half": lambda: [square(0.5, 0.5)], "next": lambda: [square(1, 0)], "hole": lambda: [square(0, 0, 2), ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), hole=True)],
    "big": lambda: [square(-1, -1, 6)], "l": lambda: [ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))], "diamond": lambda: [ring((1, -1), (3, 1), (1, 3), (-1, 1))], "bow": lambda: [ring((0, 0), (1, 1), (1, 0), (0, 1))],
}


def shape(name):
    return polygon.oriented(F.array(*SHAPES[name]()))


def shapes(spark, *names):
    out = None
    for n in names:
        row = spark.range(1).select(F.lit(n).alias("k"), shape(n).alias("rings"))
        out = row if out is None else out.unionByName(row)
    return out


def test_tiles(spark):
    r = one(spark, tilemath.cell_x(F.lit(21.0)).alias("x"), tilemath.cell_y(F.lit(52.0)).alias("y"), tilemath.tile_bbox(F.lit(14), F.lit(9147), F.lit(5411)).alias("b"), tilemath.tiles_for_cell(F.lit(0), F.lit(5)).alias("t"), F.size(tilemath.cells_for_bbox(F.lit(21.0), F.lit(52.0), F.lit(21.0), F.lit(52.0), 0.03)).alias("n"), tilemath.cells_for_bbox(F.lit(1.0), F.lit(40.0), F.lit(20.0), F.lit(50.0)).alias("none"))
    assert (r.x, r.y) == (9147, 5411) and r.b.min_lon <= 21 < r.b.max_lon and r.b.min_lat < 52 <= r.b.max_lat
    assert len(r.t) == 6 + 2 and r.none is None and r.n >= 9


def test_projection_golden_point(spark):
    p = one(spark, metric.grid_to_lonlat(F.lit(216691.39), F.lit(505645.69)).alias("p")).p
    assert abs(p.lon - 14.839103470789498) < 1e-11 and abs(p.lat - 52.343421935204525) < 1e-11


def test_metric(spark):
    d = 1e-5
    r = one(spark, metric.vertex_shift(F.lit(21.0), F.lit(52.0), F.lit(21.0), F.lit(52.0 + d)).alias("n"), metric.vertex_shift(F.lit(21.0), F.lit(52.0), F.lit(21.0 + d), F.lit(52.0)).alias("e"), metric.sphere_distance(F.lit(21.0), F.lit(52.0), F.lit(21.0), F.lit(53.0)).alias("s"), metric.area_m2(F.lit(d * d), F.lit(52.0)).alias("a"), metric.metres_per_degree(F.lit(52.0)).alias("m"))
    assert abs(r.n - 1.1127) < 1e-4 and abs(r.e - 0.6868) < 1e-4 and abs(r.s - 6371008.8 * math.pi / 180) < 1e-6
    assert abs(r.a - r.n * r.e) < 1e-6 and abs(r.m.lat * d - r.n) < 1e-3 and abs(r.m.lon * d - r.e) < 1e-3


def test_text(spark):
    cases = {" 12 A": "12A", "45-47": "45/47", "7\\9": "7/9", "123 a": "123 A", "1ą": "1Ą"}
    for given, want in cases.items():
        assert one(spark, text.norm_housenumber(F.lit(given)).alias("v")).v == want
    r = one(spark, text.norm_name(F.lit("  ŁÓDŹ ")).alias("a"), text.norm_name(F.lit(" ")).alias("b"), text.strip_street_prefix(F.lit("ul. Długa")).alias("c"), text.strip_street_prefix(F.lit("ulica")).alias("d"), text.strip_street_prefix(F.lit("Ulica Nowa")).alias("e"))
    assert tuple(r) == ("łódź", None, "Długa", "ulica", "Nowa")
    codes = {"m - mieszkalne (110)": "m", "Budynki oświaty, nauki": "k", "przemyslowy": "p", " G2. ": "g", "other": None, "zbiorniki, silosy i budynki": "s"}
    for given, want in codes.items():
        assert one(spark, text.class_code(F.lit(given)).alias("v")).v == want, given
    for given, want in {"building=yes; a=b=c": {"building": "yes", "a": "b=c"}, "building": None, "=x": None, "a=": None, "a=1;a=2": None}.items():
        assert one(spark, text.parse_tags(F.lit(given)).alias("v")).v == want, given
    tags = lambda **kv: F.create_map(*(F.lit(x) for k, v in kv.items() for x in (k.replace("__", ":"), v)))
    r = one(spark, text.lifecycle_key(tags(ruins__building="yes", was__building="x")).alias("a"), text.lifecycle_key(tags(building="yes", was__building="x")).alias("b"), text.city_of(tags(addr__place="P")).alias("c"))
    assert tuple(r) == ("was:building", None, "P")
    r = one(spark, text.content_hash(F.lit("x"), F.lit(None).cast("string")).alias("a"), text.content_hash(F.lit(None).cast("string"), F.lit("x")).alias("b"), text.signature(F.lit("x"), F.lit(None).cast("string")).alias("c"), text.signature(F.lit(None).cast("string"), F.lit("x")).alias("d"))
    assert r.a != r.b and r.c != r.d


def test_polygons(spark):
    got = {r.k: r for r in shapes(spark, *SHAPES).select("k", polygon.area(F.col("rings")).alias("a"), polygon.centroid(F.col("rings")).alias("c"), polygon.is_valid(F.col("rings")).alias("v"), polygon.contains(F.col("rings"), F.lit(0.25), F.lit(0.6)).alias("i"), polygon.bbox(F.col("rings")).alias("b")).collect()}
    assert got["hole"].a == 3 and got["l"].a == 5 and got["diamond"].a == 8 and got["unit"].c.asDict() == {"x": 0.5, "y": 0.5}
    assert not got["bow"].v and all(got[k].v for k in SHAPES if k != "bow")
    assert got["unit"].i and not got["half"].i and got["hole"].i and got["l"].i
    assert tuple(got["l"].b) == (0, 0, 3, 3)


def test_overlap(spark):
    every = shapes(spark, "unit", "half", "next", "hole", "big", "l", "diamond")
    a, b = every.withColumnRenamed("k", "ka"), every.withColumnRenamed("k", "kb")
    pairs = a.select("ka").crossJoin(b.select("kb")).withColumn("base", F.lit(-2.0))
    got = {(r.ka, r.kb): r.overlap for r in polygon.overlap_areas(pairs, a, b, "ka", "kb").collect()}
    want = {("unit", "half"): 0.25, ("unit", "next"): 0, ("hole", "big"): 3, ("unit", "hole"): 0.75, ("l", "diamond"): 4, ("l", "big"): 5, ("unit", "unit"): 1, ("half", "hole"): 0}
    for k, v in want.items():
        assert abs(got.get(k, 0) - v) < 1e-9 and abs(got.get(k[::-1], 0) - v) < 1e-9, (k, got.get(k))


def test_touching_and_moves(spark):
    a, b, c = (shape(k) for k in ("unit", "next", "big"))
    far = polygon.oriented(F.array(square(5.5, 9)))
    near = polygon.oriented(F.array(square(2.0**-27, 0)))
    r = one(spark, polygon.touching(a, b).alias("t"), polygon.touching(a, c).alias("in_"), polygon.touching(a, far).alias("f"), polygon.moved(a, near, 0.02).alias("m"), polygon.moved(a, polygon.oriented(F.array(square(2.0**-22, 0))), 0.02).alias("m2"), polygon.moved(a, shape("l"), 0.02).alias("m3"), polygon.moved(F.lit(None).cast(polygon.TYPE), a, 0.02).alias("m4"))
    assert tuple(r) == (True, True, False, False, True, True, True)
    r = one(spark, polygon.repaired(F.array(ring((0, 0), (1, 0), (1, 0), (1, 1)), ring((0, 0), (1, 1), (0, 0)))).alias("r"), polygon.repaired(F.array(ring((0, 0), (1, 1), (0, 0)))).alias("none"))
    assert len(r.r) == 1 and len(r.r[0].pts) == 4 and r.none is None


def test_ratio_and_clip(spark):
    values = spark.createDataFrame([(0, 4, 0.0), (1, 4, 0.25), (4, 4, 1.0), (5, 4, 1.0), (3, 0, -1.0)], "n long, t long, want double")
    assert all(r.r == r.want for r in values.select("want", stats.ratio(F.col("n"), F.col("t")).alias("r")).collect())
    box = [F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]
    got = {r.k: r.a for r in shapes(spark, "l", "diamond", "next", "big", "hole").select("k", F.aggregate(F.transform(stats.clipped(F.col("rings"), *box), lambda r: polygon.ring_area(r.pts)), F.lit(0.0), lambda x, y: x + y).alias("a")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {"l": 3.0, "diamond": 4.0, "next": 1.0, "big": 4.0, "hole": 3.0}


def test_street_prefix_needs_white_space_and_the_start(spark):
    names = {"ul. Nowa": "Nowa", "ul.Nowa": "ul.Nowa", " ul. Nowa": " ul. Nowa", "ULICA   Nowa": "Nowa", "ulica": "ulica", "ul. ": "ul. ", "ulicaNowa": "ulicaNowa", "Nowa ul. x": "Nowa ul. x"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.s for r in df.select("n", text.strip_street_prefix(df.n).alias("s")).collect()} == names
