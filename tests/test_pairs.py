import random

from pyspark.sql import functions as F

from plumbline.functions import polygon
from plumbline.operators import enrich, matching

BOX = "k string, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows):
    df = spark.createDataFrame(rows, BOX)
    return matching.with_shape(df.withColumn("rings", polygon.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))


def test_pairs_of_a_dense_town_are_found_in_small_cells(spark):
    step = 2.0**-13
    town = boxes(spark, [(f"{i:02}-{j:02}", 21 + i * step, 52 + j * step, 21 + (i + 0.5) * step, 52 + (j + 0.5) * step) for i in range(60) for j in range(40)])
    cells = matching.by_cell(town.select("k", *matching.BOX))
    assert cells.groupBy("cell_x", "cell_y").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 2400 * 300  # 2,400 rows of one or two cells of zoom 14
    assert [tuple(r) for r in matching.coverage(town, town.withColumnRenamed("k", "o"), "k", "o").filter("k <> o OR fraction <> 1").collect()] == []
    assert matching.coverage(town, town.withColumnRenamed("k", "o"), "k", "o").count() == 2400


def test_overlap_of_a_row_equals_the_sum_over_tables_of_sides(spark):
    rng = random.Random(6)

    def shape():
        x, y = 21 + rng.random() * 0.01, 52 + rng.random() * 0.01
        cut = sorted(rng.random() for _ in range(3))
        w, h = rng.random() * 0.02, rng.random() * 0.02
        return [(False, [(x, y), (x + w, y + h * cut[0]), (x + w * cut[2], y + h), (x + w * cut[1], y + h * cut[1]), (x, y)])]

    schema = "k int, rings " + polygon.TYPE
    a, b = (matching.with_shape(spark.createDataFrame([(i, shape()) for i in range(40)], schema).withColumn("rings", polygon.oriented(F.col("rings")))) for _ in range(2))
    b = b.withColumnRenamed("k", "o")
    pairs = a.select("k", F.col("y0").alias("_a")).crossJoin(b.select("o", F.col("y0").alias("_b"))).select("k", "o", F.least("_a", "_b").alias("base"))
    want = {(r.k, r.o): r.overlap for r in polygon.overlap_areas(pairs, a, b, "k", "o").collect()}
    rows = matching.coverage(a, b, "k", "o").collect()
    got = {(r.k, r.o): r.overlap for r in rows}
    assert len(got) == len(rows) > 500 and all(abs(v - want[p]) < 1e-12 for p, v in got.items())
    assert all(abs(v) < 1e-12 for p, v in want.items() if p not in got)


def test_equal_shapes_are_neighbours_by_key_and_met_once(spark):
    s = 2.0**-13
    at = lambda k, i, w=1.0: (k, 21 + i * s, 52.0, 21 + (i + w) * s, 52 + s)
    rows = [*(at(f"e{i:03}", 0) for i in range(200)), at("next", 1), at("far", 9), at("wide", 0, 2.0)]
    df = boxes(spark, rows)
    by_key = {r.k: r.neighbours for r in enrich.neighbours(df, df, "k", "k").collect()}
    by_middle = {r.k: r.neighbours for r in enrich.neighbours(df, df, "k").collect()}
    assert by_key == {f"e{i:03}": 201 for i in range(200)} | {"next": 201, "wide": 201}
    assert by_middle == {f"e{i:03}": 2 for i in range(200)} | {"next": 201, "wide": 201}
    shapes = matching.by_cell(df.select("rings", *matching.BOX)).select("rings").distinct().count()
    assert shapes == 4
    types = spark.createDataFrame([(1, "a", None, None, 0, "building=alone"), (1, "a", None, None, None, "building=row"), (2, "b", 2, None, None, "building=high")], "tier int, key string, min_levels int, max_levels int, max_neighbours int, tags string")
    told = df.filter("k IN ('e000', 'far', 'wide')").withColumn("code", F.when(F.col("k") != "wide", "a")).withColumn("levels", F.lit(2))
    out = enrich.tag_buildings(told, df, types, "k", [F.col("code"), F.lit("b")], "levels", F.lit(True), "s", "k")
    assert {r.k: r.type_tags for r in out.collect()} == {"e000": "building=row", "far": "building=alone", "wide": "building=high"}
