import struct

import pytest
from pyspark.sql import functions as F

from plumbline.functions import polygon
from plumbline.operators import change, enrich, matching, quality, reports, stats
from plumbline.sources import osm, registers
from plumbline.streaming import feed

# The projection's golden point (216691.39, 505645.69) and the sources' names below.
METRE = 1 / 111195.08  # degrees of latitude on the mean sphere


def addresses(spark, rows):
    return spark.createDataFrame(rows, "lokalny_id string, numer_porzadkowy string, ulica string, miejscowosc string, teryt_miejscowosc string, lon double, lat double")


@pytest.mark.parametrize(
    ("gov", "osm_row", "want"),
    [
        (("1", "A", "T"), ("1", "B", "U", 49.9), True), (("1", "A", "T"), ("1", "B", "U", 50.1), False), (("1", "A", "T"), ("1", " a ", "U", 149.9), True), (("1", "A", "T"), ("1", "A", "T", 150.1), False),
        (("1", None, "T"), ("1", None, "t", 149.0), True), (("1", None, None), ("1", None, None, 149.0), False), (("1", "", "T"), ("1", "", "X", 149.0), False), (("1", "A", "T"), ("1", None, "T", 149.0), False),
        ((None, "A", "T"), (None, "A", "T", 1.0), False), (("2 a", "A", "T"), ("2A", "B", "T", 10.0), True), (("1-3", "Old", "T"), ("1/3", "New", "X", 100.0), True), (("1", "Old", "T"), ("1", "Old", "X", 100.0), False),
    ],
)
def test_address_rule(spark, gov, osm_row, want):
    g = addresses(spark, [("k", gov[0], gov[1], gov[2], "1", 21.0, 52.0)])
    o = spark.createDataFrame([(21.0, 52.0 + osm_row[3] * METRE, *osm_row[:3])], "lon double, lat double, housenumber string, street string, city string")
    m = spark.createDataFrame([(None, "Old", "New"), ("2", "A", "Z")], "teryt_simc_code string, prg_street_name string, osm_street_name string")
    assert matching.matched_addresses(g, o, m).count() == int(want)


def boxes(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} string, x0 double, y0 double, x1 double, y1 double")
    return matching.with_shape(df.withColumn("rings", polygon.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))


def test_building_classes_balance(spark):
    s = 2.0**-14
    at = lambda i, w=1.0, dx=0.0: (21 + i * 2.0**-10 + dx * s, 52.0, 21 + i * 2.0**-10 + (dx + w) * s, 52 + s)
    gov = boxes(spark, [(f"b{i}", *at(i)) for i in range(6)], "key")
    live = boxes(spark, [("1", *at(0)), ("2", *at(1, 1, 0.95)), ("5", *at(4)), ("6", *at(5, 1, 1.0))], "osm_id")
    former = boxes(spark, [("3", *at(2, 0.2)), ("9", *at(4))], "osm_id")
    vetoes = spark.createDataFrame([("egib", "b3", "active"), ("egib", "b3", "active"), ("egib", "b5", "revoked"), ("egib", "b2", "active"), ("prg", "b1", "active")], "source string, record_key string, status string")
    got = {r.key: r["class"] for r in matching.building_classes(gov, live, former, vetoes, "egib", "key").collect()}
    assert got == {"b0": "matched", "b1": "unmatched", "b2": "suppressed", "b3": "reported", "b4": "matched", "b5": "unmatched"}
    assert matching.balance(matching.building_classes(gov, live, former, vetoes, "egib", "key")).agg(F.sum("n")).first()[0] == 6


def test_cells_recomputed_equal_whole(spark):
    g = addresses(spark, [(f"k{i}", str(i % 3), None, "T", "1", 21 + i * 0.004, 52.0) for i in range(40)])
    osm_rows = spark.createDataFrame([(21 + i * 0.004, 52.0 + 30 * METRE, str(i % 3), None, "T") for i in range(0, 40, 2)], "lon double, lat double, housenumber string, street string, city string")
    none = spark.createDataFrame([], "teryt_simc_code string, prg_street_name string, osm_street_name string")
    vetoes = spark.createDataFrame([], "source string, record_key string, status string")
    before = matching.unmatched_addresses(g, osm_rows.limit(3), none, vetoes)
    whole = matching.unmatched_addresses(g, osm_rows, none, vetoes)
    cells = matching.with_cell(g).select("cell_x", "cell_y").distinct()
    fresh = matching.unmatched_addresses(matching.with_cell(g).join(cells, ["cell_x", "cell_y"], "left_semi").drop("cell_x", "cell_y"), matching.around_cells(osm_rows, cells), none, vetoes)
    again = matching.recompute_cells(before, fresh, cells)
    assert sorted(r.lokalny_id for r in again.collect()) == sorted(r.lokalny_id for r in whole.collect()) != []
    totals = matching.cell_totals(matching.with_cell(g), "prg")
    assert sorted(map(tuple, matching.totals_for_cells(totals, matching.with_cell(g), "prg", cells).collect())) == sorted(map(tuple, totals.collect()))


def test_diff(spark):
    live = spark.createDataFrame([(1, "x", None), (2, None, "x"), (3, "a", "b"), (4, "g", "h")], "k int, a string, b string")
    new = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (4, "g", "i"), (5, "n", "n")], "k int, a string, b string")
    found = change.diff(live, new, ["k"], ["a", "b"])
    assert {(r.k, r.kind) for r in found.collect()} == {(1, "modified"), (3, "removed"), (4, "modified"), (5, "added")}
    assert {r.k for r in change.changed(live, new, ["k"], ["a", "b"]).collect()} == {1, 4}
    assert sorted(map(str, change.apply_delta(live, new, found, ["k"]).collect())) == sorted(map(str, new.collect()))
    assert change.diff(new, change.apply_delta(live, new, found, ["k"]), ["k"], ["a", "b"]).count() == 0
    with pytest.raises(quality.Refused):
        change.refresh(live, new.limit(0), ["k"], ["a", "b"])
    with pytest.raises(quality.Refused):
        change.refresh(live, new.withColumn("c", F.lit(1)), ["k"], ["a", "b"])


def test_tolerant_diff(spark):
    def table(shifts):
        df = spark.createDataFrame([(i, "x", 21.0 + dx, 52.0 + dy) for i, (dx, dy) in enumerate(shifts)], "k int, a string, x double, y double")
        return df.select("k", "a", polygon.box(F.col("x"), F.col("y"), F.col("x") + 2.0**-12, F.col("y") + 2.0**-12).alias("rings"))

    live = table([(0, 0)] * 5)
    new = table([(0, 0), (2.0**-25, 0), (2.0**-27, 0), (0, 2.0**-23), (0, 2.0**-22)])
    got = change.diff_tolerant(live, new, ["k"], ["a"], 0.02).collect()
    assert [(r.k, r.kind) for r in got] == [(4, "modified")]


def test_load_rules(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "q"), ("b", 0, "w"), ("c", 1, "m"), ("c", 1, "l")], "k string, v int, t string")
    kept = quality.dedupe_by_key(quality.require_keys(rows, ["k"]), ["k"], "v", F.col("t"))
    assert sorted((r.k, r.t) for r in kept.collect()) == [("a", "y"), ("b", "w"), ("c", "l")]
    assert quality.count_null_keys(rows, ["k"]).first().null_keys == 1
    types = spark.createDataFrame([(1, "m", 1, 2, 0, "building=detached"), (3, "", 4, 2, -1, "oops"), (1, "g", None, None, 2, "building=x"), (1, "m", 1, 2, 0, "building=house")], "tier int, key string, min_levels int, max_levels int, max_neighbours int, tags string")
    assert {r.rule: r.n for r in quality.type_violations(types, "m").collect()} == {"tier": 1, "key": 1, "tags": 1, "levels": 1, "neighbours": 2, "tie": 1}
    areas = spark.createDataFrame([("20,50,20.1,50.1",), ("20,50,19,51",), ("1,2,3",), ("20,50,22,52",), ('{"type":"Polygon","coordinates":[[[20,50],[20.1,50],[20.1,50.1],[20,50]]]}',), ('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[20,50],[200,50],[20.1,50.1],[20,50]]]}}',), (None,)], "text string")
    assert [r.problem for r in quality.parse_areas(areas).collect()] == [None, "degenerate", "unreadable", "too large", None, "out of range", "unreadable"]


def test_wkb(spark):
    def poly(order, rings):
        body = b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "2d", *p) for p in r) for r in rings)
        return struct.pack("B", order == "<") + struct.pack(order + "II", 3, len(rings)) + body

    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    multi = struct.pack("<BII", 1, 6, 2) + poly("<", [outer]) + poly(">", [outer, hole])
    df = spark.createDataFrame([(1, bytearray(poly(">", [outer, hole]))), (2, bytearray(multi)), (3, None), (4, bytearray(struct.pack("<BI2d", 1, 1, 0, 0)))], "k int, g binary")
    got = {r.k: r.rings for r in registers.decode_wkb(df, "g").collect()}
    assert [len(r.pts) for r in got[1]] == [5, 4] and [r.hole for r in got[2]] == [False, False, True] and got[3] is None and got[4] is None


def test_xml_sources(spark, tmp_path):
    (tmp_path / "a.osc").write_text('<osmChange><modify><node id="1" version="2" lat="52.0" lon="21.0"><tag k="addr:housenumber" v="1A"/></node><way id="7" version="3"><nd ref="1"/><nd ref="2"/><tag k="building" v="yes"/></way></modify><delete><node id="2" version="4" lat="0" lon="0"/></delete><create><relation id="9" version="1"><member type="way" ref="7" role="outer"/></relation></create></osmChange>')
    got = {(r.kind, r.action, r.id): r for r in osm.read_changes(spark, str(tmp_path / "a.osc")).collect()}
    assert set(got) == {("node", "modify", 1), ("way", "modify", 7), ("node", "delete", 2), ("relation", "create", 9)}
    assert got["way", "modify", 7].refs == [1, 2] and got["node", "modify", 1].tags == {"addr:housenumber": "1A"} and got["relation", "create", 9].members[0].role == "outer"
    (tmp_path / "s").mkdir()
    for n in (4, 6):
        (tmp_path / "s" / f"{n}.txt").write_text(f"#x\nsequenceNumber={n}\ntimestamp=2024-01-0{n}T01\\:02\\:03Z\n")
    manifest = osm.sequence_manifest(spark, str(tmp_path / "s"))
    assert [r.sequence for r in osm.sequence_gaps(manifest).collect()] == [5] and manifest.filter("timestamp IS NULL").count() == 0
    (tmp_path / "p.gml").write_text("<l><adres><lokalnyId>k1</lokalnyId><numerPorzadkowy>1A</numerPorzadkowy><ulica>ul. Nowa</ulica><terytGmina>77</terytGmina><pos>216691.39 505645.69</pos></adres></l>")
    units = spark.createDataFrame([("77", "G")], "code string, name string")
    r = registers.build_prg(registers.read_prg_gml(spark, str(tmp_path / "p.gml"), units)).first()
    assert (r.ulica, r.gmina, r.numer_porzadkowy) == ("Nowa", "G", "1A") and abs(r.lon - 14.839103470789498) < 1e-9


def test_elements(spark):
    at = {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (0, 1), 5: (0.2, 0.2), 6: (0.4, 0.2), 7: (0.4, 0.4)}
    rows = [("node", i, {"addr:housenumber": "5", "addr:place": "P"} if i == 1 else {}, x + 0.0, y + 0.0, None, None, None) for i, (x, y) in at.items()]
    rows += [("way", 10, {"building": "yes", "addr:housenumber": "7"}, None, None, [1, 2, 3, 4, 1], None, None), ("way", 11, {}, None, None, [5, 6, 7, 5], None, None), ("way", 12, {"building": "yes"}, None, None, [1, 2, 99, 1], None, None), ("way", 13, {"ruins:building": "yes"}, None, None, [1, 2, 3, 1], None, None)]
    rows += [("relation", 20, {"building": "school"}, None, None, [10, 11], ["way", "way"], ["outer", "inner"]), ("relation", 21, {"building": "yes"}, None, None, [10, 12], ["way", "way"], ["", "outer"])]
    e = spark.createDataFrame(rows, "kind string, id long, tags map<string,string>, lon double, lat double, refs array<long>, ref_types array<string>, ref_roles array<string>")
    assert [r.osm_id for r in osm.way_buildings(e).collect()] == [10] and [(r.osm_id, r.lifecycle) for r in osm.way_buildings(e, former=True).collect()] == [(13, "ruins:building")]
    assert [(r.osm_id, r.city) for r in osm.address_nodes(e).collect()] == [(1, "P")]
    r = osm.way_addresses(e).first()
    assert (r.osm_id, r.lon, r.lat) == (10, 0.5, 0.5)
    got = {r.osm_id: r for r in osm.relation_buildings(e).withColumn("a", polygon.area(F.col("rings"))).collect()}
    assert abs(got[20].a - 0.98) < 1e-12 and not got[20].doubtful and got[21].doubtful
    sides = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [3, 1]), (1, 3, [3, 1, 9])], "rel long, way long, refs array<long>")
    assert {(r.a, r.b) for r in osm.area_edges(sides).collect()} == {(1, 2), (2, 3), (1, 9)}


def test_reports_round_trip(spark):
    df = spark.createDataFrame([(1, "prg", "a", "active", "2024-01-01"), (2, "prg", "b", "revoked", "2024-01-02")], "report_id long, source string, record_key string, status string, created_at string")
    lines = reports.export_lines(df)
    back = reports.import_lines(lines, df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), df)
    assert sorted((r.report_id, r.record_key) for r in back.collect()) == [(3, "a"), (4, "b")]
    assert [r.status for r in reports.revoke(df, F.col("report_id") <= 2).orderBy("report_id").collect()] == ["revoked", "revoked"]
    assert [r.report_id for r in reports.listed(df, source="prg", limit=1).collect()] == [2]


def test_ranking_rules(spark):
    rows = spark.createDataFrame([("14" + str(i % 4),) for i in range(20)], "code string")
    assert stats.rank_areas(rows, rows.limit(0), ["code"], sort="total", page=2, per_page=3).count() == 1
    with pytest.raises(ValueError, match="prefix"):
        stats.rank_areas(rows, rows, ["code"], within="1")


def test_mapping_sets(spark):
    kind = "teryt_simc_code string, prg_street_name string, osm_street_name string"
    a = spark.createDataFrame([(None, "A", "B"), ("1", "C", None)], kind)
    assert enrich.symmetric_difference(a, a).count() == 0 and enrich.symmetric_difference(a, a.limit(1)).count() == 1
    feature = enrich.geojson(spark.createDataFrame([(21.0, 52.0, {"b": "2", "a": "1"})], "lon double, lat double, tags map<string,string>")).first().feature
    assert feature == '{"type":"Feature","geometry":{"type":"Point","coordinates":[21.0,52.0]},"properties":{"a":"1","b":"2"}}'


def test_streams(spark, tmp_path):
    kind = "kind string, id long, version long, part long, action string, lon double"
    batches = [[("node", 1, 1, 1, "create", 1.0), ("node", 2, 3, 2, "modify", 2.0)], [("node", 1, 3, 3, "modify", 3.0), ("node", 1, 2, 4, "modify", 9.0), ("node", 2, 1, 5, "delete", 9.0)], [("node", 1, 4, 6, "delete", 0.0)]]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    every = []
    for i, rows in enumerate(batches):
        every += rows
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        q = feed.start_apply(stream, str(tmp_path / "state"), str(tmp_path / "check"))
        q.awaitTermination()
        assert q.exception() is None
        live = {(r.id, r.version, r.lon) for r in spark.read.parquet(str(tmp_path / "state" / f"v{i + 1}")).collect()}
        assert live == [{(1, 1, 1.0), (2, 3, 2.0)}, {(1, 3, 3.0), (2, 3, 2.0)}, {(2, 3, 2.0)}][i]
    seen = []
    q = feed.latest_versions(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in seen:
        assert (r.version, r.part) > last.get(r.id, (0, 0))
        last[r.id] = (r.version, r.part)
    assert last == {1: (4, 6), 2: (3, 2)}


def test_queue(spark):
    q = spark.createDataFrame([("egib", 1, 1, 1), ("egib", 1, 1, 9), ("egib", 2, 2, 2), ("egib", 3, 3, 3), ("odd", 1, 1, 1)], "source string, cell_x int, cell_y int, enqueued_at int")
    taken, left = feed.drain(q, ["egib"], F.lit(5), 2)
    assert {r.cell_x for r in taken.collect()} == {1, 2} and {(r.cell_x, r.enqueued_at) for r in left.collect()} == {(1, 9), (3, 3)}
    assert feed.chunks([1, 2, 3], 2) == [[1, 2], [3]]


def test_nearest_building_by_footprint(spark):
    """A point in a large L, beside its inner corner, near a hole, and beyond the radius; against plain geometry."""
    import math

    from plumbline.operators import enrich

    d = 1 / 4096
    shape = lambda pts, hole=False: (hole, [*[(16 + x * d, 50 + y * d) for x, y in pts], (16 + pts[0][0] * d, 50 + pts[0][1] * d)])
    bends = [shape([(0, 0), (8, 0), (8, 1), (1, 1), (1, 8), (0, 8)])]
    ring = [shape([(20, 0), (24, 0), (24, 4), (20, 4)]), shape([(21, 1), (21, 3), (23, 3), (23, 1)], True)]
    rows = [("L", bends), ("ring", ring), ("also", ring)]
    df = spark.createDataFrame(rows, "key string, rings array<struct<hole:boolean,pts:array<struct<x:double,y:double>>>>")
    buildings = matching.with_shape(df, parts=("box",))
    spots = {1: (0.5, 7.5), 2: (1.2, 1.3), 3: (22, 2.9), 4: (40, 40), 5: (7.9, 1.1), 6: (22, 0.5)}
    points = spark.createDataFrame([(k, 16 + x * d, 50 + y * d) for k, (x, y) in spots.items()], "p int, lon double, lat double")
    got = {r.p: (r.key, r.metres) for r in enrich.nearest_building(points, buildings, "p", "key", 30.0).collect()}
    lat = math.radians(50 + d)
    ky, kx = 111132.92 - 559.82 * math.cos(2 * lat) + 1.175 * math.cos(4 * lat), 111412.84 * math.cos(lat) - 93.5 * math.cos(3 * lat) + 0.118 * math.cos(5 * lat)
    assert got[1] == ("L", 0.0) and 4 not in got and got[6] == ("also", 0.0)
    assert got[2][0] == "L" and abs(got[2][1] - min(0.2 * d * kx, 0.3 * d * ky)) < 0.05
    assert got[3][0] == "also" and abs(got[3][1] - 0.1 * d * ky) < 0.05 and abs(got[5][1] - 0.1 * d * ky) < 0.05
    assert not enrich.nearest_building(points.filter("p = 5"), buildings, "p", "key", 2.0).collect()


def test_refresh_with_reports_and_history(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import change

    live = spark.createDataFrame([(i, "a") for i in range(10)], "k long, a string")
    staging = spark.createDataFrame([(i, "b" if i == 3 else "a") for i in range(2, 12)], "k long, a string")
    reports = spark.createDataFrame([(1, "egib", "3", "active", "s3"), (2, "egib", "5", "active", "s5"), (3, "prg", "3", "active", "x"), (4, "egib", "1", "active", "s1")], "report_id long, source string, record_key string, status string, signature string")
    signed = staging.select(F.col("k").cast("string").alias("record_key"), F.concat(F.when(F.col("a") == "b", "new").otherwise("s"), "k").alias("signature"))
    done = change.refresh(live, staging, ["k"], ["a"], reports, "egib", signed, "etag", F.lit("now"))
    assert {r.report_id: r.status for r in done["reports"].collect()} == {1: "expired", 2: "active", 3: "active", 4: "expired"}
    (h,) = done["history"].collect()
    assert (h.added, h.modified, h.removed, h.warned, h.etag, h.applied_at) == (2, 1, 2, False, "etag", "now")


def ring(*pts, hole=False):
    return (hole, [(float(x), float(y)) for x, y in pts])


SHAPE = "id string, rings array<struct<hole:boolean,pts:array<struct<x:double,y:double>>>>"


def test_area_geometry(spark):
    rows = [("ok", [ring((0, 0), (1, 0), (1, 1), (0, 0))]), ("null", None), ("line", [ring((0, 0), (1, 1), (2, 2), (0, 0))]), ("mended", [ring((0, 0), (1, 0), (1, 1), (0, 0)), ring((5, 5), (6, 6), (7, 7), (5, 5))])]
    got = {r.id: r.geometry_problem for r in quality.check_area_geometry(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {"ok": None, "null": "unreadable", "line": "degenerate", "mended": None}
    assert quality.check_area_geometry(spark.createDataFrame([], SHAPE)).count() == 0


def test_page_beyond_the_last(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "code string")
    page = lambda n: [tuple(r) for r in stats.rank_areas(rows, rows.limit(1), ["code"], sort="total", page=n, per_page=1, total_items=True).collect()]
    assert page(1) == [("a", 2, 1, 0.5, 2)] and page(3) == [(None, None, None, None, 2)]


def test_recent_exports(spark):
    areas = spark.createDataFrame([("p", [ring((0, 0), (1, 0), (1, 1), (0, 0))]), ("q", None)], SHAPE).withColumnRenamed("id", "area")
    found = spark.createDataFrame([("p",), ("p",)], "area string")
    log = enrich.export_log(areas, found, found.limit(0), "area", ["prg"], F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert sorted((r.area, r.address_count, r.building_count) for r in log.collect()) == [("p", 2, 0), ("q", 0, 0)]
    at = lambda minutes: enrich.recent_exports(log, F.lit("2024-01-01 10:10:00").cast("timestamp"), minutes).count()
    assert at(10) == 2 and at(9) == 0
    for wrong in (0, 1441):
        with pytest.raises(ValueError):
            at(wrong)


def test_layer_pads_and_flags(spark):
    a, b = spark.createDataFrame([("1", "m"), ("2", None)], "id string, kind string"), spark.createDataFrame([("1", 3)], "code string, storeys int")
    reports_ = spark.createDataFrame([("x", "1", "active"), ("y", "1", "revoked")], "source string, record_key string, status string")
    got = {(r.source, r.key): (r.reported, r.kind, r.storeys) for r in matching.building_layer({"x": (a, "id"), "y": (b, "code")}, reports_).collect()}
    assert got == {("x", "1"): (True, "m", None), ("x", "2"): (False, None, None), ("y", "1"): (False, None, 3)}


def test_freshness_names_every_source(spark):
    queue = spark.createDataFrame([("a", 1, 2, 5)], "source string, cell_x int, cell_y int, enqueued_at long")
    runs = spark.createDataFrame([("b", 1, "failed"), ("b", 2, "done")], "source string, run_id int, outcome string")
    stamps = spark.sql("SELECT 'c' AS source, TIMESTAMP '2024-01-01 00:00:00' AS stamped_at")
    got = {r.source: (r.cells, r.oldest, r.outcome, r.lag_seconds) for r in stats.freshness(queue, runs, stamps, F.lit("2024-01-01 00:01:00").cast("timestamp")).collect()}
    assert got == {"a": (1, 5, None, None), "b": (0, None, "done", None), "c": (0, None, None, 60)}


def test_rows_without_key_stay(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), ("k", None, "b"), ("k", 2, "c"), ("k", 2, "d")], "k string, v int, t string")
    got = [tuple(r) for r in quality.dedupe_by_key(rows, ["k"], "v", F.col("t")).collect()]
    assert sorted(got, key=str) == [("k", 2, "c"), (None, 1, "a"), (None, 1, "a")]
