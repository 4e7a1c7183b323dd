import pytest
from pyspark.sql import functions as F

from plumbline.functions import polygon, text
from plumbline.operators import change, current, matching, quality
from plumbline.sources.store import Store, names


@pytest.fixture
def noon_(spark):
    return F.lit("2024-01-01").cast("timestamp")


SPEC = current.Register("bdot10k", ["ns", "id"], ["a"])


def snapshot(spark, rows):
    return spark.createDataFrame([(n, i, a, x, 7) for n, i, a, x in rows], "ns string, id long, a string, cell_x int, cell_y int")


def test_refresh_is_one_commit(spark, tmp_path, monkeypatch, noon_):
    noon = noon_
    store = Store(spark, str(tmp_path / "s"))
    first = [("n", i, "a", i % 4) for i in range(200)]
    assert current.refresh(store, SPEC, snapshot(spark, first), noon, "e1", blocks=32) == 1
    key = lambda i, *more: {"ns": "n", "id": str(i)} | dict(more)
    targets = [(1, "bdot10k", key(1)), (1, "bdot10k", key(2)), (1, "bdot10k", key(1)), (1, "bdot10k", key(999)), (1, "bdot10k", {"id": "3"}), (1, "bdot10k", key(3, ("x", "y"))), (1, "bdot10k", {"ns": " ", "id": "3"}), (1, "other", key(3)), *[(2, "bdot10k", key(i)) for i in range(6)]]
    asked = spark.createDataFrame(targets, "request int, source string, key map<string,string>")
    got = current.add_reports(store, asked, {"bdot10k": SPEC}, noon, most=10)
    by = [(r.request, r.record_key, r.problem) for r in got.collect() if r.request == 1]
    assert sorted(p or "" for _, _, p in by) == ["", "", "", "empty key column", "not found", "unknown source", "wrong key columns", "wrong key columns"]
    assert store.read("reports").count() == 6 and sorted(r.report_id for r in store.read("reports").collect()) == [1, 2, 3, 4, 5, 6]
    assert current.check_targets(asked, {"bdot10k": SPEC}, most=5).filter("problem = 'too many'").count() == 14
    staged = [("n", i, "b" if i == 1 else "a", i % 4 if i != 5 else 9) for i in range(199) if i != 2] + [("n", 500, "a", 2)]
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="power"):
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("power")))
        current.refresh(store, SPEC, snapshot(spark, staged), noon, "e2")
    assert store.read("register_bdot10k").count() == 200 and store.read("refreshes").count() == 1 and store.read("reports").filter("status = 'active'").count() == 6
    before = store.manifest()["tables"]["register_bdot10k"]["blocks"]
    assert current.refresh(store, SPEC, snapshot(spark, staged), noon, "e2") == 2
    # the same as the plain operators
    live, now = snapshot(spark, first), snapshot(spark, staged)
    found = change.diff(live, now, SPEC.keys, SPEC.compared)
    want = sorted(map(tuple, change.apply_delta(live, now, found, SPEC.keys).collect()))
    assert sorted(map(tuple, store.read("register_bdot10k").collect())) == want
    assert [(r.snapshot_id, r.etag, r.added, r.modified, r.removed, r.warned) for r in store.read("refreshes").orderBy("snapshot_id").collect()] == [(1, "e1", 200, 0, 0, False), (2, "e2", 1, 1, 2, False)]
    assert {(r.cell_x, r.added, r.modified, r.removed) for r in store.read("change_areas").filter("snapshot_id = 2").collect()} == {(1, 0, 1, 0), (2, 1, 0, 1), (3, 0, 0, 1)}
    assert {tuple(r.record_key): r.status for r in store.read("reports").collect()} == {("n", "0"): "active", ("n", "1"): "expired", ("n", "2"): "expired", ("n", "3"): "active", ("n", "4"): "active", ("n", "5"): "active"}
    after = store.manifest()["tables"]["register_bdot10k"]["blocks"]
    changed = set(names(found, current.key_block(SPEC.keys, 32)))
    assert {b for b in after if after[b] != before.get(b)} <= changed and len(changed) <= 4
    # unchanged etag: a row of zeros and nothing loaded
    assert current.refresh(store, SPEC, lambda: pytest.fail("loaded"), noon, "e2") == 3
    assert tuple(store.read("refreshes").filter("snapshot_id = 3").select("added", "modified", "removed").first()) == (0, 0, 0) and current.last_etag(store, "bdot10k") == "e2"
    with pytest.raises(quality.Refused):
        current.refresh(store, SPEC, snapshot(spark, []), noon, "e3")
    with pytest.raises(quality.Refused):
        current.refresh(store, SPEC, snapshot(spark, staged).drop("a"), noon, "e3")
    current.revoke_reports(store, F.col("report_id") <= 4, noon)
    assert store.read("reports").filter("status = 'revoked'").count() == 2 and store.latest() == 5


def test_drained_cells_equal_a_full_run(spark, tmp_path, noon_):
    noon = noon_
    def boxes(rows, key):
        df = spark.createDataFrame(rows, f"{key} string, x0 double, y0 double, x1 double, y1 double")
        return matching.with_shape(df.withColumn("rings", polygon.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))

    s = 2.0**-14
    at = lambda i, w=1.0, dx=0.0: (21 + i * 2.0**-7 + dx * s, 52.0, 21 + i * 2.0**-7 + (dx + w) * s, 52 + s)
    gov = matching.with_cell(boxes([(f"b{i}", *at(i)) for i in range(40)], "id_budynku"), "cx", "cy")
    old_map, new_map = boxes([(str(i), *at(i)) for i in range(0, 40, 2)], "osm_id"), boxes([(str(i), *at(i, 1, 0.3)) for i in range(0, 40, 3)], "osm_id")
    former = boxes([("f", *at(1))], "osm_id")
    vetoes = spark.createDataFrame([("egib", "b5", "active"), ("prg", "k5", "active")], "source string, record_key string, status string")
    homes = matching.with_cell(spark.createDataFrame([(f"k{i}", str(i % 3), None, "T", "1", 21 + i * 0.004, 52.0) for i in range(60)], "lokalny_id string, numer_porzadkowy string, ulica string, miejscowosc string, teryt_miejscowosc string, lon double, lat double"))
    places = lambda k: spark.createDataFrame([(21 + i * 0.004, 52.0002, str(i % 3), None, "T") for i in range(0, 60, k)], "lon double, lat double, housenumber string, street string, city string")
    none = spark.createDataFrame([], "teryt_simc_code string, prg_street_name string, osm_street_name string")
    store = Store(spark, str(tmp_path / "s"))
    queue = gov.select(F.lit("egib").alias("source"), *current.CELL).union(homes.select(F.lit("prg"), *current.CELL)).union(spark.createDataFrame([("gone", 1, 1)], "source string, x int, y int")).withColumn("enqueued_at", noon)
    from plumbline.sources.store import added

    store.commit({"queue": added(queue)})
    make = lambda buildings, k: {"egib": current.buildings_of_cells(gov, buildings, former, vetoes, "egib", "id_budynku"), "prg": current.addresses_of_cells(homes, places(k), none, vetoes)}
    later = F.lit("2024-01-02").cast("timestamp")
    assert current.drained(store, make(old_map, 2), later, 1000) > 10 and store.read("queue").count() == 0
    full = lambda buildings, k: (matching.building_classes(gov, buildings, former, vetoes, "egib", "id_budynku").filter("class = 'unmatched'").select("id_budynku"), matching.unmatched_addresses(homes.drop(*current.CELL), places(k), none, vetoes).select("lokalny_id"))
    ids = lambda df: sorted(r[0] for r in df.collect())
    for table, key, want in zip(("unmatched_egib", "unmatched_prg"), ("id_budynku", "lokalny_id"), full(old_map, 2), strict=True):
        assert ids(store.read(table).select(key)) == ids(want) != []
    # only some cells are queued again: they follow the new map, others keep their rows and files
    some = gov.filter("id_budynku IN ('b0', 'b2', 'b3')").select(F.lit("egib").alias("source"), *current.CELL).distinct()
    store.commit({"queue": added(some.withColumn("enqueued_at", noon).union(some.limit(1).withColumn("enqueued_at", F.lit("2024-03-01").cast("timestamp"))))})
    before = store.manifest()["tables"]
    assert current.drained(store, make(new_map, 3), later, 1000) == some.count() and store.read("queue").count() == 1
    new = set(ids(full(new_map, 3)[0].join(gov, "id_budynku").join(some, current.CELL, "left_semi").select("id_budynku")))
    kept = set(ids(full(old_map, 2)[0].join(gov, "id_budynku").join(some, current.CELL, "left_anti").select("id_budynku")))
    assert set(ids(store.read("unmatched_egib").select("id_budynku"))) == new | kept
    after = store.manifest()["tables"]
    touched = set(names(some, current.cell_block()))
    assert {b: f for b, f in after["unmatched_egib"]["blocks"].items() if b not in touched} == {b: f for b, f in before["unmatched_egib"]["blocks"].items() if b not in touched} != {}
    assert after["unmatched_prg"] == before["unmatched_prg"] and store.read("totals_egib").agg(F.sum("total")).first()[0] == 40


def test_ids_follow_in_order(spark):
    new = spark.createDataFrame([(None, f"k{i:03d}") for i in range(100)], "report_id long, record_key string").repartition(7)
    old = spark.createDataFrame([(41, "x")], "report_id long, record_key string")
    assert [r.record_key for r in change.next_ids(old, new, "report_id", ["record_key"]).orderBy("report_id").collect()] == [f"k{i:03d}" for i in range(100)]
    assert change.next_ids(old, new, "report_id", ["record_key"]).agg(F.min("report_id"), F.max("report_id")).first() == (42, 141)


def test_building_tags_keep_the_mapping_s_levels(spark):
    df = spark.createDataFrame([("building=house;building:levels=2", None), ("building=house;building:levels=2", 3), (None, 0)], "t string, n int")
    got = [r.x for r in df.select(text.building_tags(text.parse_tags(F.col("t")), F.col("n"), "s").alias("x")).collect()]
    assert got == [{"building": "house", "building:levels": "2", "source:building": "s"}, {"building": "house", "building:levels": "3", "source:building": "s"}, {"building": "yes", "source:building": "s"}]
