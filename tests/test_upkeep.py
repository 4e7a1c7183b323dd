import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import polygon
from plumbline.operators import arrangement
from plumbline.sources import osm
from plumbline.sources.store import Conflict, Part, Store, added, names
from plumbline.streaming import upkeep

SCHEMAS = {"nodes": "id long, version long, lon double, lat double, tags map<string,string>", "ways": "id long, version long, refs array<long>, tags map<string,string>", "relations": f"id long, version long, members {osm.MEMBERS}, tags map<string,string>"}
CHANGE = f"kind string, action string, id long, version long, part long, lon double, lat double, refs array<long>, members {osm.MEMBERS}, tags map<string,string>"


def test_store_shows_whole_versions_only(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.range(100).withColumn("v", F.lit(1))
    block = (F.col("id") % 5).cast("string")
    assert store.latest() == 0 and store.commit({"t": Part(df, block), "log": added(df.limit(1))}, {"etag": "a"}) == 1
    assert store.commit({"t": Part(df.filter("id % 5 = 2").withColumn("v", F.lit(2)), block, ["2", "3"]), "log": added(df.limit(2))}) == 2
    assert store.read("t").groupBy("v").count().orderBy("v").collect() == [(1, 60), (2, 20)] and store.read("log").count() == 3
    assert store.read("t", version=1).count() == 100 and store.read("t", ["2", "3", "9"]).count() == 20 and store.read("t", []).count() == 0
    assert store.manifest()["note"] == {"etag": "a"} and names(df, block) == ["0", "1", "2", "3", "4"]
    before = store.manifest()["tables"]["t"]["blocks"]
    assert {b: f.split("/")[0] for b, f in before.items()} == {"0": "v1", "1": "v1", "2": "v2", "4": "v1"}
    # a commit that fails between its tables, or before its manifest, shows nothing
    broken = df.withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit(3)).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"log": added(df), "t": Part(broken, block)})
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="power"):
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("power")))
        store.commit({"t": Part(df.limit(3), block)})
    assert store.latest() == 2 and store.read("t").count() == 80 and store.read("log").count() == 3
    assert store.commit({"t": Part(df.limit(0), block, ["0"])}) == 3 and store.read("t").count() == 60
    with pytest.raises(Conflict):
        store._publish(3, {})
    assert store.vacuum(keep=1) >= 2 and store.read("t").count() == 60 and store.read("log").count() == 3


def _inside(ring, x, y):
    out = np.zeros(x.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def test_arrangement_against_a_raster(spark):
    rng = random.Random(3)

    def star(k):
        x, y, r = rng.uniform(0, 8), rng.uniform(0, 8), rng.uniform(1, 5)
        p = [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / k), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)]
        return [*p, p[0]]

    def box(x, y, w, h):
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]

    some = lambda: box(rng.randint(0, 5), rng.randint(0, 5), rng.randint(1, 5), rng.randint(1, 5))
    cases = {k: [(False, star(rng.randint(3, 14))) for _ in range(rng.randint(1, 4))] + [(True, star(rng.randint(3, 8))) for _ in range(rng.randint(0, 2))] for k in range(12)}
    cases |= {k: [(False, some()) for _ in range(rng.randint(1, 4))] + [(True, some()) for _ in range(rng.randint(0, 2))] for k in range(20, 40)}
    cases |= {100: [(False, [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])], 101: [(False, box(0, 0, 1, 1)), (False, box(1, 1, 1, 1))], 102: [(False, box(0, 0, 1, 1)), (False, box(1, 0, 1, 1))], 103: [(False, box(0, 0, 1, 1)), (True, box(0, 0, 1, 1))]}
    df = spark.createDataFrame([(k, [(h, [(float(x), float(y)) for x, y in r]) for h, r in v]) for k, v in cases.items()], "k int, rings " + polygon.TYPE)
    at = (np.arange(1000) + 0.5) / 1000 * 20 - 6
    x, y = np.meshgrid(at, at)
    for rule in ("union", "even_odd"):
        got = {r.key: r.rings for r in arrangement.shaped(arrangement.sides(df, "k"), rule).collect()}
        for k, v in cases.items():
            masks = [(h, _inside(r, x, y)) for h, r in v]
            if rule == "union":
                want = np.any([m for h, m in masks if not h], axis=0) & ~np.any([m for h, m in masks if h] or [np.zeros(x.shape, bool)], axis=0)
            else:
                want = np.logical_xor.reduce([m for _, m in masks])
            mine = np.zeros(x.shape, bool)
            for r in got.get(k, []):
                p = [(q.x, q.y) for q in r.pts]
                mine ^= _inside(p, x, y)
                assert (sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:], strict=False)) < 0) == r.hole
            assert (mine ^ want).sum() <= 3
        assert 103 not in got
    assert sorted(len(r.pts) for r in got[100]) == [4, 4] and sorted(len(r.pts) for r in got[101]) == [5, 5] and len(got[102]) == 1


def test_repair_with_counts(spark):
    bow, good, flat = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (1, 0), (2, 0), (0, 0)]
    df = spark.createDataFrame([(k, None if r is None else [(False, [(float(a), float(b)) for a, b in r])]) for k, r in enumerate([bow, good, flat, None])], "k int, rings " + polygon.TYPE)
    out, counts = arrangement.repaired(df, "k")
    got = {r.k: r for r in out.withColumn("a", polygon.area(F.col("rings"))).collect()}
    assert set(got) == {0, 1, 3} and got[0].a == 2.0 and len(got[0].rings) == 2 and got[1].a == 0.5 and got[3].rings is None
    assert tuple(counts.first()) == (4, 1, 1)
    same, counts = arrangement.repaired(df.filter("k = 1"), "k")
    assert same.count() == 1 and tuple(counts.first()) == (1, 0, 0)


def test_relation_areas(spark):
    n = 1_000
    rng = random.Random(4)
    nodes = [(i, 0, math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n), {}) for i in range(n)] + [(20_000 + i, 0, x, y, {}) for i, (x, y) in enumerate([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)])]
    ways = [(i, 0, [i, (i + 1) % n] if rng.random() < 0.5 else [(i + 1) % n, i], {}) for i in range(n)] + [(20_000, 0, [20_000, 20_001, 20_002], {}), (20_001, 0, [20_000, 20_003, 20_002], {}), (20_002, 0, [20_000, 777_777, 20_001, 20_000], {}), (20_003, 0, [20_000, 20_001, 20_000], {}), (20_004, 0, [5], {})]
    order = list(range(n))
    rng.shuffle(order)
    m = lambda ids, role="outer": [("way", i, role) for i in ids]
    relations = [(1, 0, m(order) + m([20_000, 20_001], "inner") + m([20_000]) + m([3], "other"), {}), (2, 0, [("node", 1, "outer"), ("way", 1, "label")], {}), (3, 0, m([20_000, *range(90_000, 90_015)]), {}), (4, 0, m([20_000, 20_004]), {}), (5, 0, m([20_002]), {}), (6, 0, m([20_003]), {})]
    e = upkeep._elements(*(spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in (("nodes", nodes), ("ways", ways), ("relations", relations))))
    got = {r.rel: r for r in osm.relation_areas(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 7)], "rel long"), e).withColumn("a", polygon.area(F.col("rings"))).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: None, 2: "no ways", 3: "missing ways", 4: "open rings", 5: "missing nodes", 6: "no area", 7: "not found"}
    assert abs(got[1].a - (n / 2 * math.sin(2 * math.pi / n) - 1)) < 1e-9 and sorted((r.hole, len(r.pts)) for r in got[1].rings) == [(False, n + 1), (True, 5)] and abs(got[1].x1 - 1) < 1e-6
    assert got[3].n_ids == 15 and got[3].ids == list(range(90_000, 90_010)) and got[3].message.endswith("way/90009 and 5 more)")
    assert got[4].ids == [20_000, 20_002] and got[5].message == "relation 5: missing nodes (node/777777)" and got[7].message == "relation 7: not found"


def _map(rng):
    """A grid of squares of four nodes, some with relations around them."""
    nodes, ways, relations = {}, {}, {}
    for k in range(60):
        x, y = 20 + (k % 10) * 0.004, 50 + (k // 10) * 0.004
        for j, (dx, dy) in enumerate([(0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001)]):
            nodes[4 * k + j] = (x + dx, y + dy, {"addr:housenumber": str(k), "addr:postcode": "00-001"} if j == 0 and k % 3 == 0 else {})
        tags = [{"building": "yes"}, {"building": "house", "addr:housenumber": f"{k}A"}, {"ruins:building": "barn"}, {}][k % 4]
        ways[k] = ([4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3, 4 * k], tags)
    for k in range(12):
        a, b = rng.sample(range(60), 2)
        relations[k] = ([("way", a, "outer"), ("way", b, ["outer", "inner"][k % 2]), ("node", 1, "")], [{"building": "school"}, {"addr:housenumber": "R", "building": "yes"}, {"was:building": "x"}][k % 3])
    return nodes, ways, relations


def _edited(rng, state, versions, step):
    """Random edits of a state in place; the changes that say so, as rows."""
    nodes, ways, relations = state
    out, part = [], step * 1000

    def say(kind, action, i, lon=None, lat=None, refs=None, members=None, tags=None):
        nonlocal part
        part += 1
        versions[kind, i] = versions.get((kind, i), 0) + 1
        out.append((kind, action, i, versions[kind, i], part, lon, lat, refs, members, tags or {}))

    for _ in range(4):
        i = rng.choice(list(nodes))
        x, y, tags = nodes[i]
        nodes[i] = (x + 0.0002, y, rng.choice([tags, {}, {"addr:housenumber": "9", "addr:place": "P"}]))
        say("node", "modify", i, nodes[i][0], nodes[i][1], tags=nodes[i][2])
    if step % 2:
        i = rng.choice(list(nodes))
        del nodes[i]
        say("node", "delete", i)
        i = rng.choice(list(relations))
        del relations[i]
        say("relation", "delete", i)
    else:
        new = next(k for k in range(240) if k not in nodes) if step > 2 and len(nodes) < 240 else 1000 + step
        nodes[new] = (20.01, 50.01, {})
        say("node", "create", new, 20.01, 50.01)
        relations[100 + step] = ([("way", rng.choice(list(ways)), "outer"), ("way", rng.choice(list(ways)), "")], {"building": "new"})
        say("relation", "create", 100 + step, members=relations[100 + step][0], tags={"building": "new"})
    i, j = rng.sample(list(ways), 2)
    del ways[i]
    say("way", "delete", i)
    ways[j] = (ways[j][0][:-2] + [ways[j][0][0]], rng.choice([{"building": "cut"}, {}, {"disused:building": "yes"}]))
    say("way", "modify", j, refs=[0], tags={"building": "between"})
    say("way", "modify", j, refs=ways[j][0], tags=ways[j][1])
    out.append(("way", "modify", j, 0, 1, None, None, [1, 2, 3, 1], None, {"building": "late"}))
    rng.shuffle(out)
    return out


def _frames(spark, state, versions):
    nodes, ways, relations = state
    v = lambda kind, i: versions.get((kind, i), 0)
    rows = {"nodes": [(i, v("node", i), *n) for i, n in nodes.items()], "ways": [(i, v("way", i), *w) for i, w in ways.items()], "relations": [(i, v("relation", i), *r) for i, r in relations.items()]}
    return {t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in rows.items()}


def _content(df):
    rings = "rings" in df.columns
    out = df.withColumn("a", F.round(polygon.area(F.col("rings")) * 1e9).cast("long")).drop("rings") if rings else df
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.to_json(c).alias(c) if t.startswith(("map", "array")) else F.col(c) for c, t in out.dtypes]
    return sorted((tuple(r) for r in out.select(*rounded).collect()), key=str)


def test_state_after_batches_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(8)
    state, versions = _map(rng), {}
    store, f = Store(spark, str(tmp_path / "map")), _frames(spark, state, versions)
    upkeep.load(store, f["nodes"], f["ways"], f["relations"], blocks=64, sequence=100)
    for step in range(1, 3):
        before = {t: {(r.osm_type, r.osm_id): (r.x0, r.y0, r.x1, r.y1) for r in store.read(t).collect()} for t in ("buildings", "former")}
        rows = _edited(rng, state, versions, step)
        batch = spark.createDataFrame(rows, CHANGE)
        version = upkeep.apply_batch(store, batch, F.lit("2024-01-01").cast("timestamp"), 100 + step)
        assert upkeep.apply_batch(store, batch, F.lit("2024-01-01").cast("timestamp"), 100 + step) == version == step + 1
        after = {t: {(r.osm_type, r.osm_id): (r.x0, r.y0, r.x1, r.y1) for r in store.read(t).collect()} for t in ("buildings", "former")}
        moved = {x for t in before for k in before[t].keys() | after[t].keys() if before[t].get(k) != after[t].get(k) for x in (before[t].get(k), after[t].get(k)) if x}
        queued = store.read("queue", [f"new-{version}"])
        assert moved and moved <= {m for m in moved if queued.filter(f"source = 'egib' AND cell_x = {int((m[0] + 180) / 360 * 16384)}").count()}
    assert store.manifest()["note"]["sequence"] == 102
    whole, f = Store(spark, str(tmp_path / "again")), _frames(spark, state, versions)
    upkeep.load(whole, f["nodes"], f["ways"], f["relations"], blocks=64)
    for table in [*upkeep.ELEMENTS, "node_ways", "way_relations", *upkeep.SERVED]:
        assert _content(store.read(table)) == _content(whole.read(table)), table
    assert {r.osm_type for r in store.read("buildings").collect()} == {"way", "relation"} and store.read("unresolved").count() > 0
    # a batch of one node writes its own blocks, not the tables
    spot = next(iter(state[0]))
    version = upkeep.apply_batch(store, spark.createDataFrame([("node", "modify", spot, 99, 1, 0.0, 0.0, None, None, {})], CHANGE), F.current_timestamp(), 200)
    tables = store.manifest()["tables"]
    fresh = {t: sum(x.startswith(f"v{version}/") for x in tables[t]["blocks"].values()) for t in upkeep.ELEMENTS}
    assert fresh == {"nodes": 1, "ways": 0, "relations": 0} and all(sum(x.startswith(f"v{version}/") for x in tables[t]["blocks"].values()) <= 8 for t in upkeep.SERVED)
    size = lambda *p: sum(os.path.getsize(os.path.join(d, x)) for d, _, n in os.walk(os.path.join(store.root, *p)) for x in n)
    assert size("nodes", f"v{version}") * 10 < size("nodes", "v1")
    assert store.read("refused", [f"new-{version}"]).count() > 0  # a building stretched to 0, 0


def test_changes_stream_into_the_store(spark, tmp_path):
    rng = random.Random(2)
    state, versions = _map(rng), {}
    store, f = Store(spark, str(tmp_path / "map")), _frames(spark, state, versions)
    upkeep.load(store, f["nodes"], f["ways"].limit(0), f["relations"].limit(0), blocks=8)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("node", "modify", 0, 5, 1, 20.5, 50.5, None, None, {"addr:housenumber": "1"}), ("node", "delete", 4, 5, 2, None, None, None, None, {})], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        upkeep.start(spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in")), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.latest() == 2 and store.read("nodes").count() == 239 and store.read("addresses").filter("osm_id = 0").first().lon == 20.5


def test_a_batch_broadcasts_no_table_that_grows(spark, tmp_path, monkeypatch):
    """Files of equal values are small, their rows are not: what is small on disk is not sent through the driver."""
    state, versions, plans = _map(random.Random(5)), {}, []
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    write, commit = upkeep.written, Store.commit
    monkeypatch.setattr(upkeep, "written", lambda df, name: (told(df), write(df, name))[1])
    monkeypatch.setattr(Store, "commit", lambda self, parts, note=None: ([told(p.rows) for p in parts.values()], commit(self, parts, note))[1])
    store, f = Store(spark, str(tmp_path / "map")), _frames(spark, state, versions)
    upkeep.load(store, f["nodes"], f["ways"], f["relations"].limit(0), blocks=2)
    batch = spark.createDataFrame([("node", "modify", 0, 9, 1, 20.0, 50.0, None, None, {}), ("way", "delete", 1, 9, 2, None, None, None, None, {})], CHANGE)
    upkeep.apply_batch(store, batch, F.current_timestamp(), 1)
    assert len(plans) > 20 and sum("Join" in p for p in plans) > 10
    assert not [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
