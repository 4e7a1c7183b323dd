import random

import duckdb
import numpy as np
import pytest

from plumbline.llm import neardup
from plumbline.llm.graph import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = {}
    for i, (d, _) in enumerate(rows):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b) or d is not None and d == rows[j][0]:
                parent[root(i)] = root(j)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, len(sets[i]), ids.get(root(i)) if sets[i] else d, d == (ids.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéA") for _ in range(4))
    shared = [word() for _ in range(60)]
    out = []
    for _ in range(8):  # chains of edits, so that ends are less alike than neighbours
        text = [word() for _ in range(150)]
        for _ in range(rng.randint(1, 9)):
            out.append(" ".join(text))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(200)]
    for _ in range(50):  # a large group of near copies
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text))
    out += [" ".join(shared + [word() for _ in range(60)]) for _ in range(30)]  # a passage in common, but not alike
    out += ["", None, " \n", "short one", "Short ONE", "a b c d e", out[0], out[0].upper().replace("É", "é")]
    return [(i * 3 + 7, t) for i, t in enumerate(out)] + [(None, out[0]), (None, "alone here with no number at all"), (7, "another text under an id that occurs twice")]


@pytest.mark.parametrize("options", [{}, {"node": 60, "open_pairs": 50}])
def test_equals_brute_force(spark, rows, options):
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, component_id int, sig string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, **options).collect()), key=str)
    assert got == brute(rows)


def test_links_inside_a_group_just_below_the_threshold(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base, out = [word() for _ in range(280)], []
    for _ in range(120):  # two of a likeness of 0.86, about 0.80 to all others
        at, new = rng.sample(range(10, 270, 8), 5), [word() for _ in range(5)]
        for own in ((0, 1, 2), (0, 3, 4)):
            text = list(base)
            for k in own:
                text[at[k]] = new[k]
            out.append(" ".join(text))
    rows = list(enumerate(out))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"open_pairs": 500}):
        assert sorted((tuple(r) for r in neardup.near_duplicates(docs, **options).collect()), key=str) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    """3,000 near copies of one text in several tiles and parts, with rare links to what is outside; against an exact join."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base, out = [word() for _ in range(130)], []
    for _ in range(3000):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(130)] = word()
        out.append(" ".join(text))
    sets = neardup.shingle_sets(out)
    whole, column = np.unique(np.concatenate(sets), return_inverse=True)
    table = np.zeros((len(out), len(whole)), np.float32)
    table[np.repeat(np.arange(len(out)), [len(x) for x in sets]), column] = 1
    both, sizes = table @ table.T, np.array([len(x) for x in sets])
    labels = neardup._labels(100 * both >= 85 * (sizes[:, None] + sizes[None, :] - both))
    assert 50 < len(set(labels.tolist())) < 2500
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(8)
    for options in ({}, {"node": 500, "open_pairs": 20_000}):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, **options).collect()}
        assert [got[i] for i in range(len(out))] == labels.tolist()


def test_components_are_joined_once_however_deep_the_trees(spark, rows, monkeypatch):
    """Every level reads the trees' input, so what has been joined to it is written first."""
    own, plans = neardup.tree_nodes, []

    def seen(sets, *args, **options):
        plans.append(sets._jdf.queryExecution().optimizedPlan().toString())
        return own(sets, *args, **options)

    monkeypatch.setattr(neardup, "tree_nodes", seen)
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, node=60, open_pairs=50).collect()), key=str)
    assert got == brute(rows) and len(plans) > 1 and not any("Join" in p for p in plans)


@pytest.mark.parametrize("more", [False, True])
def test_roots_are_made_once_however_deep_the_trees(spark, rows, more):
    """What branches and what doesn't are both read from the written roots; the sets aren't exploded again for each."""
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    base = neardup.signatures(docs).filter("n_shingles > 0 AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sets = base.selectExpr("doc_id AS id", "sig", "roots", "n_shingles AS n", "doc_id AS comp", *(["5 AS first", "9 AS last"] if more else []))
    nodes = neardup.tree_nodes(sets, 5, node=10, open_pairs=20)
    assert nodes.agg({"level": "max"}).first()[0] > 0
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(slice" not in plan and "explode(sequence(first" not in plan and "MapInArrow" not in plan


def test_trees_meet_the_recall_at_any_depth():
    assert neardup.second_chance(85) == 0.18 and neardup.second_chance(80) == 0.25 and 0.63 <= neardup.least_alike(80) <= 0.65
    assert 4 <= neardup.trees_needed(85, 0, 0.9999) <= neardup.ROOTS < neardup.trees_needed(85, 15, 0.9999) < neardup.trees_needed(85, 52, 0.9999)


def test_what_nothing_parts_is_compared_whole():
    ids, sig, sizes = np.arange(600), np.zeros((600, neardup.TOKENS), np.uint8), np.full(600, 900)
    ((rows, _),) = neardup._leaves(ids, sig, 1, ids, 0.0, 8, depth=2)
    assert len(rows) == 600
    found = list(neardup._candidate_groups(ids, sig, sizes, ids, 90, 85))
    assert {(i, j) for g in found for i in g.tolist() for j in g.tolist() if i < j} == {(i, j) for i in range(600) for j in range(i + 1, 600)}
    assert max(map(len, found)) <= 2 * neardup.TILE


def test_sql_equals_brute_force(rows):
    some = [r for r in rows if r[0] is not None][:-1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", some)
    assert sorted(con.execute(neardup.SQL).fetchall(), key=str) == brute(some)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5)] + [(1000, i) for i in range(1001, 1100)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
