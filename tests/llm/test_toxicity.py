import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import toxicity as t


def test_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        terms = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        w = rng.random(len(terms)) + 0.1
        vectors.append((terms, w / math.sqrt((w**2).sum()) if len(w) else w))
    vectors += vectors[:40]
    index = t.Index(vectors, 60, block=16)
    dense = np.zeros((len(vectors), 60))
    for i, (terms, w) in enumerate(vectors):
        dense[i, terms] = w
    for q in range(0, len(vectors), 7):
        for k, skip in ((1, -1), (15, q)):
            terms, w = vectors[q]
            names, cosine = index.top(terms, w, k, skip)
            every = dense @ dense[q]
            if skip >= 0:
                every[skip] = 0
            best = np.sort(every[every > 0])[::-1][:k]
            assert np.allclose(cosine, best) and np.allclose(every[names], cosine)


def test_isotonic():
    x, y = t.isotonic(np.array([1.0, 2, 3, 3, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert np.allclose(np.interp([1, 2, 3, 4, 5], x, y), [0, 0.5, 0.5, 0.5, 1])


def test_held_out(spark):
    rng = random.Random(3)
    plain = ["house", "river", "garden", "walking", "quiet", "evening", "letter", "market", "window", "bridge"]
    rude = ["idiot", "moronic", "trashy"]
    rows, labels = [(None, "idiot idiot"), (-1, None), (-2, "")], [(None, 1), (-3, None)]
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 5 == 2:
            words[rng.randrange(40)] = rng.choice(rude)
            words[rng.randrange(40)] = rng.choice(rude) + rng.choice(["", "s", "xy"])
        rows.append((i, " ".join(words).title()))
        labels.append((i, int(i % 5 == 2)))
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.fit(docs, marked.filter(t.learnable(F.col("doc_id"))))
    got = t.scored(docs, model).withColumn("held", ~t.learnable(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held and r.doc_id >= 0]
    assert len(held) > 80 and all(r.predicted == int(r.doc_id % 5 == 2) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[-1].score == by[-2].score < 0.5
    assert any("idiot" in r.evidence.terms for r in got if r.predicted)
    assert t.scored(docs, t.fit(docs, marked.limit(0))).filter("score > 0").count() == 0
    assert t.scored(docs.limit(0), model).count() == 0


def test_scores_equal_brute_force(spark):
    """Every document's score from plain counting, dense cosines and sorted neighbours."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(260):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        toxic = int(rng.random() < 0.3)
        if toxic and rng.random() < 0.8:
            words += [rng.choice(["vile", "nasty"])] * rng.randint(1, 3)
        rows.append((i, " ".join(words)))
        if i < 200:
            labels.append((i, toxic))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.fit(docs, marked)
    model.points = None  # before calibration
    got = {r.doc_id: r.score for r in t.scored(docs, model).collect()}
    toxic = [y for _, y in labels]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    factor, bags = {}, [Counter(x.split()) for _, x in rows]
    for w in set().union(*bags[:200]):
        a, b = sum(y for x, y in zip(bags, toxic, strict=False) if w in x) + 0.5, sum(1 - y for x, y in zip(bags, toxic, strict=False) if w in x) + 0.5
        z = (math.log(a / (n1 - a + 1)) - math.log(b / (n0 - b + 1))) / math.sqrt(1 / a + 1 / b + 1 / (n1 - a + 1) + 1 / (n0 - b + 1))
        factor[w] = (math.log((1 + n1 + n0) / (a + b)) + 1) * (1 + max(0.0, z - 2))
    vectors = []
    for x in bags:
        v = {w: (1 + math.log(n)) * factor[w] for w, n in x.items() if w in factor}
        size = math.sqrt(sum(y * y for y in v.values()))
        vectors.append({w: y / size for w, y in v.items()})
    rate, bare = n1 / len(toxic), [y for v, y in zip(vectors, toxic, strict=False) if not v]
    compared = 0
    for (i, _), v in zip(rows, vectors, strict=True):
        near = sorted(((sum(y * u.get(w, 0) for w, y in v.items()), j) for j, u in enumerate(vectors[:200])), reverse=True)
        near = [(c, j) for c, j in near if c > 0]
        if len(near) > 15 and near[14][0] - near[15][0] < 1e-9:
            continue  # a tie at the end
        votes = [(1 / (0.05 + 1 - min(c, 1.0)), toxic[j]) for c, j in near[:15]]
        want = (sum(w * y for w, y in votes) + rate) / (sum(w for w, _ in votes) + 1) if votes else (sum(bare) + rate) / (len(bare) + 1)
        assert abs(got[i] - want) < 1e-9
        compared += 1
    assert compared > 240


def test_repeated_ids_give_the_same_model(spark):
    rng = random.Random(9)
    rows = [(i % 100, " ".join(rng.choice(["vile", "kind", "house", "river", "stone", "green"]) for _ in range(12))) for i in range(300)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, toxic int")
    scores = [sorted((r.doc_id, r.text, r.score) for r in t.scored(docs, t.fit(docs.repartition(n), marked)).collect()) for n in (1, 3, 7)]
    assert scores[0] == scores[1] == scores[2]


def test_lists_as_slices_of_one_array():
    import pyarrow as pa

    rows = [[3, 5], [], [7]]
    got = t._arrays(pa.chunked_array([rows[:2], rows[2:]], pa.list_(pa.int64())))
    assert [x.tolist() for x in got] == rows and got[0].base is got[2].base
    assert t._arrays(pa.chunked_array([], pa.list_(pa.int64()))) == []
