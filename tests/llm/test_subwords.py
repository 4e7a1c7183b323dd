import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import subwords
from plumbline.llm.words import word_hashes


def test_features_of_a_word():
    rows, starts = subwords.word_features([b"abc", "é".encode()], word_hashes([b"abc \xc3\xa9"])[0])
    assert np.diff(starts).tolist() == [1 + 3 + 2 + 1, 1 + 1]  # <abc> has 3, 2 and 1 runs of 3, 4 and 5; <é> one of 3
    again, _ = subwords.word_features(["é".encode()], word_hashes([b"\xc3\xa9"])[0])
    assert again.tolist() == rows[starts[1] :].tolist()


def test_steps_follow_the_gradient():
    """One step of the descent against differences of the loss."""
    bag, label = (np.array([3, 8, 9]), np.array([0.5, 0.25, 0.25])), 1.0
    model = subwords.trained([bag] * 3, np.array([label, 0.0, label]), epochs=2)
    rows, sums = model.rows.astype(np.float64), model.sums.copy()

    def loss(r, s):
        z = (bag[1] @ r[bag[0]]) @ s
        return np.log1p(np.exp(z[0] - z[1]))

    p = subwords.Model(rows, sums).probability(bag)
    wrong = np.array([1 - p, p - 1])
    for k, f in enumerate(bag[0].tolist()):
        near = rows.copy()
        near[f, 2] += 1e-6
        assert abs((loss(near, sums) - loss(rows, sums)) / 1e-6 - bag[1][k] * (sums @ wrong)[2]) < 1e-5
    near = sums.copy()
    near[4, 0] += 1e-6
    assert abs((loss(rows, near) - loss(rows, sums)) / 1e-6 - ((bag[1] @ rows[bag[0]])[4] * wrong)[0]) < 1e-5


def test_held_out(spark):
    rng = random.Random(6)
    plain = ["house", "river", "garden", "walking", "quiet", "evening", "letter", "market", "window", "bridge", "stone", "under"]
    rows, labels = [(None, "river ### house%%%"), (-1, None), (-2, "")], [(None, 1), (-3, None), (-4, 0)]
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 4 == 1:
            words = [w + rng.choice(["###", "%%%", "$$$"]) for w in words]
        elif i % 8 == 2:
            words = [rng.choice("pqr") * rng.randint(3, 9)] * len(words)
        good = int(i % 4 != 1 and i % 8 != 2)
        rows.append((i, " ".join(words)))
        labels += [(i, good)] * (1 + i % 2)
    rows += [(5, "a second text of an id"), (5, "a third text of an id")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    model = subwords.fit(docs, marked.filter(subwords.learnable(F.col("doc_id"))))
    got = subwords.scored(docs.repartition(3), model).withColumn("held", ~subwords.learnable(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held and r.doc_id >= 0 and r.doc_id != 5]
    good = lambda i: int(i % 4 != 1 and i % 8 != 2)
    assert len(held) > 150 and all(r.predicted == good(r.doc_id) for r in held)
    by = {r.doc_id: r for r in got}
    assert by[-1].score == by[-2].score and by[None].predicted == 0
    again = subwords.fit(docs.repartition(5), marked.filter(subwords.learnable(F.col("doc_id"))).repartition(2))
    assert np.array_equal(model.rows, again.rows) and np.array_equal(model.sums, again.sums)
    for r in got[:50]:
        text = next(t for i, t in rows if i == r.doc_id) if r.doc_id != 5 else None
        if text is not None or r.doc_id != 5:
            assert abs(r.score - model.probability(subwords.bags([text or ""])[0])) < 1e-5
    assert {r.score for r in subwords.scored(docs, subwords.fit(docs, marked.limit(0))).collect()} == {0.5}
    assert subwords.scored(docs.limit(0), model).count() == 0


def test_words_are_forgotten_and_found_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 50} w{i % 50} x{i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    model = subwords.trained(subwords.bags(["w1 w2", "x"]), np.array([1.0, 0.0]))
    want = {r.doc_id: r.score for r in subwords.scored(docs, model).collect()}
    assert all(abs(want[i] - model.probability(subwords.bags([f"w{i % 50} w{i % 50} x{i}"])[0])) < 1e-6 for i in range(0, 200, 9))
