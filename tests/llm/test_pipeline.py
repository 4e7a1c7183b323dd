import hashlib
import random

import corpus_pipeline
import numpy as np

from plumbline.llm import bpe, common, neardup, quality, toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ter", "on", "sa"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 120)))
    rows, labels = [], []
    for i in range(300):
        t = text()
        if i % 6 == 5:
            t += " horridly horrid horrids"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, 1, int(i % 6 == 5)))
    rows += [(1000 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(20)]
    rows += [(2000, "too short", "en", "s1", 9), (2001, None, None, None, None), (2002, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES][0] is corpus_pipeline.drop_toxic and len(corpus_pipeline.STAGES) == 5
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    assert ids == {r[0] for r in rows if "horrid" not in (r[1] or "")}
    clash = docs.selectExpr("*", "doc_id * 2 AS score", "doc_id * 3 AS kept").limit(50)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_quality):
        same = stage(spark, clash, str(tmp_path))
        assert same.columns == clash.columns and all(r.score == 2 * r.doc_id and r.kept == 3 * r.doc_id for r in same.collect())
    good = corpus_pipeline.keep_quality(spark, clean, str(tmp_path))
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and kept <= ids - {2000, 2001, 2002} and len(kept) >= 0.98 * (len(ids) - 3)
    single = corpus_pipeline.drop_near_duplicates(spark, good, str(tmp_path))
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i in kept if i < 1000)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = {r[0]: r for r in rows}
    assert {r.doc_id for r in out} <= {i for i in kept if i < 1000} and len(out) > 100
    assert all(r.decoded_sha256 == hashlib.sha256(by[r.doc_id][1].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out)


def test_near_copies_from_0_80(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = []
    for i in range(40):  # pairs of a likeness of 266 / 326 = 0.816, and of 261 / 331 = 0.789
        text = [word() for _ in range(300)]
        copy = list(text)
        for at in rng.sample(range(10, 290, 8), 6 + i % 2):
            copy[at] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {d for d, _ in rows if d % 4 != 1}


def test_rows_without_an_id_and_with_one_id(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a, "x"), (None, a, "y"), (None, b, "z"), (None, b.upper(), "z"), (7, c, "p"), (7, d, "q"), (7, c, "r"), (8, d, "s"), (None, None, "n"), (None, "", "m"), (9, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), "").collect()), key=str) for n in (1, 5)]
    assert runs[0] == runs[1]
    ids = [r[0] for r in runs[0]]
    assert ids.count(5) == 1 and ids.count(7) == 1 and 8 not in ids and 9 in ids
    bare = [r[1] for r in runs[0] if r[0] is None]
    assert a not in bare and sum((x or "").lower() == b for x in bare) == 1 and None in bare and "" in bare and len(bare) == 3


def test_a_worker_keeps_the_models_of_one_operator(spark, monkeypatch):
    docs, made = spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string"), []
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *args, **options: made.append(f) or own(self, f, *args, **options))
    toxicity.scored(docs, toxicity.Classifier([], np.zeros(0), np.zeros(0), [], np.zeros(0), []))
    quality.count_ngrams(docs)
    quality.with_figures(docs, "nowhere")
    neardup.signatures(docs)
    assert len(made) == 4
    for work in made:
        common.take_up("bpe")
        bpe._models["kept"] = "a model"
        common.take_up("bpe")
        assert bpe._models
        list(work(iter([])))
        assert not bpe._models
