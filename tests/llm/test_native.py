import random
import re

import duckdb
import pytest
import xxhash

from plumbline.llm import fingerprint as fp
from plumbline.llm import licenses, mixing

ROWS = [
    (1, "Released under the MIT License. and more", "a"), (2, None, None), (3, "", "b"), (4, "one two three", "a"), (5, "a b c d e f g h " * 3000, "c"), (5, "a b c d e f g h " * 3000, "c"),
    (6, "Licensed under CC BY-NC 4.0.", None), (None, "the GNU General Public License, version 3 general public license", "c"), (7, "x" * 5000, "b"), (8, "words " * 700, "b"),
    (9, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, "z") for r in ROWS], "doc_id long, text string, source string, size int, label string")


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x) for x in r])


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return ordered(con.execute(sql).fetchall())


def test_mix_equals_sql(spark, docs):
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert ordered(got) == duck(ROWS, mixing.SQL)
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() > 0


def test_mix_targets(spark):
    rows = [(i, "w " * (50 + i % 400), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_docs=100).collect()
    taken, target, whole = {}, {}, sum(r.size for r in got)
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert abs(sum(target.values()) - 1.5 * whole) < 1
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_licenses_equal_every_block(spark, docs):
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = licenses.scan(docs)
    assert ordered(got.select(*cols).collect()) == duck(ROWS, licenses.sql())
    by = {r.doc_id: r for r in got.collect()}
    assert by[9].labels == "mit" and by[9].n_base == 0 and by[6].labels == "cc-by-nc" and by[None].base_labels == "gpl"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_license_texts_and_other_letters(spark):
    words = [f"w{i}" for i in range(170)]  # a template of more words than a small window holds
    rows = [(1, "pre " * 77 + " ".join(words) + " post " * 50, "a"), (2, " ".join(words[:140]), "a"), (3, "mit LİCENSE and MİT license, MIT LICENSE", "a"), (4, "\u212a mit license", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    templates = [*licenses.TEMPLATES, ("whole", " ".join(words))]
    got = {r.doc_id: r for r in licenses.scan(df, templates=templates).collect()}
    assert (got[1].labels, got[2].labels, got[3].n_base, got[4].n_words) == ("whole", "", 1, 3)
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert ordered(licenses.scan(df, templates=templates).select(*cols).collect()) == duck(rows, licenses.sql(templates=templates))


def test_apportionment_equals_a_queue_of_quotients(spark):
    """Seats of sources against Sainte-Lague by plain highest quotients, one at a time."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 400), rng.choice("aaaaaabbbcdefgh")) for i in range(900)]
    sized = spark.createDataFrame([(i, len(t.split()), s) for i, t, s in rows], "doc_id long, size long, source string")
    got = mixing.sources(sized).orderBy("rank").collect()
    total, seats = int(1.5 * sum(r.source_size for r in got) / got[0].block + 0.5), [0] * len(got)
    for _ in range(total):
        best = max(range(len(got)), key=lambda i: (got[i].target / (2 * seats[i] + 1), -i))
        seats[best] += 1
    assert [r.seats for r in got] == seats


def sketch(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def h(words):
        s = 42
        for x in words:
            s = xxhash.xxh64(x.encode(), seed=s).intdigest()
        return s - 2**64 if s >= 2**63 else s

    return sorted({h(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {h([" ".join(w)])} if w else set())


def test_fingerprints(spark):
    texts = ["".join(chr(97 + (i * j) % 23) + (" " if j % 4 == 0 else "") for j in range(i * 37)) for i in range(40)] + ["é 🙂 x", "", None]
    df = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, sketch int")
    got = fp.edited_fingerprints(df).select("*", fp.unpacked(fp.packed(fp.F.col("sketch"))).alias("again"), fp.resemblance(fp.F.col("sketch"), fp.F.col("edited_sketch")).alias("near"), fp.distinct_count(fp.F.col("sketch")).alias("n"), fp.containment(fp.F.col("sketch"), fp.F.col("sketch")).alias("own")).collect()
    ordered_rows = sorted(got, key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert len(got) == len(texts) + 1
    for i, r in enumerate(ordered_rows):
        following = ordered_rows[(i + 1) % len(got)].text
        q = len(r.text) // 4
        edited = r.text[: len(r.text) - q] + following[:q]
        assert r.edited_text == edited and r.sketch == r.again == sketch(r.text)[:128] and r.edited_sketch == sketch(edited)[:128] and r.next_sketch == sketch(following)[:128]
        a, b = set(sketch(r.text)), set(sketch(edited))
        assert abs(r.near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2 and r.own == 1
        assert r.n == len(a) if len(a) < 128 else abs(r.n - len(a)) < 0.4 * len(a)
    whole = fp.merged(fp.with_sketch(df.drop("sketch")).withColumn("g", fp.F.lit(1)), ["g"]).first().sketch
    assert whole == sorted({h for t in [*texts, "null id"] for h in sketch(t)})[:128]
    assert fp.edited_fingerprints(df.limit(0)).count() == 0


def test_cuts(spark):
    for n in (0, 1, 2, 7, 16, 50):
        cuts = [3 * i for i in range(n)]
        got = spark.range(-2, 3 * n + 3).select("id", fp._below(fp.F.col("id"), cuts).alias("k")).collect()
        assert all(r.k == sum(c < r.id for c in cuts) for r in got)
