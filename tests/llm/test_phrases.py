import random
import re
from collections import Counter, defaultdict

import numpy as np

from plumbline.llm import phrases


def test_trie_counts_like_a_dictionary():
    rng = np.random.default_rng(1)
    for v, n in ((2, 4), (5, 30), (300, 2000), (4000, 20000)):
        a, b, c = (np.minimum((v * rng.random(n) ** 3).astype(int), v - 1).tolist() for _ in range(3))
        some = {b"w%d w%d" % (x, y) for x, y in zip(a, b, strict=True)} | {b"w%d w%d w%d" % p for p in list(zip(a, b, c, strict=True))[::3]}
        listed = sorted(some)
        trie = phrases.Trie(listed)
        number = {w: k for k, w in enumerate(trie.words, 1)}
        words = [b"w%d" % x for x in np.minimum((v * rng.random(5000) ** 3).astype(int), v).tolist()]
        codes = np.array([number.get(w, 0) for w in words])
        codes[::17] = 0
        got = trie.count([codes[k : len(codes) - 2 + k] for k in range(3)])
        want = Counter(p for i in range(len(codes) - 2) for k in (2, 3) if codes[i : i + k].all() and (p := b" ".join(words[i : i + k])) in some)
        assert {listed[trie.accepts[s]]: int(got[s]) for s in np.flatnonzero(got) if trie.accepts[s] >= 0} == dict(want)


def brute(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        chosen = {p: a for p, a in own.items() if " " in p and a >= least}
        rows_ = []
        for p, a in chosen.items():
            w = p.split(" ")
            if len(w) == 2 and any(len(x := q.split(" ")) == 3 and (x[:2] == w or x[1:] == w) and 100 * b >= 50 * a for q, b in chosen.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = own[" ".join(w[:k])], own[" ".join(w[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            rows_.append((p, a, left, right, score))
        rows_.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i, p, a, left, right, n[lang], score) for i, (p, a, left, right, score) in enumerate(rows_[:top], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark, monkeypatch):
    """Small slices and blocks, so that texts are cut and tries are several; odd texts, nulls, repeated rows, other columns."""
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "Ärger", "ärger", "é", " ", "x\x00y", "日本", "new", "york", "city", "a" * 50] + [f"w{i}" for i in range(40)]
    rows = [("en", None), ("en", ""), (None, "new york city. " * 12), ("x/y", "a b\tc! " * 11), ("en", " \t "), ("en", "the " * 300)] + [("de", "same text, here")] * 15
    for _ in range(150):
        words = []
        while len(words) < rng.randint(1, 200):
            words += rng.choice([["new", "york", "city"], ["of", "the"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        rows.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ":"]) for w in words)))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, rank int, words string")
    monkeypatch.setattr(phrases, "SLICE", 700)
    monkeypatch.setattr(phrases, "WORDS_A_BLOCK", 4000)
    slices = phrases.coded(docs)
    assert slices.count() > 5
    got = phrases.collocations(docs.repartition(3), top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 40)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_full_buckets_by_bits():
    rng = np.random.default_rng(2)
    blocks = [0, 7, 3, 70_000]
    own = [np.unique(rng.integers(0, 1 << 16, n)).astype("<u2") for n in (5000, 1, 65_536 * 4, 300)]
    numbers = {b << 16 | int(k) for b, x in zip(blocks, own, strict=True) for k in x}
    keys = np.concatenate([np.array(sorted(numbers)), rng.integers(0, 70_003 << 16, 5000), [0, (7 << 16) + 65_535, (1 << 60) - 1]]).astype(np.uint64)
    full = phrases._Full(blocks, [x.tobytes() for x in own])
    assert full.among(keys).tolist() == [int(k) in numbers for k in keys] and not phrases._Full([], []).among(keys).any()


def test_a_trie_is_read_once_for_many_slices(spark, monkeypatch):
    """The counts of a task's slices are taken from one reading of a trie, not from one for every slice or two."""
    monkeypatch.setattr(phrases, "SLICE", 400)
    docs = spark.createDataFrame([("en", "new york city of the " * 9 + f"w{k % 7} w{k % 3}") for k in range(60)], "lang string, text string").coalesce(1)
    slices, read = phrases.coded(docs), []
    words = phrases.word_counts(slices)
    n = {"en": words.agg({"f": "sum"}).first()[0]}
    frequent = phrases._written(words.filter("f >= 10").select("lang", "h"), "phrase-frequent", n)
    full = phrases._written(phrases.bucket_sums(slices, frequent, n, 10), "phrase-buckets", n)
    tries = phrases.tries(phrases.candidates(slices, frequent, full, n))
    own, made = phrases._trie, slices.collect()
    monkeypatch.setattr(phrases, "_trie", lambda *args: read.append(1) or own(*args))

    class Here:  # runs the tasks' function in this process
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            self.f = f
            return self

        def groupBy(self, *_):  # noqa: N802
            return self

        def applyInArrow(self, *_):  # noqa: N802
            return self.f

    run = phrases.counted(Here(), frequent, tries, n)
    got = list(run([slices.toArrow().combine_chunks().to_batches()[0]]))
    assert len(made) >= 6 and 0 < len(read) <= len(made) // 3 + 1 and got


def test_score_is_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000_007, 3_000_000_000_000_011, 3_000_000_000_000_013)], "a long, l long, r long")
    got = phrases.with_score(df).first()
    assert got.score == 1_000_000 * got.a * got.a // (got.l * got.r)
