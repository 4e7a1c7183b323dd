import hashlib
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import runs


def brute(words):
    """Every run by comparing each word with the one q later, for all q."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_cover_has_every_difference():
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))


def test_extensions():
    rng = np.random.default_rng(4)
    for n, k in ((2, 1), (40, 1), (300, 2), (500, 3)):
        s = np.append(rng.integers(0, k, n), 99)
        x, y = rng.integers(0, n, 400), rng.integers(0, n, 400)
        x, y = x[x != y], y[x != y]
        if not len(x):
            continue
        got = runs.Extensions(s).of(x, y)
        for a, b, g in zip(x.tolist(), y.tolist(), got.tolist(), strict=True):
            want = 0
            while max(a, b) + want < len(s) and s[a + want] == s[b + want]:
                want += 1
            assert g == want


@pytest.mark.parametrize("table", [16, 4096])
def test_runs_equal_brute_force(table, monkeypatch):
    monkeypatch.setattr(runs, "TABLE", table)
    monkeypatch.setattr(runs, "_tables", [])
    rng = random.Random(table)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(0, 6)):
            n, k = rng.choice([0, 1, 5, 11, 12, 13, 30, 80, 200]), rng.choice([1, 2, 3, 50])
            a = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                s, p = rng.randrange(n - 10), rng.randint(1, n // 3)
                for i in range(s, n):
                    a[i] = a[s + (i - s) % p] if rng.random() < 0.99 else 7
            texts.append(np.array(a, np.int64))
        for t, got in zip(texts, runs.runs_of(texts), strict=True):
            assert [tuple(r) for r in got.tolist()] == brute(t.tolist())


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(None, None, "x"), (1, "", "x"), (2, " \t\n", "x"), (3, "a " * 40, "x"), (3, "a " * 40, "x"), (None, "b c " * 20, "x"), (4, "é ß " * 13 + "\x85", "x")]
    for i in range(10, 160):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            words += rng.choices("xyz", k=rng.randint(1, 9)) * rng.randint(2, 9)
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(words), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    got = runs.with_runs(docs.repartition(3), planted=True, texts=True).collect()
    assert len(got) == len(rows) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(10, 160)) > 5
    want = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        found = brute(words)
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), rest.decode(), [tuple(r) for r in found]))
    mine = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256, r.collapsed, [tuple(x) for x in r.runs]) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert runs.with_runs(docs.limit(0), planted=True).count() == 0
