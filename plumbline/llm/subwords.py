"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged over a document, and a softmax.

The features of a document are its words (runs of other bytes than white space, as written), the pairs of neighbouring words, and the
runs of three to five characters within each word and its two ends; a pair of equal words is one feature whatever the word, so that
repeats tell, and every document has one feature of its end, so that an empty one has a score too. Features are hashed into
`BUCKETS` rows of `WIDTH` numbers. A document is the mean of its features' rows; a softmax over two sums of it gives the probability of
label 1. Rows and sums are learned together by stochastic gradient descent, one document a step, with a rate that falls to
zero, over `EPOCHS` passes in an order that depends on the seed alone.

Fitting takes at most `max_rows` labelled documents, those of smallest hashed doc_id. Tasks turn them into features; the descent
itself is sequential and runs in one task, which holds the features of that bounded sample. The model's size is fixed. To score,
each feature's row is reduced to what it adds to the difference of the two sums, so a document's score is a mean of numbers.

Nulls and odd rows: null text is empty; labels with null doc_id or null quality are not used; a doc_id that is labelled twice
counts as 1 if both do; of several texts of one doc_id that of smallest hash is learned from; without usable labels every score is
0.5; repeated rows each have a row; an empty table gives an empty result; columns that clash with computed ones are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .words import mixed, word_hashes

MAX_ROWS, BUCKETS, WIDTH, EPOCHS, RATE, SEED = 6_000, 1 << 18, 16, 5, 1.0, 7
GRAMS = (3, 4, 5)
_END, _TWICE, _FACTOR = 0, 1, np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Rows of hashes; the first two are the end's and that of equal neighbours."""
    return (mixed(h + np.uint64(kind)) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def word_features(words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each word and of its character n-grams, word by word, and where each word's begin, with the end."""
    marked = "".join(f"<{w.decode()}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w.decode()) + 2 for w in words])
    end = np.repeat(ends, np.diff(ends, prepend=0))
    rows, owners = [_bucket(hashes, 1)], [np.arange(len(words))]
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(points)) + n <= end)
        h = np.zeros(len(at), np.uint64)
        for t in range(n):
            h = h * _FACTOR + points[at + t]
        rows.append(_bucket(h, n + 1))
        owners.append(owner[at])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def pair_features(h: np.ndarray) -> np.ndarray:
    """Rows of the pairs of neighbouring words, from the words' hashes."""
    return np.where(h[1:] == h[:-1], _TWICE, _bucket(h[:-1] * np.uint64(3) + h[1:], 2))


class _Coded:
    """Distinct words of a worker's texts by number, with what has been found of them."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict = defaultdict(count().__next__)
        self.hashes = np.zeros(0, np.uint64)

    def texts(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Word numbers of each text, and the words that are new."""
        if len(self.numbers) > self.most:
            self.clear()
        before = len(self.numbers)
        out = []
        for text in texts:
            w = text.encode().split()
            out.append(np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w)))
        new = list(self.numbers)[before:]
        self.hashes = np.append(self.hashes, word_hashes([b" ".join(new)])[0])
        return out, new


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct rows and their shares of its features."""
    numbers, new = (coded := _Coded()).texts(texts)
    rows, starts = word_features(new, coded.hashes)
    out = []
    for own in numbers:
        sizes = starts[own + 1] - starts[own]
        spots = np.repeat(starts[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found, n = np.unique(np.concatenate([[_END], rows[spots], pair_features(coded.hashes[own])]), return_counts=True)
        out.append((found, n / n.sum()))
    return out


class Model:
    """rows: BUCKETS x WIDTH; sums: WIDTH x 2."""

    def __init__(self, rows: np.ndarray, sums: np.ndarray):
        self.rows, self.sums = rows, sums

    def probability(self, bag: tuple[np.ndarray, np.ndarray]) -> float:
        """Of label 1."""
        z = (bag[1] @ self.rows[bag[0]]) @ self.sums
        return float(1 / (1 + np.exp(z[0] - z[1])))

    def steps(self) -> np.ndarray:
        """What each row adds to the difference of the sums."""
        return self.rows.astype(np.float64) @ (self.sums[:, 1] - self.sums[:, 0])


def trained(some: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over bags and their labels (0 or 1)."""
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    sums = np.zeros((WIDTH, 2))
    done, whole = 0, epochs * len(some)
    for _ in range(epochs):
        for k in rng.permutation(len(some)).tolist():
            found, share = some[k]
            own = rows[found]
            mean = share @ own
            z = mean @ sums
            p = 1 / (1 + np.exp(z[0] - z[1]))
            wrong = np.array([labels[k] - p, p - labels[k]])  # of label 0, of label 1
            now = rate * (1 - done / whole)
            back = sums @ wrong
            sums -= now * np.outer(mean, wrong)
            rows[found] = own - (now * share[:, None] * back).astype(np.float32)
            done += 1
    return Model(rows, sums)


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the doc_id as text modulo 3 is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """labels: doc_id, quality (0 or 1), already reduced to rows that may be learned from. None without any."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_good")).dropna().groupBy("_id").agg(F.min("_good").alias("_good"))
    some = stored(own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows), "quality-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "_id")  # max_rows ids
    texts = texts.groupBy("_id", "_good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches):
        for batch in batches:
            for part in text_slices([batch], ["_id", "_good"], chars=1_000_000):
                found = bags(part["text"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["_id"], pa.int64()), pa.array(part["_good"], pa.int32()), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()), pa.array([s.astype("<f4").tobytes() for _, s in found], pa.binary())],
                    names=["id", "good", "found", "share"],
                )

    made = stored(texts.mapInArrow(features, "id long, good int, found binary, share binary"), "quality-features")

    def learn(batches):
        rows = sorted((x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("id", "good", "found", "share")), strict=True)), key=lambda x: x[0])
        if rows:
            model = trained([(np.frombuffer(f, "<i4"), np.frombuffer(s, "<f4")) for _, _, f, s in rows], np.array([float(g == 1) for _, g, _, _ in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([model.rows.tobytes()], pa.binary()), pa.array([model.sums.tobytes()], pa.binary())], names=["rows", "sums"])

    got = stored(made.repartition(1).mapInArrow(learn, "rows binary, sums binary"), "quality-model").first()  # at most max_rows rows; one row comes back
    return None if got is None else Model(np.frombuffer(got.rows, np.float32).reshape(BUCKETS, WIDTH), np.frombuffer(got.sums, np.float64).reshape(WIDTH, 2))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score (probability of label 1) and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else model.steps())  # BUCKETS numbers
    kept = docs.drop("score", "predicted")
    names = kept.columns

    def run(batches):
        steps, coded = shared.value, _Coded()
        values, sizes = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            at = 0
            for part in text_slices([batch], [], chars=2_000_000):
                own = batch.slice(at, len(part["text"]))
                at += own.num_rows
                if steps is None:
                    scores = np.full(own.num_rows, 0.5)
                else:
                    numbers, new = coded.texts(part["text"])
                    if len(new) == len(coded.numbers):  # cleared
                        values, sizes = np.zeros(0), np.zeros(0, np.int64)
                    rows, starts = word_features(new, coded.hashes[len(values) :])
                    values = np.append(values, np.add.reduceat(steps[rows], starts[:-1]) if len(new) else [])
                    sizes = np.append(sizes, np.diff(starts))
                    scores = np.empty(own.num_rows)
                    for k, w in enumerate(numbers):
                        total = steps[_END] + values[w].sum() + steps[pair_features(coded.hashes[w])].sum()
                        scores[k] = total / (1 + sizes[w].sum() + max(0, len(w) - 1))
                    scores = np.round(1 / (1 + np.exp(-scores)), 12)
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return kept.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in kept.dtypes] + ["score double", "predicted int"]))
