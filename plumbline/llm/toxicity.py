"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted votes.

Terms are all words (runs of letters, lower-cased) of the labelled examples. A document is its terms'
(1 + log tf) * idf * (1 + max(0, z - 2)), at unit length; z is by how many standard errors a term's log odds ratio between toxic
and other examples is above 0, so terms without evidence keep their plain TF-IDF weight and those that mark the label count for
more (plain TF-IDF lets a long document's other words drown them; see the README). The index keeps each term's postings in
blocks of 64 examples with the largest weight of each; a query sums these to a bound for every block (for terms of more than one
example in 16 it takes the sums themselves, found for 64 queries in one product), visits blocks from the
highest bound down, and stops where no block can reach the k-th best cosine, so the k nearest are exact. Votes are weighted by
1 / (0.05 + distance); documents that share no term with any example get the rate among examples without terms. Scores are
calibrated by isotonic regression on the examples' own scores, each found without itself.

Fitting takes at most `max_rows` labelled documents, those of smallest hashed doc_id, so the index that every task gets is
bounded by that sample; no term of it is left out. Whether a row may be learned from is up to the caller (`learnable`).

Nulls and odd rows: null text is empty, without terms; labels with null doc_id or null toxic are not used; a doc_id that is
labelled twice counts as toxic if either is; of several texts of one doc_id that of smallest hash is learned from; with no usable labels every score is 0; repeated rows each have a row; an
empty table gives an empty result; columns that clash with computed ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, take_up

MAX_ROWS, NEAREST, BLOCK, OFTEN, SLICE = 4_000, 15, 64, 16, 64
_word = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    return Counter(_word.findall(text.lower()))


class Index:
    """Postings of unit vectors by term and block, with the largest weight of each."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        """vectors: (terms below n_terms, weights) of each example; its place in the list is its name."""
        held = np.bincount(np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=n_terms)
        likeness = [(int(t[np.argmax(held[t])]), int(t[np.argmax(w)])) if len(t) else (-1, -1) for t, w in vectors]
        self.names = np.array(sorted(range(len(vectors)), key=lambda i: (likeness[i], i)), np.int64)  # by commonest term (the language, mostly), then by strongest
        self.blocks = len(vectors) // block + 1
        lists = [vectors[i] for i in self.names]
        term = np.concatenate([t for t, _ in lists] or [np.zeros(0, np.int64)]).astype(np.int64)
        doc = np.repeat(np.arange(len(lists)), [len(t) for t, _ in lists])
        weight = np.concatenate([w for _, w in lists] or [np.zeros(0)]).astype(np.float64)
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        keys = term[order] * self.blocks + self.doc // block
        groups, self.start = np.unique(keys, return_index=True)
        self.end = np.append(self.start[1:], len(keys))
        self.high = np.maximum.reduceat(self.weight, self.start) if len(keys) else np.zeros(0)
        self.block_of, terms = groups % self.blocks, groups // self.blocks
        self.first = np.searchsorted(terms, np.arange(n_terms + 1))
        self.block, self.often, self.dense = block, np.full(n_terms, -1, np.int64), None
        common = np.flatnonzero(held * OFTEN > max(len(vectors), OFTEN))
        self.often[common] = np.arange(len(common))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def _shared_terms(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each query's sums over terms of more than one example in OFTEN, whose postings each worker lays out as a table (at most
        OFTEN numbers for each posting): one product for all queries."""
        common = np.flatnonzero(self.often >= 0)
        if self.dense is None:
            self.dense = np.zeros((len(common), self.blocks * self.block))
            for at, term in enumerate(common.tolist()):
                spots = slice(self.start[self.first[term]], self.end[self.first[term + 1] - 1])
                self.dense[at, self.doc[spots]] = self.weight[spots]
        asked = np.zeros((len(queries), len(common)))
        for at, (terms, weights) in enumerate(queries):
            rows = self.often[terms]
            asked[at, rows[rows >= 0]] = weights[rows >= 0]
        return asked @ self.dense

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Names and cosines of the k nearest (ties by name's order in the index), without `skip`."""
        return self.tops([(terms, weights)], k, [skip])[0]

    def tops(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skips: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """`top` of each query; a few dozen at a time are best."""
        return [self._top(known, *(x[self.often[q[0]] < 0] for x in q), k, skip) for q, skip, known in zip(queries, skips, self._shared_terms(queries), strict=True)]

    def _top(self, known: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """known: each example's sum over the query's other terms; a block's bound is the largest of it and of its postings."""
        lo, hi = self.first[terms], self.first[terms + 1]
        sizes = hi - lo
        groups = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        share, known = np.repeat(weights, sizes), known.reshape(self.blocks, self.block)
        bound = np.bincount(self.block_of[groups], share * self.high[groups], self.blocks) + known.max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, cosine, at, step = np.zeros(0, np.int64), np.zeros(0), 0, max(4, self.blocks // 8)
        while at < len(order) and (len(best) < k or bound[order[at]] >= cosine[-1] - 1e-11):
            chosen = np.zeros(self.blocks, bool)
            chosen[order[at : at + step]] = True
            own = chosen[self.block_of[groups]]
            g, s = groups[own], share[own]
            n = self.end[g] - self.start[g]
            spots = np.repeat(self.start[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sums = np.bincount(self.doc[spots], np.repeat(s, n) * self.weight[spots], len(self.names))
            sums = np.round(sums + np.where(chosen[:, None], known, 0.0).reshape(-1)[: len(sums)], 12)  # the same in whatever order it is added up
            docs = np.flatnonzero(sums >= (cosine[-1] if len(best) == k else 1e-12))
            docs = docs[self.names[docs] != skip]
            best, cosine = np.append(best, docs), np.append(cosine, sums[docs])
            keep = np.lexsort((best, -cosine))[:k]
            best, cosine = best[keep], cosine[keep]
            at, step = at + step, step * 2
        return self.names[best], np.minimum(cosine, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the nondecreasing least-squares fit of y by x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, a, b, 1])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return np.array([p for a, b, *_ in pools for p in (a, b)]), np.array([s / n for _, _, s, n in pools for _ in (0, 1)])


class Classifier:
    """What tasks get: terms, idf, the index, labels and calibration."""

    def __init__(self, terms: list[str], factor: np.ndarray, strong: np.ndarray, ids: list, toxic: np.ndarray, vectors: list, nearest: int = NEAREST):
        """factor: what a term's (1 + log tf) is multiplied with; strong: by how much the label alone raises that."""
        self.place = {t: i for i, t in enumerate(terms)}
        self.terms, self.factor, self.strong, self.ids, self.toxic, self.nearest = terms, factor, strong, ids, toxic, nearest
        self.index = Index(vectors, len(terms))
        self.rate = float(toxic.mean()) if len(toxic) else 0.0
        bare = np.array([len(t) == 0 for t, _ in vectors], bool)
        self.bare = (float(toxic[bare].sum()) + self.rate) / (float(bare.sum()) + 1) if len(toxic) else 0.0
        self.points = None
        self.memo: dict[bytes, tuple] = {}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = words(text)
        terms, counts = np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        order = np.argsort(terms)
        order = order[np.searchsorted(terms[order], 0) :]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        terms, counts = terms[order], counts[order]
        weights = (1 + np.log(counts)) * self.factor[terms]
        return terms, weights / np.sqrt((weights**2).sum())

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], skips: list[int]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Vote, names and cosines of the nearest examples of each vector."""
        out = []
        for names, cosine in self.index.tops(vectors, self.nearest, skips):
            w = 1 / (0.05 + 1 - cosine)
            out.append((float((w @ self.toxic[names] + self.rate) / (w.sum() + 1)) if len(names) else self.bare, names, cosine))
        return out

    def scores(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """Score, names and cosines of the nearest examples, and the text's terms, of each text."""
        vectors = [self.vector(t) for t in texts]
        keys = [t.tobytes() + w.tobytes() for t, w in vectors]
        if len(self.memo) > 4_000:
            self.memo.clear()
        new = {k: v for k, v in zip(keys, vectors, strict=True) if k not in self.memo}
        for key, (raw, names, cosine) in zip(new, self.votes(list(new.values()), [-1] * len(new)), strict=True):
            if self.points is not None and len(names):
                raw = 0.98 * float(np.interp(raw, *self.points)) + 0.02 * raw
            self.memo[key] = raw, names, cosine
        return [(*self.memo[k], t) for k, (t, _) in zip(keys, vectors, strict=True)]


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the doc_id as text modulo 5 is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _arrays(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """Each list as a slice of one array; Python's own numbers would take several times the space on the driver."""
    whole = lists.combine_chunks()
    flat, ends = whole.flatten().to_numpy(), np.cumsum([0, *whole.value_lengths().to_pylist()]).tolist()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, nearest: int = NEAREST) -> Classifier:
    """labels: doc_id, toxic (0 or 1), already reduced to rows that may be learned from."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna().groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    some = own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    train = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "_id")  # max_rows ids
    train = stored(train.groupBy("_id", "_toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxicity-examples")
    sums = {r._toxic: r.n for r in train.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sums.get(1, 0), sums.get(0, 0)

    def count(batches):
        got: tuple[Counter, Counter] = Counter(), Counter()

        def made():
            names = list(got[0].keys() | got[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([got[1][t] for t in names]), pa.array([got[0][t] for t in names])], names=["term", "a", "b"])
            got[0].clear()
            got[1].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                got[int(toxic == 1)].update(words(text).keys())
                if len(got[0]) + len(got[1]) > 100_000:
                    yield made()
        if got[0] or got[1]:
            yield made()

    counted = train.select("text", "_toxic").mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = counted.toArrow().sort_by("term")  # the terms of max_rows documents
    terms, a, b = rows.column("term").to_pylist(), rows.column("a").to_numpy() + 0.5, rows.column("b").to_numpy() + 0.5
    odds = np.log(a / (n1 - a + 1)) - np.log(b / (n0 - b + 1))
    strong = np.maximum(0, odds / np.sqrt(1 / a + 1 / b + 1 / (n1 - a + 1) + 1 / (n0 - b + 1)) - 2) if n1 and n0 else np.zeros(len(terms))
    factor = (np.log((1 + n1 + n0) / (a + b)) + 1) * (1 + strong)
    maker = Classifier(terms, factor, strong, [], np.zeros(0), [], nearest)
    shared = docs.sparkSession.sparkContext.broadcast(maker)

    def vectors(batches):
        take_up("toxicity: vectors")
        for batch in batches:
            made = [shared.value.vector(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_toxic"), pa.array([t for t, _ in made], pa.list_(pa.int64())), pa.array([w for _, w in made], pa.list_(pa.float64()))], names=["id", "toxic", "terms", "weights"])

    got = train.select("_id", "_toxic", "text").mapInArrow(vectors, "id long, toxic int, terms array<long>, weights array<double>").toArrow().sort_by("id")  # max_rows rows
    shared.destroy()
    ids, toxic = got.column("id").to_pylist(), (got.column("toxic").to_numpy() == 1).astype(float)
    model = Classifier(terms, factor, strong, ids, toxic, list(zip(_arrays(got.column("terms")), _arrays(got.column("weights")), strict=True)), nearest)
    del rows, got, maker, shared
    give_back()
    if len(ids) >= 50:
        place = {d: i for i, d in enumerate(ids)}
        shared_model, shared_place = (docs.sparkSession.sparkContext.broadcast(x) for x in (model, place))

        def without(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part, own = batch.slice(at, SLICE), shared_model.value
                    raw = own.votes([own.vector(t) for t in part.column("text").to_pylist()], [shared_place.value[i] for i in part.column("_id").to_pylist()])
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in raw], pa.float64()), part.column("_toxic")], names=["raw", "toxic"])

        held = train.select("_id", "_toxic", "text").mapInArrow(without, "raw double, toxic int").toArrow()
        for done in (shared_model, shared_place):
            done.destroy()
        x, y = held.column("raw").to_numpy(), (held.column("toxic").to_numpy() == 1).astype(float)
        order = np.lexsort((y, x))
        model.points = isotonic(x[order], y[order])
    return model


def scored(docs: DataFrame, model: Classifier, evidence: bool = True) -> DataFrame:
    """docs with score, predicted (1 if score >= 0.5) and, if asked for, evidence: terms found that mark the label and nearest examples (doc_id, cosine, toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted", "evidence")
    names = kept.columns
    example = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])
    kind = pa.struct([("terms", pa.list_(pa.string())), ("nearest", pa.list_(example))])
    schema = [f"`{n}` {t}" for n, t in kept.dtypes] + ["score double", "predicted int"] + ["evidence struct<terms:array<string>,nearest:array<struct<doc_id:bigint,cosine:double,toxic:int>>>"] * evidence

    def told(own: Classifier, near: np.ndarray, cosine: np.ndarray, terms: np.ndarray) -> dict:
        marks = terms[np.argsort(-own.strong[terms], kind="stable")][:8]
        return {"terms": [own.terms[t] for t in marks.tolist() if own.strong[t] > 0], "nearest": [{"doc_id": own.ids[i], "cosine": c, "toxic": int(own.toxic[i])} for i, c in zip(near[:3].tolist(), cosine[:3].tolist(), strict=True)]}

    def run(batches):
        take_up("toxicity: scores")
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = own.scores([text or "" for text in part.column("text").to_pylist()])
                scores = [x[0] for x in found]
                more = [pa.array([told(own, *x[1:]) for x in found], kind)] if evidence else []
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), *more], names=[*names, "score", "predicted", *["evidence"] * evidence])

    return kept.mapInArrow(run, ", ".join(schema))
