"""Periodic runs of words: stretches that repeat themselves with a smallest period, found exactly, and texts without the repeats.

A run is a stretch of words with smallest period q, at least max(12, 2q) words long, that neither neighbour extends. A run
with period q holds at least g = max(q, 12 - q) places i with word i = word i + q, so it holds one of 0, g, 2g, ...: the harmonic
grid has about n log n places for all periods of n words. From each place that holds two equal words, the run is found by the
longest common extension of i and i + q forwards and backwards; a stretch found for several periods has the smallest of them.

Extensions come from a difference cover: of the residues modulo 13, {0, 1, 3, 9} have every difference, so for any two places some
shift below 13 brings both to sampled ones. Only suffixes at sampled places are sorted (by 13 words, then by doubling), the common
prefixes of neighbours in that order stand in a sparse table of minima, and an extension is at most 12 words compared one by
one and one look-up. Texts of a slice share one structure, with a word of its own between any two; texts in which no place
has six equal words around it have no run and stay out of it.

A run's first period is kept and the rest of it is dropped in the collapsed text.

Nulls and odd rows: null or empty text has no words and no runs; every row is on its own, so repeated rows and null doc_ids
each have a row; an empty table gives an empty result; columns that clash with computed ones are replaced. A text of n words
takes about 100 n bytes in its task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

LEAST = 12
#: A perfect difference set.
COVER, MODULUS = (0, 1, 3, 9), 13
TABLE = 4096


def _shifts() -> np.ndarray:
    """By the residues of two places, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(d for d in range(MODULUS) if inside[(a + d) % MODULUS] and inside[(b + d) % MODULUS])
    return out


_SHIFT = _shifts()


class Extensions:
    """Longest common extensions of places in a sequence of numbers, whose last number stands nowhere else."""

    def __init__(self, s: np.ndarray):
        self.s, n, v = s, len(s), MODULUS
        places = np.flatnonzero(np.isin(np.arange(n) % v, COVER))
        spot = np.full(n, -1, np.int64)
        spot[places] = np.arange(len(places))
        wide = np.concatenate([s - s.min() + 1, np.zeros(v, np.int64)])
        bits = max(1, int(wide.max()).bit_length())
        held = max(1, 62 // bits)
        columns = []
        for lo in range(0, v, held):
            key = np.zeros(len(places), np.int64)
            for t in range(lo, min(v, lo + held)):
                key = key << bits | wide[places + t]
            columns.append(key)
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(places), bool)
        for key in columns:
            new[1:] |= key[order][1:] != key[order][:-1]
        ranks = np.empty(len(places), np.int64)
        ranks[order] = np.cumsum(new)
        levels, step = [ranks], v
        while int(ranks.max(initial=0)) < len(places) - 1:
            after = places + step
            behind = np.where(after < n, ranks[spot[np.minimum(after, n - 1)]] + 1, 0)
            _, ranks = np.unique(ranks << 32 | behind, return_inverse=True)
            levels.append(ranks)
            step *= 2
        order = np.empty(len(places), np.int64)
        order[ranks] = np.arange(len(places))
        self.spot, self.rank = spot, ranks
        x, y = places[order[:-1]], places[order[1:]]
        common = np.zeros(len(x), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][spot[x]] == levels[k][spot[y]]
            jump = np.where(same, v << k, 0)
            common, x, y = common + jump, x + jump, y + jump
        common += self._compared(x, y, np.full(len(x), v))
        rows = [common.astype(np.int32)]
        while (1 << len(rows)) <= len(common):
            half = 1 << (len(rows) - 1)
            low = rows[-1].copy()
            low[: len(low) - half] = np.minimum(low[:-half], rows[-1][half:])
            rows.append(low)
        self.minima = np.array(rows)

    def _compared(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal numbers from x and y on, up to so many, one by one."""
        out = np.zeros(len(x), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            live = live[self.s[x[live] + out[live]] == self.s[y[live] + out[live]]]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers are equal from x and y (not the same place) on."""
        shift = _SHIFT[x % MODULUS, y % MODULUS]
        out = self._compared(x, y, shift)
        far = np.flatnonzero(out == shift)
        a, b = (self.rank[self.spot[z[far] + shift[far]]] for z in (x, y))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out[far] += np.minimum(self.minima[level, low], self.minima[level, high - (1 << level)])
        return out


def _grid(n: int, first: int = 1, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places i and i + q of the harmonic grid of n words, for periods from first to last."""
    q = np.arange(first, (n // 2 if last is None else last) + 1)
    step = np.maximum(q, LEAST - q)
    sizes = (n - q + step - 1) // step
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = at * np.repeat(step, sizes)
    return i, i + np.repeat(q, sizes)


_tables: list = []


def equal_places(ids: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Grid places i and i + q of a text that hold equal words."""
    n = len(ids)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= TABLE:
        if not _tables:
            i, j = _grid(TABLE)
            order = np.argsort(j, kind="stable")
            i, j = i[order].astype(np.int32), j[order].astype(np.int32)
            _tables.extend([i, j, np.searchsorted(j, np.arange(TABLE + 1))])
        i, j, sizes = _tables
        i, j = i[: sizes[n]], j[: sizes[n]]
        hit = np.flatnonzero(ids[i] == ids[j])
        return i[hit].astype(np.int64), j[hit].astype(np.int64)
    found, q = [], 1
    while q <= n // 2:
        last = min(n // 2, q + max(0, most // (n // max(q, LEAST - q) + 1)))
        i, j = _grid(n, q, last)
        hit = np.flatnonzero(ids[i] == ids[j])
        found.append((i[hit], j[hit]))
        q = last + 1
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _around(s: np.ndarray, x: np.ndarray, y: np.ndarray, enough: int) -> np.ndarray:
    """Which pairs have so many equal numbers around them; s starts and ends with numbers that stand nowhere else."""
    ahead = np.ones(len(x), np.int64)
    for sign in (1, -1):
        start = ahead.copy() if sign == 1 else np.ones(len(x), np.int64)
        live = np.flatnonzero(ahead < enough)
        while len(live):
            live = live[s[x[live] + sign * start[live]] == s[y[live] + sign * start[live]]]
            start[live] += 1
            ahead[live] += 1
            live = live[ahead[live] < enough]
    return np.flatnonzero(ahead >= enough)


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text (word numbers from 0 to below 2**40) its runs: rows of start, length, period, ordered by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    pairs = [equal_places(t) for t in texts]
    some = [k for k, (i, _) in enumerate(pairs) if len(i)]
    if not some:
        return out

    def joined(chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The texts with a number of its own before each and after the last, and where each begins."""
        parts, starts, at = [], [], 0
        for mark, k in enumerate(chosen):
            parts += [np.array([-1 - mark]), texts[k]]
            starts.append(at + 1)
            at += 1 + len(texts[k])
        return np.concatenate([*parts, np.array([-1 - len(chosen)])]), np.array(starts)

    s, starts = joined(some)
    owner = np.repeat(np.arange(len(some)), [len(pairs[k][0]) for k in some])
    x, y = (np.concatenate([pairs[k][side] for k in some]) for side in (0, 1))
    likely = _around(s, x + starts[owner], y + starts[owner], LEAST // 2)
    if not len(likely):
        return out
    x, y, owner = x[likely], y[likely], owner[likely]
    chosen = np.unique(owner)
    s, starts = joined([some[k] for k in chosen.tolist()])
    owner = np.searchsorted(chosen, owner)
    x, y = x + starts[owner], y + starts[owner]
    ahead = Extensions(s).of(x, y)
    behind = Extensions(s[::-1].copy()).of(len(s) - x, len(s) - y)
    q = y - x
    whole = np.flatnonzero(ahead + behind >= np.maximum(q, LEAST - q))
    owner, start, end, q = owner[whole], (x - behind)[whole] - starts[owner[whole]], (y + ahead)[whole] - starts[owner[whole]], q[whole]
    order = np.lexsort((q, end, start, owner))
    owner, start, end, q = owner[order], start[order], end[order], q[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    owner, start, end, q = owner[first], start[first], end[first], q[first]
    order = np.lexsort((q, start, owner))
    rows = np.stack([start, end - start, q], axis=1)[order]
    cuts = np.searchsorted(owner, np.arange(len(chosen) + 1))
    for k, own in enumerate(chosen.tolist()):
        out[some[own]] = rows[cuts[k] : cuts[k + 1]]
    return out


def repeated(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words that the doc_id marks for a planted repeat; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def with_runs(docs: DataFrame, planted: bool = False, texts: bool = False) -> DataFrame:
    """docs with n_runs; start, length, period and exponent_milli of the longest run (null without one); runs_sha256 of all runs and
    collapsed_sha256 of the text without repeats; with texts also runs (start, length, period) and collapsed, the text itself.
    planted: words are first repeated in the texts whose doc_id says so (`repeated`)."""
    made = [x.split()[0] for x in SCHEMA.split(", ")] + ["runs", "collapsed"]
    kept = docs.drop(*made)
    names = kept.columns
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = ", ".join([f"`{n}` {t}" for n, t in kept.dtypes] + [SCHEMA] + ["runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"] * texts)

    def told(words: list[bytes], runs: np.ndarray) -> dict:
        listed = runs.tolist()
        best = max(listed, key=lambda r: (r[1], -r[0], -r[2]), default=[None] * 3)
        if listed:
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        rest = b" ".join(words)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in listed)
        out = {"n_runs": len(listed), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if listed else None}
        out |= {"runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(rest).hexdigest()}
        return out | ({"runs": [{"start": a, "length": b, "period": c} for a, b, c in listed], "collapsed": rest.decode()} if texts else {})

    def run(batches):
        fields = [pa.field(n, pa.string() if n.endswith("256") else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))]
        fields += [pa.field("runs", run_type), pa.field("collapsed", pa.string())] if texts else []
        for batch in batches:
            at = 0
            for part in text_slices([batch], [], chars=2_000_000):
                own = batch.slice(at, len(part["text"]))
                at += len(part["text"])
                ids = own.column("doc_id").to_pylist() if planted else [None] * own.num_rows
                numbers: defaultdict = defaultdict(count().__next__)
                words, coded = [], []
                for doc_id, text in zip(ids, part["text"], strict=True):
                    w = text.encode().split()
                    c = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
                    place = repeated(len(w), doc_id)
                    if place is not None:
                        w, c = [w[k] for k in place.tolist()], c[place]
                    words.append(w)
                    coded.append(c)
                rows = [told(w, r) for w, r in zip(words, runs_of(coded), strict=True)]
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), *(pa.array([r[f.name] for r in rows], f.type) for f in fields)], names=[*names, *(f.name for f in fields)])

    return kept.mapInArrow(run, schema)
