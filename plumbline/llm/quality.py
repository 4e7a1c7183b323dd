"""Quality rules: counts of words, symbols, repeated lines and words, and language-specific perplexity bands.

The language model is modified Kneser-Ney of order 4 over code points, one for each value of lang that the documents have.
A code point takes 16 bits of an n-gram's name (those above 65,535 fall onto the 6,400 private ones), so names are exact 64-bit
integers, and an n-gram's context and its end are shifts and masks of them. Spark counts the n-grams of all documents: a
task sends each one once for each few million that it holds, and the counts are written by language, sorted within each file.
Nothing is capped: the counts grow with what the corpus holds. A Python worker that meets a language reads its counts and
makes the model: for every order, sorted arrays of names with log probabilities, and of contexts with back-off weights,
searched by bisection; continuation counts of the lower orders come from the same array. It keeps the models of the languages
used last, up to `HELD` n-grams.

A document has two figures: its negative log probability (the log of its perplexity) by character and by word, at four
significant digits; signs hung onto words raise the second, which a character that repeats cannot lower. Bands are fences
around the quartiles of all documents' figures in the language, exact ones from a histogram: a document is rejected if either
figure is below q1 - gap or above q3 + gap, where gap is a spread times (q3 - q1) plus a slack / sqrt(the document's characters
in words, or its words), as the mean over a short text strays further.

The model is of characters: nearly every pair of words of a large corpus is a new one, and counting those would shuffle more
than the corpus itself; see the README.

Nulls and odd rows: null text is empty (all counts 0, base_failed, figure null); null lang is a language of its own;
repeated rows each have a row; an empty table gives an empty result; columns that clash with computed ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, scratch, stored, take_up, worker_models
from .words import mixed, run_hashes, word_hashes

ORDER, BITS = 4, 16
#: By figure: the column of its size, and spread, slack and least (q3 - q1).
BANDS = {"log_perplexity": ("word_chars", 3.0, 1.0, 0.02), "word_log_perplexity": ("n_words", 4.0, 4.0, 0.02)}
SYMBOLS = "#*$%&|<>"
WINDOW = 8
HELD = 12_000_000
_models: dict[tuple[str, int, bool], Model] = worker_models.setdefault("quality", {})


def _low(n: int) -> np.uint64:
    """A mask of the last n characters of a name."""
    return np.uint64((1 << (BITS * n)) - 1)


def char_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The name of the n-gram that ends at each character of all texts (white space before the first), and each text's first index, with the end."""
    pad = " " * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 1 << BITS, points, 0xE000 + points % 6400).astype(np.uint64)
    keys = np.zeros(max(0, len(points) - ORDER + 1), np.uint64)
    for j in range(ORDER):
        keys |= points[j : j + len(keys)] << np.uint64(BITS * (ORDER - 1 - j))
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum([0, *sizes + ORDER - 1])[:-1]
    real = np.ones(len(keys), bool)
    for j in range(ORDER - 1):  # n-grams that end in the white space between two texts
        spot = firsts[1:] - 1 - j
        real[spot[spot >= 0]] = False
    return keys[real], np.cumsum([0, *sizes])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def count_ngrams(docs: DataFrame, most: int = 3_000_000) -> DataFrame:
    """band, key, n over all documents: n-grams of the highest order. A task sums them up to `most` distinct ones at a time."""

    def count(batches):
        take_up("quality")
        held: dict[int, tuple[list, list, int]] = {}

        def made():
            for band, (keys, counts, _) in held.items():
                keys, counts = _summed(keys, counts)
                for lo in range(0, len(keys), 100_000):
                    some = keys[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), band)), pa.array(some.view(np.int64)), pa.array(counts[lo : lo + 100_000])], names=["band", "key", "n"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                bands, texts = part.column("band").to_pylist(), part.column("text").to_pylist()
                for band in set(bands):
                    keys, _ = char_keys([t or "" for t, own in zip(texts, bands, strict=True) if own == band])
                    keys, counts = np.unique(keys, return_counts=True)
                    old = held.get(band, ([], [], 0))
                    held[band] = [*old[0], keys], [*old[1], counts], old[2] + len(keys)
                    if held[band][2] > most // 2:  # sum what has come twice
                        keys, counts = _summed(*held[band][:2])
                        held[band] = [keys], [counts], len(keys)
                if sum(n for *_, n in held.values()) > most:
                    yield from made()
        yield from made()

    each = docs.select("text", band_of(docs).alias("band")).mapInArrow(count, "band long, key long, n long")
    return each.groupBy("band", "key").agg(F.sum("n").alias("n"))


def band_of(docs: DataFrame):
    """A language's number: a hash of lang; null has one of its own."""
    return F.xxhash64(F.col("lang").cast("string")) if "lang" in docs.columns else F.xxhash64(F.lit(None).cast("string"))


class Model:
    """One language's n-grams: by order, sorted names with log probabilities, and sorted contexts with log weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """Sorted names of the highest order, and their counts."""
        grams = {ORDER: (keys, counts)}
        for n in range(ORDER - 1, 0, -1):  # continuation counts
            grams[n] = np.unique(grams[n + 1][0] & _low(n), return_counts=True)
        self.chars = len(grams[1][0]) + 1
        self.keys, self.logp, self.contexts, self.logw = {}, {}, {}, {}
        for n in range(1, ORDER + 1):
            keys, counts = grams[n]
            of = [int((counts == k).sum()) for k in range(1, 5)]
            y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
            cut = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.0), float(k)) if of[k - 1] and of[k] else 0.5 for k in (1, 2, 3)]
            taken = np.array([0.0, *cut])[np.minimum(counts, 3)]
            contexts, where = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(where, counts, len(contexts))
            weight = np.bincount(where, taken, len(contexts)) / np.maximum(total, 1)
            lower = np.exp(self.find(n - 1, keys & _low(n - 1)))
            self.keys[n], self.contexts[n] = keys, contexts
            with np.errstate(divide="ignore"):
                self.logp[n] = np.log((counts - taken) / np.maximum(total[where], 1) + weight[where] * lower).astype(np.float32)
                self.logw[n] = np.log(weight).astype(np.float32)

    def closed(self) -> Model:
        """This model for the texts that it counted alone, in which every n-gram is known: without what unseen ones need."""
        self.keys, self.logp, self.contexts, self.logw = {ORDER: self.keys[ORDER]}, {ORDER: self.logp[ORDER]}, {}, {}
        return self

    def find(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams of order n; an n-gram never seen has its context's weight times that of order n - 1."""
        if n == 0:
            return np.full(len(keys), -np.log(self.chars))
        at = np.searchsorted(self.keys[n], keys)
        seen = at < len(self.keys[n])
        seen[seen] = self.keys[n][at[seen]] == keys[seen]
        out = np.empty(len(keys))
        out[seen] = self.logp[n][at[seen]]
        rest = keys[~seen]
        if len(rest):
            context = rest >> np.uint64(BITS)
            at = np.searchsorted(self.contexts[n], context)
            has = at < len(self.contexts[n])
            has[has] = self.contexts[n][at[has]] == context[has]
            weight = np.zeros(len(rest))
            weight[has] = self.logw[n][at[has]]
            out[~seen] = weight + self.find(n - 1, rest & _low(n - 1))
        return out


def train(docs: DataFrame) -> str:
    """Counts the n-grams of all documents; returns the folder of the counts, with one of its own for each band."""
    dest = scratch(docs.sparkSession, "ngrams")
    counted = count_ngrams(docs)
    counted.sortWithinPartitions("band", "key").write.partitionBy("band").parquet(dest)
    return dest


def model_of(dest: str, band: int, closed: bool = False) -> Model | None:
    """A band's model, made once in a Python worker (and closed, if only counted texts will be asked); those used last stay, up to HELD n-grams."""
    if (dest, band, closed) in _models:
        _models[dest, band, closed] = _models.pop((dest, band, closed))
        return _models[dest, band, closed]
    from pyarrow import fs
    from pyarrow import parquet as pq

    files, folder = file_system(dest)
    found = [x.path for x in files.get_file_info(fs.FileSelector(f"{folder}/band={band}", allow_not_found=True)) if x.path.endswith(".parquet")]
    parts = [pq.read_table(x, columns=["key", "n"], filesystem=files, partitioning=None) for x in found]
    if not parts:
        return None
    made = Model(*_summed([x.column("key").to_numpy().view(np.uint64) for x in parts], [x.column("n").to_numpy() for x in parts]))
    del parts
    if closed:
        made.closed()
    while _models and sum(len(m.keys[ORDER]) for m in _models.values()) + len(made.keys[ORDER]) > HELD:
        del _models[next(iter(_models))]
    _models[dest, band, closed] = made
    return made


def rules(texts: list[str]) -> dict[str, list[int]]:
    """The rules' counts, by text."""
    white, out = " \t\n\x0b\x0c\r", {}
    hashes, firsts = word_hashes([t.encode() for t in texts])
    sizes = np.diff(firsts)
    out["n_words"] = sizes.tolist()
    out["word_chars"] = [len(t) - sum(map(t.count, white)) for t in texts]
    out["n_symbols"] = [sum(map(t.count, SYMBOLS)) for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(white)] for t in texts]
    out["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
    runs = run_hashes(hashes, WINDOW)
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = doc[: len(runs)] == doc[WINDOW - 1 : WINDOW - 1 + len(runs)]
    at = np.flatnonzero(whole)
    keyed = runs[at] ^ mixed(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    out["n_repeat_words"] = (covered[firsts[1:]] - covered[firsts[:-1]]).tolist()
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MADE = [*COUNTS, "band", *BANDS, "base_failed", "kept"]


def with_figures(docs: DataFrame, dest: str) -> DataFrame:
    """docs with the rules' counts, band (a number of the language) and the figures; dest: the folder of the n-gram counts."""
    kept = docs.drop(*MADE)
    names = kept.columns
    schema = ", ".join([f"`{n}` {t}" for n, t in kept.dtypes] + ["band long"] + [f"{c} long" for c in COUNTS] + [f"{c} double" for c in BANDS])

    def run(batches):
        take_up("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                texts, bands = [t or "" for t in part.column("text").to_pylist()], part.column("band").to_pylist()
                figures: list = [None] * len(texts)
                for band in sorted(set(bands)):
                    own = [i for i, x in enumerate(bands) if x == band and texts[i]]
                    if not own or (model := model_of(dest, band, closed=True)) is None:
                        continue
                    keys, firsts = char_keys([texts[i] for i in own])
                    new, where = np.unique(keys, return_inverse=True)
                    means = np.add.reduceat(model.find(ORDER, new)[where], firsts[:-1]) / np.diff(firsts)
                    for i, x in zip(own, means.tolist(), strict=True):
                        figures[i] = -x
                counts = rules(texts)
                by_word = [None if x is None or not n else x * len(t) / n for x, n, t in zip(figures, counts["n_words"], texts, strict=True)]
                cols = [part.column(n) for n in names] + [part.column("band")] + [pa.array(counts[c], pa.int64()) for c in COUNTS] + [pa.array([None if x is None else float(f"{x:.4g}") for x in own], pa.float64()) for own in (figures, by_word)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "band", *COUNTS, *BANDS])

    return kept.withColumn("band", band_of(kept)).mapInArrow(run, schema)


def fences(done: DataFrame, figure: str = "log_perplexity") -> DataFrame:
    """_band, _q1, _q3: exact quartiles of the rounded figures (the smallest figure that a quarter, or three, do not exceed)."""
    counts = done.filter(F.col(figure).isNotNull()).groupBy("band", figure).agg(F.count("*").alias("_n"))  # a row for each figure of four digits
    by_figure = Window.partitionBy("band").orderBy(figure)
    sums = counts.select("band", figure, F.sum("_n").over(by_figure).alias("_upto"), F.sum("_n").over(Window.partitionBy("band")).alias("_all"))
    at = lambda share: F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col(figure)))
    return sums.groupBy(F.col("band").alias("_band")).agg(at(0.25).alias("_q1"), at(0.75).alias("_q3"))


def judged(docs: DataFrame, columns: list[str] | None = None, bands: dict = BANDS) -> DataFrame:
    """The given columns of docs (all unless given) with the counts, band, the figures, base_failed and kept."""
    dest = train(docs)
    columns = [c for c in (columns or docs.columns) if c not in MADE]
    asked = dict.fromkeys([*columns, "text", *(["lang"] if "lang" in docs.columns else [])])
    done = measured = stored(with_figures(docs.select(*asked), dest).select(*columns, *COUNTS, "band", *BANDS), "quality")
    inside = F.lit(True)
    for k, (figure, (size, spread, slack, least)) in enumerate(bands.items()):
        low, high = f"_low{k}", f"_high{k}"
        own = stored(fences(measured, figure), "fences").select(F.col("_band").alias(f"_b{k}"), F.col("_q1").alias(low), F.col("_q3").alias(high))  # a row a language, of known size
        done = done.join(own, F.col("band") == F.col(f"_b{k}"), "left")
        gap = F.greatest(F.col(high) - F.col(low), F.lit(least)) * spread + slack / F.sqrt(F.greatest(size, F.lit(1)))
        inside = inside & F.coalesce(F.col(figure).between(F.col(low) - gap, F.col(high) + gap), F.lit(False))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return done.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).select(*columns, *MADE)
