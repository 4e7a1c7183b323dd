"""Phrases of two and three words that stand together more often than their parts would have it, by language.

Texts are coded once: a task writes slices of one language, each with its distinct words, their counts, and the words of its
pieces as numbers in a row, with a break between pieces. What follows reads these slices.

1. Word counts are summed. A phrase can only be frequent if its words are (Apriori).
2. For every pair and triple of frequent words next to each other, a task counts hash buckets (as many buckets as the language has
   words, at least 65,536), and the counts are summed by block of 65,536 buckets. A bucket's sum is at least the count of each
   phrase in it, so phrases in buckets below the least count, and triples with a pair in such a bucket, cannot be frequent.
3. The phrases that are left are listed: a superset of the frequent ones. They are dealt into blocks by a hash of their first
   two words, a block for every `WORDS_A_BLOCK` words of the language; for each block a double-array trie over its words is made
   and written.
4. A task loads one block's trie at a time and advances all positions of its slices that the hash sends there at once: a step of all
   states by the two digits of their first word, of those still in the trie by the second, then the third; accepting states
   are counted by bincount, and the counts of all tasks are summed. These counts are exact.

Tries, frequent words and buckets are read part by part from the shared folder, so that a task holds parts of bounded size; how many
there are grows with the corpus, and each task reads all those of the languages that it has slices of. Rows between tasks are
packed: one holds a task's buckets, phrases or counts of one block. Scores are products and integral quotients of decimals of 38
digits (exact for counts below 10**16).

Nulls and odd rows: null text is empty; null lang is `und`; repeated rows count as often as they stand; an empty table gives an
empty result; other columns are not looked at. A text of any length is whole: slices of one text share two words, of which only
the first slice counts starts.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, scratch, stored
from .words import mixed, word_hashes

SLICE, WORDS_A_BLOCK, WORDS_A_FILE, BUCKETS = 1_000_000, 4_000_000, 50_000_000, 1 << 16
ARRAYS = ["base", "check", "accepts"]
_marks = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_NONE, _WORD = np.uint64(0), (1 << 21) - 1


def coded(docs: DataFrame) -> DataFrame:
    """lang, words, counts, ids, n, own: slices of one language's pieces. ids: n little-endian 32-bit numbers, compressed, 0 for a break, else
    one more than the place in words; phrases start at the first `own` of them. counts: of each word in these."""

    def run(batches):
        held: dict[str, list] = {}

        def made(lang: str):
            numbers, parts, _ = held.pop(lang)
            ids, words = np.concatenate(parts), list(numbers)[2:]
            for lo in range(0, len(ids), SLICE + SLICE // 2):
                hi = min(len(ids), lo + SLICE + SLICE // 2)
                some = ids[lo : min(len(ids), hi + 2)]
                used, small = np.unique(some, return_inverse=True)
                small = (small + (used[0] != 0)).astype(np.uint32)
                used = used[used != 0]
                tally = np.bincount(small[: hi - lo], minlength=len(used) + 1)[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([[words[k - 2] for k in used.tolist()]], pa.list_(pa.binary())), pa.array([tally], pa.list_(pa.int64())), pa.array([pa.compress(small.astype("<u4").tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([len(small)], pa.int64()), pa.array([hi - lo], pa.int64())],
                    names=["lang", "words", "counts", "ids", "n", "own"],
                )

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for k, lang in enumerate(langs):
                text = texts[k].as_py()
                if not text:
                    continue
                if lang not in held:
                    numbers: defaultdict = defaultdict(count().__next__)
                    numbers[b"\n"], numbers[b""]
                    held[lang] = [numbers, [], 0]
                own = held[lang]
                got = text.encode().lower().translate(_marks).replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(own[0].__getitem__, got), np.int64, len(got))
                ids = np.append(ids[ids != 1], 0).astype(np.int32)
                own[1].append(ids)
                own[2] += len(ids)
                if sum(x[2] for x in held.values()) > SLICE:
                    yield from made(max(held, key=lambda x: held[x][2]))
        for lang in list(held):
            yield from made(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    out = docs.select(lang.alias("lang"), "text").mapInArrow(run, "lang string, words array<binary>, counts array<bigint>, ids binary, n long, own long")
    return stored(out, "phrase-slices")


def word_counts(slices: DataFrame) -> DataFrame:
    """lang, word, f, h: f of every word, and its 64-bit hash as a signed number."""
    counted = slices.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_hashes([b" ".join(words)])[0].view(np.int64))], names=["lang", "word", "f", "h"])

    return stored(counted.mapInArrow(run, "lang string, word binary, f long, h long"), "phrase-words")


def _written(df: DataFrame, name: str, sizes: dict[str, int] | None = None) -> str:
    """Writes rows in folders by language (its UTF-8 in hex), and by block, or with sizes in a file for each WORDS_A_FILE words of the language;
    returns the folder of all."""
    dest = scratch(df.sparkSession, name)
    named = df.withColumn("_lang", F.concat(F.lit("x"), F.hex(F.encode("lang", "utf-8"))))
    if sizes is None:
        named.withColumn("_block", F.col("block")).drop("lang").write.partitionBy("_lang", "_block").parquet(dest)
    else:
        many = F.lit(1)
        for lang, n in sizes.items():
            many = F.when(F.col("lang") == lang, -(-n // WORDS_A_FILE)).otherwise(many)
        named.repartition("_lang", F.pmod(F.xxhash64(*df.columns), many)).drop("lang").write.partitionBy("_lang").parquet(dest)
    return dest


def _batches(dest: str, lang: str, columns: list[str], rows: int = 2_000_000, block: int | None = None):
    """A language's rows (or those of one block), file by file and at most so many at a time."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    files, folder = file_system(dest)
    where = f"{folder}/_lang=x{lang.encode().hex().upper()}" + ("" if block is None else f"/_block={block}")
    found = files.get_file_info(fs.FileSelector(where, allow_not_found=True, recursive=True))
    for path in sorted(x.path for x in found if x.path.endswith(".parquet")):
        with files.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=rows, columns=columns)


class _Read:
    """What a task has read of a language, kept while it is small and only for the language used last."""

    def __init__(self, read, size, most: int = 64_000_000):
        self.read, self.size, self.most, self.lang, self.kept = read, size, most, None, None

    def __call__(self, lang: str):
        if self.lang == lang and self.kept is not None:
            yield from self.kept
            return
        self.lang, self.kept, held, total = lang, None, [], 0
        for one in self.read(lang):
            total += self.size(one)
            if total <= self.most:
                held.append(one)
            yield one
        if total <= self.most:
            self.kept = held


def _frequent(words_dest: str) -> _Read:
    """Sorted hashes of a language's frequent words, in parts."""
    return _Read(lambda lang: (np.sort(b.column("h").to_numpy().view(np.uint64)) for b in _batches(words_dest, lang, ["h"])), lambda x: x.nbytes)


def _inside(sorted_parts, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for part in sorted_parts:
        if len(part):
            at = np.minimum(np.searchsorted(part, keys), len(part) - 1)
            out |= part[at] == keys
    return out


def _slices(batch):
    """lang, words, their hashes, ids, own of each row of a batch, a language after the other."""
    langs = batch.column("lang").to_pylist()
    for k in sorted(range(len(langs)), key=lambda k: (langs[k], k)):
        words = batch.column("words")[k].values.to_pylist()
        ids = np.frombuffer(pa.decompress(batch.column("ids")[k].as_buffer(), 4 * batch.column("n")[k].as_py(), "zstd"), "<u4")
        yield langs[k], words, word_hashes([b" ".join(words)])[0], ids, batch.column("own")[k].as_py()


def _frequent_hashes(frequent, lang: str, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """By position: the word's hash, 0 for breaks and words that are not frequent."""
    own = np.where(_inside(frequent(lang), hashes), np.where(hashes == _NONE, np.uint64(1), hashes), _NONE)
    return np.append(_NONE, own)[ids]


def _mixed_pairs(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    """A hash of each a with its b, 0 where either is 0; part by part, so that little is held beside the result."""
    out = np.zeros(len(a), np.uint64)
    for lo in range(0, len(a), BUCKETS):
        x, y = a[lo : lo + BUCKETS], b[lo : lo + BUCKETS]
        at = np.flatnonzero((x != _NONE) & (y != _NONE))
        out[lo + at] = mixed(x[at] * np.uint64(factor) + y[at]) | np.uint64(1)
    return out


def _pairs(h: np.ndarray) -> np.ndarray:
    """At each position the hash of its word and the next, 0 without a pair of frequent words."""
    return _mixed_pairs(h, np.append(h[1:], _NONE), 3)


def _triples(pair: np.ndarray) -> np.ndarray:
    """The triple's hash from those of its two pairs, 0 without both."""
    return _mixed_pairs(pair, np.append(pair[1:], _NONE), 5)


def _bits(n: int) -> int:
    """Bits of a bucket's number for a language of n words."""
    return min(60, max(16, int(n - 1).bit_length()))


def bucket_sums(slices: DataFrame, words_dest: str, sizes: dict[str, int], least: int) -> DataFrame:
    """lang, size (2 or 3), block, buckets: little-endian 16-bit numbers of the block's buckets with at least so many phrases. sizes: words
    of each language."""

    def count_(batches):
        frequent = _frequent(words_dest)

        def rows(lang, size, keys):
            buckets, n = np.unique(keys[keys != _NONE] >> np.uint64(64 - _bits(sizes[lang])), return_counts=True)
            blocks, starts = np.unique(buckets >> np.uint64(16), return_index=True)
            low, n = (buckets & np.uint64(0xFFFF)).astype("<u2"), np.minimum(n, 255).astype(np.uint8)
            ends = np.append(starts[1:], len(buckets))
            cut = list(zip(starts.tolist(), ends.tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cut), pa.string()), pa.array([size] * len(cut), pa.int32()), pa.array(blocks.astype(np.int64)), pa.array([low[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cut], pa.binary())],
                names=["lang", "size", "block", "buckets", "n"],
            )

        held: dict[str, tuple[list, list, int]] = {}

        def made(lang):
            two, three, _ = held.pop(lang)
            yield rows(lang, 2, np.concatenate(two))
            yield rows(lang, 3, np.concatenate(three))

        for batch in batches:
            for lang, _, hashes, ids, own in _slices(batch):
                h = _frequent_hashes(frequent, lang, hashes, ids)
                pair = _pairs(h)
                old = held.get(lang, ([], [], 0))
                held[lang] = [*old[0], pair[:own]], [*old[1], _triples(pair)[:own]], old[2] + own
                if held[lang][2] > SLICE:
                    yield from made(lang)
        for lang in list(held):
            yield from made(lang)

    def total(key, table):
        sums = np.zeros(BUCKETS, np.int64)
        for low, n in zip(table.column("buckets").to_pylist(), table.column("n").to_pylist(), strict=True):
            sums[np.frombuffer(low, "<u2")] += np.frombuffer(n, np.uint8)
        full = np.flatnonzero(sums >= least).astype("<u2")
        own = pa.table([*(pa.array([k.as_py()], t) for k, t in zip(key, (pa.string(), pa.int32(), pa.int64()), strict=True)), pa.array([full.tobytes()], pa.binary())], names=["lang", "size", "block", "buckets"])
        return own if len(full) else own.slice(0, 0)

    each = slices.select("lang", "words", "ids", "n", "own").mapInArrow(count_, "lang string, size int, block long, buckets binary, n binary")
    return each.groupBy("lang", "size", "block").applyInArrow(total, "lang string, size int, block long, buckets binary")


def _block(pair: np.ndarray, n: int) -> np.ndarray:
    """The trie block of a pair's hash in a language of n words."""
    return (pair >> np.uint64(8)) % np.uint64(max(1, -(-n // WORDS_A_BLOCK)))


class _Seen:
    """Phrases that a task has listed of a language, as numbers of 21 bits a word."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict(count().__next__)
        self.two, self.three = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def mapped(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def full(self, more: int) -> bool:
        """Whether so many more words may pass 21 bits, or the phrases their bound."""
        return len(self.numbers) + more > 1 << 21 or len(self.two) + len(self.three) > 3_000_000


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; by a sort, which takes less than np.unique's hash table."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _new(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys (distinct, sorted) are not among the seen ones (sorted too), and all of both."""
    fresh = ~_inside([seen], keys)
    return fresh, np.insert(seen, np.searchsorted(seen, keys[fresh]), keys[fresh])


class _Full:
    """Full buckets of some blocks, a bit for each bucket of a block; where[b] is one more than the place of block b, 0 of others."""

    def __init__(self, blocks: list[int], buckets: list[bytes]):
        self.where = np.zeros(max(blocks, default=-1) + 2, np.int64)
        self.bits = np.zeros((len(blocks) + 1, BUCKETS // 8), np.uint8)
        for k, (block, raw) in enumerate(zip(blocks, buckets, strict=True), 1):
            own = np.zeros(BUCKETS, bool)
            own[np.frombuffer(raw, "<u2")] = True
            self.where[block], self.bits[k] = k, np.packbits(own, bitorder="little")
        self.nbytes = self.bits.nbytes + self.where.nbytes

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Which bucket numbers are full ones of these blocks."""
        place = self.where[np.minimum(keys >> np.uint64(16), np.uint64(len(self.where) - 1)).astype(np.int64)]
        low = (keys & np.uint64(BUCKETS - 1)).astype(np.int64)
        return (self.bits.reshape(-1)[place * (BUCKETS // 8) + (low >> 3)] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def candidates(slices: DataFrame, words_dest: str, buckets_dest: str, sizes: dict[str, int]) -> DataFrame:
    """lang, block, phrases (words joined by a space): all phrases in full buckets; a task lists each once (or a few times)."""

    def numbers(batch) -> tuple[_Full, _Full]:
        out: dict[int, tuple[list, list]] = {2: ([], []), 3: ([], [])}
        for size, block, raw in zip(*(batch.column(c).to_pylist() for c in ("size", "block", "buckets")), strict=True):
            out[size][0].append(block)
            out[size][1].append(raw)
        return _Full(*out[2]), _Full(*out[3])

    def run(batches):
        frequent = _frequent(words_dest)
        full = _Read(lambda lang: map(numbers, _batches(buckets_dest, lang, ["size", "block", "buckets"], 2048)), lambda x: x[0].nbytes + x[1].nbytes)
        seen: dict[str, _Seen] = {}
        for batch in batches:
            for lang, words, hashes, ids, own in _slices(batch):
                h = _frequent_hashes(frequent, lang, hashes, ids)
                shift = np.uint64(64 - _bits(sizes[lang]))
                pair = _pairs(h)
                keys, some = pair >> shift, np.flatnonzero(pair)
                good = np.zeros(len(some), bool)
                for two, _ in full(lang):
                    good |= two.among(keys[some])
                pair[some[~good]] = _NONE
                triple = _triples(pair)
                keys, some = triple >> shift, np.flatnonzero(triple[:own])
                good = np.zeros(len(some), bool)
                for _, three in full(lang):
                    good |= three.among(keys[some])
                at3, at2 = some[good], np.flatnonzero(pair[:own])
                if lang not in seen or seen[lang].full(len(words)):
                    seen[lang] = _Seen()
                known = seen[lang]
                task = np.append(-1, known.mapped(words))  # below 2**21: a slice has fewer words
                twos = _distinct(task[ids[at2]] << 21 | task[ids[at2 + 1]])
                threes = _distinct(task[ids[at3]] << 42 | task[ids[at3 + 1]] << 21 | task[ids[at3 + 2]])
                new2, known.two = _new(twos, known.two)
                new3, known.three = _new(threes, known.three)
                place = np.zeros(len(known.numbers), np.int64)  # in this slice
                place[task[1:]] = np.arange(len(words))
                a, b = place[twos[new2] >> 21], place[twos[new2] & _WORD]
                phrases = [words[i] + b" " + words[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                x, y, z = (place[threes[new3] >> shift_ & _WORD] for shift_ in (42, 21, 0))
                phrases += [words[i] + b" " + words[j] + b" " + words[k] for i, j, k in zip(x.tolist(), y.tolist(), z.tolist(), strict=True)]
                own_hashes = np.where(hashes == _NONE, np.uint64(1), hashes)
                blocks = _block(_mixed_pairs(own_hashes[np.append(a, x)], own_hashes[np.append(b, y)], 3), sizes[lang])
                order = np.argsort(blocks, kind="stable")
                values = pa.array(phrases, pa.binary()).take(pa.array(order))
                named, starts = np.unique(blocks[order], return_index=True)
                if len(named):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(named), pa.string()), pa.array(named.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(phrases)), pa.int32()), values)], names=["lang", "block", "phrases"])

    return slices.select("lang", "words", "ids", "n", "own").mapInArrow(run, "lang string, block long, phrases array<binary>")


class Trie:
    """A double-array trie of phrases over numbered words, two digits a word: the child of state s by digit d is base[s] + d, if check of that
    is s. Digits are below the root of the number of words, so that the children of a state lie close together."""

    def __init__(self, phrases: list[bytes]):
        """phrases: of two or three words, each once; accepts[s] is a phrase's place, -1 elsewhere."""
        split = [p.split(b" ") for p in phrases]
        self.words = sorted(set().union(*split))
        number = {w: k for k, w in enumerate(self.words, 1)}
        codes = np.zeros((len(split), 3), np.int64)
        for k, p in enumerate(split):
            codes[k, : len(p)] = [number[w] for w in p]
        self.radix = int(np.ceil(np.sqrt(len(self.words) + 1)))
        digits = np.stack(self.digits(codes), axis=2).reshape(len(split), 6)
        node, parents, symbols, total = np.zeros(len(split), np.int64), [np.array([-1])], [np.array([0])], 1
        for level in range(6):  # a node of level n is a distinct row of n digits
            live = np.flatnonzero(digits[:, level])
            keys, where = np.unique(node[live] << 32 | digits[live, level], return_inverse=True)
            parents.append(keys >> 32)
            symbols.append(keys & 0xFFFFFFFF)
            node[live] = total + where
            total += len(keys)
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)
        slot, base = self._placed(parent, symbol)
        self.base, self.check, self.accepts = (np.full(int(slot.max()) + 1, x, np.int32) for x in (0, -1, -1))
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent[1:]]
        self.accepts[slot[node]] = np.arange(len(split))

    def digits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both digits of word numbers, from 1; 0 and 0 of no word."""
        return np.where(codes > 0, codes // self.radix + 1, 0), np.where(codes > 0, codes % self.radix + 1, 0)

    @staticmethod
    def _placed(parent: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's state and base. Nodes with several children are placed first, those with most before others, where they fit first; a
        stretch with no place for one of them is left to the nodes with a single child."""
        order = np.argsort(parent[1:], kind="stable") + 1
        owners, starts, sizes = np.unique(parent[order], return_index=True, return_counts=True)
        slot, base = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
        taken = np.zeros(2 * len(parent) + 4096, bool)
        taken[0], low = True, 1
        for g in np.argsort(-sizes, kind="stable").tolist():
            if sizes[g] == 1:
                break
            codes = symbol[order[starts[g] : starts[g] + sizes[g]]]
            span = codes - codes[0]
            while True:
                if low + 2048 + span[-1] > len(taken):
                    taken = np.append(taken, np.zeros(len(taken), bool))
                free = low + np.flatnonzero(~taken[low : low + 1024])[:128]
                fits = ~taken[free[:, None] + span].any(axis=1)
                if fits.any():
                    break
                low += 512
            at = free[np.argmax(fits)]
            taken[at + span] = True
            slot[order[starts[g] : starts[g] + sizes[g]]] = at + span
            base[owners[g]] = at - codes[0]
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        free = np.append(free, len(taken) + np.arange(len(single) - len(free)))
        slot[order[starts[single]]] = free
        base[owners[single]] = free - symbol[order[starts[single]]]
        return slot, base

    def step(self, states: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """The states after one more digit, -1 where there is none."""
        to = self.base[states] + digits
        to = np.where((digits > 0) & (to >= 0) & (to < len(self.check)), to, 0)
        return np.where(self.check[to] == states, to, -1)

    def count(self, codes: list[np.ndarray]) -> np.ndarray:
        """By state: how often its phrase stands among rows of three word numbers (0: no word)."""
        at, states, out = np.arange(len(codes[0])), np.zeros(len(codes[0]), np.int64), np.zeros(len(self.base), np.int64)
        for k, row in enumerate(codes):
            for digits in self.digits(row):
                states = self.step(states, digits[at])
                live = states >= 0
                states, at = states[live], at[live]
            if k:
                out += np.bincount(states, minlength=len(out))
        return out


def tries(listed: DataFrame) -> str:
    """Writes a trie for every block of each language's phrases, in a folder of its own; returns the folder of them all."""

    def made(key, table):
        found = sorted(set(table.column("phrases").combine_chunks().flatten().to_pylist()))
        trie = Trie(found)
        arrays = [pa.array([getattr(trie, n).astype("<i4").tobytes()], pa.binary()) for n in ARRAYS]
        lists = [pa.array([x], pa.list_(pa.binary())) for x in (trie.words, found)]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), *lists, *arrays], names=["lang", "block", "words", "phrases", *ARRAYS])

    built = listed.groupBy("lang", "block").applyInArrow(made, "lang string, block long, words array<binary>, phrases array<binary>, base binary, check binary, accepts binary")
    return _written(built, "phrase-tries")


def _trie(batch, k: int) -> Trie:
    trie = Trie.__new__(Trie)
    for n in ARRAYS:
        setattr(trie, n, np.frombuffer(batch.column(n)[k].as_py(), "<i4"))
    trie.words = batch.column("words")[k].values.to_pylist()
    trie.radix = int(np.ceil(np.sqrt(len(trie.words) + 1)))
    return trie


def counted(slices: DataFrame, words_dest: str, tries_dest: str, sizes: dict[str, int]) -> DataFrame:
    """lang, phrase, f: how often each phrase of the tries stands in the slices."""

    def run(batches):
        frequent = _frequent(words_dest)

        def told(lang, some):
            """Counts of one language's slices, block after block. Their words are numbered once for all of them, so that a trie's words are looked
            up once, however many slices hold them."""
            known: defaultdict = defaultdict(count(1).__next__)
            for k, (words, ids, order, blocks) in enumerate(some):
                task = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                some[k] = np.append(np.int32(0), task)[ids], order, blocks
            del words, ids, order, blocks
            for batch in _batches(tries_dest, lang, ["block", "words", *ARRAYS], 1):
                block, trie, sums = batch.column("block")[0].as_py(), _trie(batch, 0), 0
                codes = np.zeros(len(known) + 1, np.int64)
                codes[np.fromiter((known.get(w, 0) for w in trie.words), np.int64, len(trie.words))] = np.arange(1, len(trie.words) + 1)
                codes[0] = 0
                for ids, order, blocks in some:
                    at = order[np.searchsorted(blocks, block) : np.searchsorted(blocks, block, "right")]
                    sums = sums + trie.count([codes[ids[at + k]] for k in range(3)])
                ends = np.flatnonzero(sums * (trie.accepts >= 0))
                if len(ends):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block]), pa.array([trie.accepts[ends].astype("<u4").tobytes()], pa.binary()), pa.array([sums[ends].astype("<u4").tobytes()], pa.binary())], names=["lang", "block", "places", "n"])

        held: dict[str, list] = defaultdict(list)
        for batch in batches:
            for lang, words, hashes, ids, own in _slices(batch):
                pair = _pairs(_frequent_hashes(frequent, lang, hashes, ids))[:own]
                order = np.flatnonzero(pair)
                blocks = _block(pair[order], sizes[lang])
                by_block = np.argsort(blocks, kind="stable")
                held[lang].append((words, np.append(ids, np.zeros(2, ids.dtype)), order[by_block].astype(np.int32), blocks[by_block].astype(np.int32)))
                if sum(len(x[1]) for own_ in held.values() for x in own_) > 4 * SLICE:  # of all languages; each reading of the tries serves as many slices as that
                    most = max(held, key=lambda x: sum(len(y[1]) for y in held[x]))
                    yield from told(most, held.pop(most))
        for lang in list(held):
            yield from told(lang, held.pop(lang))

    def total(key, table):
        lang, block = (k.as_py() for k in key)
        phrases = next(_batches(tries_dest, lang, ["phrases"], 1, block)).column("phrases")[0].values
        sums = np.zeros(len(phrases), np.int64)
        for places, n in zip(table.column("places").to_pylist(), table.column("n").to_pylist(), strict=True):
            sums[np.frombuffer(places, "<u4")] += np.frombuffer(n, "<u4")
        found = np.flatnonzero(sums)
        return pa.table([pa.array([lang] * len(found), pa.string()), phrases.take(pa.array(found)), pa.array(sums[found])], names=["lang", "phrase", "f"])

    each = slices.select("lang", "words", "ids", "n", "own").mapInArrow(run, "lang string, block long, places binary, n binary")
    return each.groupBy("lang", "block").applyInArrow(total, "lang string, phrase binary, f long")


def frequent_phrases(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f), sizes (lang, n) and phrases (lang, phrase, f) of at least so many, phrases of two and three words."""
    slices = coded(docs)
    words = word_counts(slices)
    sizes = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-sizes")
    n = {r.lang: r.n for r in sizes.collect()}  # a row a language
    words_dest = _written(words.filter(F.col("f") >= least).select("lang", "h"), "phrase-frequent", n)
    buckets_dest = _written(bucket_sums(slices, words_dest, n, least), "phrase-buckets", n)
    tries_dest = tries(candidates(slices, words_dest, buckets_dest, n))
    phrases = stored(counted(slices, words_dest, tries_dest, n).filter(F.col("f") >= least), "phrase-counts")
    return words.select("lang", "word", "f"), sizes, phrases


def with_score(df: DataFrame) -> DataFrame:
    """df with score, floor(1000000 * a * a / (l * r)), in decimals of 38 digits."""
    product = lambda x, y: F.expr(f"CAST(CAST({x} AS DECIMAL(19,0)) * CAST({y} AS DECIMAL(19,0)) AS DECIMAL(38,0))")
    both = df.withColumn("_up", product("a", "a")).withColumn("_down", product("l", "r"))
    return both.withColumn("score", F.expr("CAST(_up * CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(38,0)) div _down")).drop("_up", "_down")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score (of the cut that scores least, ties to the earlier
    one), then count, then phrase. A phrase inside a longer one that stands at least share percent as often is left out."""
    words, sizes, found = frequent_phrases(docs, least)
    both = found.select("lang", F.decode("phrase", "utf-8").alias("phrase"), F.col("f").alias("a")).withColumn("_w", F.split("phrase", " ", -1))
    parts = words.select("lang", F.decode("word", "utf-8").alias("_p"), "f").filter(F.col("f") >= least).unionByName(both.select("lang", F.col("phrase").alias("_p"), F.col("a").alias("f")))
    size = F.size("_w")
    join = lambda lo, n: F.array_join(F.slice("_w", lo, n), " ")
    cuts = both.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("_k"), "_w").select("lang", "phrase", "a", "_k", join(F.lit(1), F.col("_k")).alias("_left"), join(F.col("_k") + 1, size - F.col("_k")).alias("_right"))
    side = lambda name, f: parts.select("lang", F.col("_p").alias(name), F.col("f").alias(f))
    scored = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"])
    scored = with_score(scored)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_b"))
    longer = both.filter(size == 3).select("lang", "a", F.explode(F.array(join(F.lit(1), F.lit(2)), join(F.lit(2), F.lit(2)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_longer") < share * F.col("a"), F.lit(True)))
    out = left.select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")  # a row a language


_WORDS = r"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, d, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), 1) AS k FROM t),
w AS (SELECT lang, d, k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT lang, d, k, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, w AS w1, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY d, k ORDER BY i)),"""
SQL = (
    _WORDS
    + """
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL), f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
c AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
    UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
    UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
o AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * a)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000"""
)
