"""Byte-level BPE by a rank file, with a segment tree for the merges.

A piece's tree has a leaf for each byte position; the leaf holds the rank of the pair that begins there, with the
position in the low bits, so the root is the leftmost pair of least rank. A merge writes the merged token at its
position and corrects the leaves of the merged pair, of its left live neighbour and of the swallowed position, each
with one climb to the root: O(log n) for a merge. Pieces up to 32 bytes are merged many at a time, one row of numpy
arrays to a piece; longer ones singly.

Nulls and odd rows: null text is empty and has no ids; every row gives a row, in whatever number; other columns of
the input are kept under their names, but for `ids` and `decoded`, which this operator writes.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Remembered
from .common import take_up, worker_models

_models: dict = worker_models.setdefault("bpe", {})
WIDE = 32


class Ranks:
    """A rank file in memory: bytes of each id, and for each pair of ids that concatenate to a token that token's id.

    A token's id is its rank. Pairs are a sorted array of left * 2**20 + right, searched by bisection.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        # \s of the pattern's own library is Unicode's White_Space
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.tokens = [b""] * (max(self.of.values()) + 1)
        for token, i in self.of.items():
            self.tokens[i] = token
        pairs = {}
        for token, i in self.of.items():
            for k in range(1, len(token)):
                left, right = self.of.get(token[:k]), self.of.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], np.int64)
        self.none = len(self.tokens)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], self.none)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Pieces of 2 to WIDE bytes, all by numpy."""
        n, width = len(pieces), WIDE
        ids = np.full((n, width + 1), -1, np.int64)
        size = np.array([len(p) for p in pieces])
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        inside = np.arange(width + 1) < size[:, None]
        ids[inside] = flat
        after = np.tile(np.arange(1, width + 2), (n, 1))  # the next live position
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.empty((n, 2 * width), np.int64)
        tree[:, width:] = self.ranks(ids[:, :-1], ids[:, 1:]) << 8 | np.arange(width)
        for level in (width >> k for k in range(1, width.bit_length())):
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.flatnonzero(tree[:, 1] >> 8 < self.none)
        while len(row):
            root = tree[row, 1]
            at = root & 255
            gone = after[row, at]
            new = after[row, gone]
            ids[row, at], ids[row, gone] = root >> 8, -1
            after[row, at] = new
            before[row, np.minimum(new, width)] = at
            back = before[row, at]
            right = np.where(new <= width, ids[row, np.minimum(new, width)], -1)
            own = self.ranks(ids[row, at], right) << 8 | at
            left = self.ranks(np.where(back >= 0, ids[row, np.maximum(back, 0)], -1), ids[row, at]) << 8 | np.maximum(back, 0)
            dead = self.none << 8 | np.minimum(gone, width - 1)
            first = np.maximum(back, 0)
            left = np.where(back >= 0, left, own)
            first = np.where(back >= 0, first, at)
            for spot, value in ((at, own), (np.minimum(gone, width - 1), dead), (first, left)):
                node = spot + width
                tree[row, node] = value
                while node[0] > 1:
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            row = row[tree[row, 1] >> 8 < self.none]
        live = ids[:, :width] >= 0
        flat, ends = ids[:, :width][live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def merge_one(self, piece: bytes) -> list[int]:
        """A piece of any length, by a tree in lists."""
        n, none, pairs = len(piece), self.none, self.pairs
        ids = [self.of[piece[i : i + 1]] for i in range(n)]
        width = 1 << max(0, n - 1).bit_length()
        shift = width.bit_length()
        dead = none << shift
        tree = [dead] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pairs.get(ids[i] << 20 | ids[i + 1], none) << shift | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1

        def put(i: int, rank: int) -> None:
            node = width + i
            tree[node] = rank << shift | i
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    return
                tree[node] = best

        while tree[1] >> shift < none:
            at, rank = tree[1] & low, tree[1] >> shift
            gone = after[at]
            new = after[at] = after[gone]
            ids[at], ids[gone] = rank, -1
            if new < n:
                before[new] = at
            put(gone, none)
            put(at, pairs.get(rank << 20 | ids[new], none) if new < n else none)
            if before[at] >= 0:
                put(before[at], pairs.get(ids[before[at]] << 20 | rank, none))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        out: list = [[self.of[b]] if b in self.of else None for b in raw]
        short = [i for i, b in enumerate(raw) if out[i] is None and len(b) <= WIDE]
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            for i, ids in zip(some, self.merge_many([raw[i] for i in some]), strict=True):
                out[i] = ids
        return [self.merge_one(b) if x is None else x for x, b in zip(out, raw, strict=True)]

    def encode_chunks(self, new: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(c) for c in new]
        pieces = list({p for x in cut for p in x})
        known = dict(zip(pieces, (np.array(x, "<u4").tobytes() for x in self.encode_pieces(pieces)), strict=True))
        return [b"".join([known[p] for p in x]) for x in cut]


def model(path: str, pattern: str) -> tuple[Ranks, Remembered]:
    """One per Python worker."""
    if (path, pattern) not in _models:
        ranks = Ranks(path, pattern)
        _models[path, pattern] = ranks, Remembered(ranks.encode_chunks)
    return _models[path, pattern]


def _tokens(path: str) -> list[bytes]:
    """The bytes of each id; one list per Python worker."""
    if path not in _models:
        with open(path, "rb") as f:
            of = {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(bytes.strip, f))}
        _models[path] = [of.get(i, b"") for i in range(max(of) + 1)]
    return _models[path]


def _plus(df: DataFrame, fields: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    """df with columns that make(batch) returns, in Arrow batches of bounded size; columns of those names are replaced."""
    kept = df.drop(*(f[0] for f in fields))
    schema = ", ".join([f"`{n}` {t}" for n, t in kept.dtypes] + [f"{n} {t}" for n, _, t in fields])

    def run(batches):
        take_up("bpe")
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                own = [part.column(i) for i, n in enumerate(part.schema.names) if n not in {f[0] for f in fields}]
                names = [n for n in part.schema.names if n not in {f[0] for f in fields}]
                yield pa.RecordBatch.from_arrays([*own, *make(part)], names=[*names, *(f[0] for f in fields)])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids, an array of ints: each match of the pattern encoded by the ranks in the file of that path; and with
    decoded, the bytes of those ids, if asked for (in the same task, as a second Python worker would need the ranks too)."""

    def make(batch):
        coded = model(ranks, pattern)[1].encode([x or "" for x in batch.column(text).to_pylist()])
        ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
        if decoded:
            tokens = model(ranks, pattern)[0].tokens
            own = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in coded]
            out.append(pa.array(own, pa.binary()))
        return out

    return _plus(docs, [("ids", pa.list_(pa.int32()), "array<int>")] + [("decoded", pa.binary(), "binary")] * decoded, make)


def decode(coded: DataFrame, ranks: str) -> DataFrame:
    """A frame with ids, with decoded: the ids' bytes, one after another. Null ids give null; an id that the file lacks fails."""

    def make(batch):
        tokens = _tokens(ranks)
        return [pa.array([None if x is None else b"".join([tokens[i] for i in x]) for x in batch.column("ids").to_pylist()], pa.binary())]

    return _plus(coded, [("decoded", pa.binary(), "binary")], make)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    both = encode(docs.select("doc_id", "text"), ranks, pattern, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
