"""Near-duplicates by a chosen-path set similarity join of 5-word shingle sets.

Texts are lower-cased in A-Z; a document's set are its distinct 5-word shingles (with fewer words, the whole sequence;
without words, nothing). Two documents are linked if 100 * |A and B| >= 85 * |A or B|.

1. Documents with equal sets are one node of what follows, under their smallest doc_id.
2. A set gets 128 minwise tokens. A tree's root sends each set down the branch of one token (its full 32 bits); so sets
   of likeness s part with chance 1 - s. A node with more than `open_pairs` pairs of sets that are not known to hang
   together branches again, by a token chosen by the node's path, and with a chance (0.18 for a threshold of 85 percent) by
   a second one, so that the expected number of paths that two sets at the threshold share does not fall with depth.
   Small nodes are compared exhaustively by their tokens, tile by tile: pairs whose estimate is not below `least_alike` (a
   pair at the threshold falls below it once in a million) and whose sizes allow the threshold are candidates.
   Nodes above `node` rows branch as Spark rows; smaller ones inside a task. What 48 tokens can't part is compared whole.
3. The candidates of two tiles that hang together are a group of at most 2 * TILE documents. A group's texts meet in one
   task, which counts the intersections of all its full sets exactly, as bits that two rows share, and sends on
   only enough confirmed links to connect what is linked. Groups that several trees find are confirmed once.
4. A first round links the bulk of every dense group cheaply: two trees, whose large root nodes are dealt at random into
   parts of at most TILE sets on average. It decides nothing; later rounds only pass over pairs that it has connected. The second
   round has `trees_needed(percent, 0, recall)` trees. With depth the chance falls that a pair shares some path, so each set
   that went deep gets as many more independent trees as `recall` (of pairs at the threshold) needs at its deepest level.
5. Components of the confirmed links give the result.

Nulls and odd rows: null and empty texts are linked with nothing; rows that share a doc_id are one document, linked with
whatever either is; a null doc_id never names a component: its row takes the component of an equal set that has an id,
or null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, take_up, text_slices
from .graph import components
from .words import mixed, run_hashes, word_hashes

WIDTH, TOKENS, ROOTS, TILE = 5, 128, 12, 128
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOTS = np.arange(ROOTS) * (TOKENS // ROOTS)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, firsts = word_hashes([t.encode().lower() for t in texts])
    runs = run_hashes(hashes, width)
    out = []
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        n = hi - lo
        out.append(np.unique(runs[lo : hi - width + 1]) if n >= width else run_hashes(hashes[lo:hi], n) if n else runs[:0])
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = 85) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def second_chance(percent: int) -> float:
    """Of a second branch, so that two sets at the threshold share at least one path a level, as expected."""
    return float(np.ceil(10_000 / percent - 100)) / 100


def least_alike(percent: int) -> float:
    """Estimated likeness that a pair at the threshold falls below once in a million."""
    return percent / 100 - 4.75 * float(np.sqrt(percent / 100 * (1 - percent / 100) / TOKENS))


def trees_needed(percent: int, depth: int, recall: float) -> int:
    """Trees in which a pair at the threshold shares a node so many levels below a root at least once, with chance `recall`."""
    s, p, q = percent / 100, second_chance(percent), 1.0
    for _ in range(depth):
        q = 1 - (1 - p) * (1 - s * q) - p * (1 - s * q) ** 2
    return int(np.ceil(np.log(1 - recall) / np.log(1 - s * q))) if s < 1 else 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, k1, k2 (a 128-bit name of the set), sig (the tokens' low bytes), roots (full tokens that begin the trees)."""
    fields = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("roots", pa.list_(pa.int64()))]

    def run(batches):
        take_up("near-duplicates")
        for rows in text_slices(batches, ["doc_id", "text_key"], chars=1_000_000):
            sets = shingle_sets(rows["text"])
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            tokens = np.zeros((len(sets), TOKENS), np.uint32)
            k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                starts = np.cumsum([0, *sizes[some][:-1]])
                for k in range(TOKENS):
                    tokens[some, k] = np.minimum.reduceat((flat * _FACTORS[k]) >> np.uint64(32), starts)
                k1[some] = np.add.reduceat(mixed(flat), starts)
                k2[some] = np.bitwise_xor.reduceat(mixed(flat + np.uint64(1)), starts)
            low = tokens.astype(np.uint8)
            cols = [rows["doc_id"], rows["text_key"], sizes, k1.view(np.int64), k2.view(np.int64), [x.tobytes() if n else None for x, n in zip(low, sizes, strict=True)], [x.tolist() if n else None for x, n in zip(tokens[:, _ROOTS].astype(np.int64), sizes, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return _texts(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig binary, roots array<long>")


def _leaves(ids: np.ndarray, sig: np.ndarray, seed: int, comps: np.ndarray, second: float, open_pairs: int, depth: int = 48):
    """Index arrays of the nodes below one node that are to be compared whole, and their levels: those with at most so many pairs
    between different components, and those that so many tokens didn't part. Nodes of one component are passed over."""
    stack = [(np.arange(len(ids)), seed, 0)]
    while stack:
        rows, path, level = stack.pop()
        counts = np.unique(comps[rows], return_counts=True)[1].astype(np.int64)
        if len(counts) == 1:
            continue
        if level >= depth or len(rows) ** 2 - (counts**2).sum() <= 2 * open_pairs:
            yield rows, level
            continue
        rng = np.random.default_rng(path)
        for k in rng.integers(0, TOKENS, 1 + (rng.random() < second)).tolist():
            values = sig[rows, k]
            order = np.argsort(values, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
                if len(part) > 1:
                    stack.append((rows[part], hash((path, k, int(values[part[0]]))) & (2**62 - 1), level + 1))


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens each of x shares with each of y."""
    if len(x) * len(y) <= 64:
        return (x[:, None, :] == y[None, :, :]).sum(axis=2)
    same = np.zeros((len(x), len(y)), np.uint8)
    for k in range(TOKENS):
        same += x[:, None, k] == y[None, :, k]
    return same


def _labels(linked_: np.ndarray) -> np.ndarray:
    """The components of a symmetric matrix of booleans: each row's smallest index."""
    n = len(linked_)
    out = np.full(n, -1)
    for i in range(n):
        if out[i] < 0:
            new = np.zeros(n, bool)
            new[i] = True
            while new.any():
                out[new] = i
                new = linked_[new].any(axis=0) & (out < 0)
    return out


def _tiles(ids: np.ndarray, sig: np.ndarray, sizes: np.ndarray, comps: np.ndarray, tile: int = TILE, shingles: int = 800) -> list[np.ndarray]:
    """Rows in runs of at most `tile` rows and `tile` * `shingles` shingles (or a single row); alike rows stand together."""
    n = len(ids)
    if n <= 2 * tile and sizes.sum() <= 2 * tile * shingles:
        return [np.arange(n)]
    _, where, counts = np.unique(comps, return_inverse=True, return_counts=True)
    order = np.lexsort((ids, sig[:, 1], sig[:, 0], np.where(counts[where] > 1, where, -1)))
    out, at, held = [], 0, 0
    for i, x in enumerate(sizes[order].tolist()):
        if i > at and (i - at >= tile or held + x > tile * shingles):
            out.append(order[at:i])
            at, held = i, 0
        held += x
    return [*out, order[at:]]


def _candidate_groups(ids: np.ndarray, sig: np.ndarray, sizes: np.ndarray, comps: np.ndarray, bound: int, percent: int):
    """Arrays of ids: for each two tiles, what hangs together by candidates between different components."""
    tiles = _tiles(ids, sig, sizes, comps)
    single = [bool((comps[x] == comps[x[0]]).all()) for x in tiles]
    for i, x in enumerate(tiles):
        for j in range(i, len(tiles)):
            y = tiles[j]
            if single[i] and single[j] and comps[x[0]] == comps[y[0]]:
                continue
            open_ = (_shared(sig[x], sig[y]) >= bound) & (comps[x][:, None] != comps[y][None, :])
            open_ &= 100 * np.minimum.outer(sizes[x], sizes[y]) >= percent * np.maximum.outer(sizes[x], sizes[y])
            if not open_.any():
                continue
            if i != j:
                rows, whole = np.concatenate([x, y]), np.zeros((len(x) + len(y),) * 2, bool)
                whole[: len(x), len(x) :] = open_
                whole[len(x) :, : len(x)] = open_.T
            else:
                rows, whole = x, open_
            some = whole.any(axis=0)
            rows, labels = rows[some], _labels(whole[some][:, some])
            for label in np.unique(labels).tolist():
                yield np.sort(ids[rows[labels == label]])


def groups(nodes: DataFrame, percent: int = 85, open_pairs: int = 8_000_000, shallow: int = 0) -> DataFrame:
    """kind, a, b from nodes (key, id, sig, n, level, comp), which hold no more rows to a key than a task can. Kind 0: the group a has
    the member b; a group's name is a hash of its members. Kind 2: the set a went b levels down, more than `shallow`."""
    bound, second = int(np.ceil(least_alike(percent) * TOKENS)), second_chance(percent)
    fields = ("key", "id", "n", "level", "comp")

    def flush(cols, sig):
        key, ids, sizes, levels, comps = cols
        deepest = np.zeros(len(ids), np.int64)
        for rows, level in _leaves(ids, sig, int(key[0]) & (2**62 - 1), comps, second, open_pairs):
            deepest[rows] = np.maximum(deepest[rows], levels[0] + level)
            for got in _candidate_groups(ids[rows], sig[rows], sizes[rows], comps[rows], bound, percent):
                name = mixed(mixed(got.view(np.uint64) + np.uint64(1)).sum(keepdims=True)).view(np.int64)
                yield np.zeros(len(got), np.int64), np.repeat(name, len(got)), got
        deep = np.flatnonzero(deepest > shallow)
        yield np.full(len(deep), 2), ids[deep], deepest[deep]

    def run(batches):
        take_up("near-duplicates")
        held, out, n = None, [], 0

        def made():
            found = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)], axis=1), axis=0)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["kind", "a", "b"])

        def each():
            """Runs of rows of one key with more than one row."""
            nonlocal held
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in fields]
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, TOKENS)
                if held is not None:
                    cols, sig = [np.concatenate(x) for x in zip(held[0], cols, strict=True)], np.concatenate([held[1], sig])
                cut = np.flatnonzero(np.diff(cols[0])) + 1
                starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(sig)]])
                for lo, hi in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
                    if hi - lo > 1:
                        yield [c[lo:hi] for c in cols], sig[lo:hi]
                held = [c[starts[-1] :].copy() for c in cols], sig[starts[-1] :].copy()
            if held is not None and len(held[1]) > 1:
                yield held

        for cols, sig in each():
            for got in flush(cols, sig):
                out.append(got)
                n += len(got[0])
            if n > 100_000:
                yield made()
                n = 0
        if out:
            yield made()

    placed = nodes.select("key", "id", "sig", "n", "level", "comp").repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "kind long, a long, b long").distinct()


def tree_nodes(sets: DataFrame, trees: int = ROOTS, node: int = 20_000, depth: int = 24, percent: int = 85, open_pairs: int = 8_000_000) -> DataFrame:
    """key, id, sig, n, level, comp: a row for each set (id, sig, n, comp) and branch of each tree; no key has more than about
    `node` rows. Trees begin with full tokens (roots), or where sets have `first` and `last`, by low bytes for that range of trees."""
    own = ["id", "sig", "n", "comp"]
    if "first" in sets.columns:
        nodes = sets.select(F.explode(F.sequence("first", "last")).alias("_tree"), *own)
        token = F.pmod(F.xxhash64("_tree", F.lit("root")), F.lit(TOKENS)).cast("int")
        nodes = nodes.select(F.xxhash64("_tree", token, F.col("sig").substr(token + 1, F.lit(1))).alias("key"), *own)
    else:
        nodes = sets.select(F.posexplode(F.slice("roots", 1, trees)).alias("_tree", "_root"), *own).select(F.xxhash64("_tree", "_root").alias("key"), *own)
    done = None
    for level in range(depth + 1):
        counts = stored(nodes.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > node), "big-nodes")
        if counts.isEmpty():
            break
        if not level:  # small, large and counted rows are all taken from the roots; deeper levels are written where they are made
            nodes = stored(nodes, "roots")
        small = nodes.join(counts, "key", "left_anti").withColumn("level", F.lit(level))
        done = small if done is None else done.unionByName(small)
        big = nodes.join(counts, "key")
        by_comp = big.groupBy("key", "comp").agg(F.count("*").alias("_c")).groupBy("key").agg((F.sum("_c") * F.sum("_c") - F.sum(F.col("_c") * F.col("_c"))).alias("_open"), F.max(F.struct("_c", "comp")).alias("_top"))
        big = big.join(by_comp.select("key", "_open", F.col("_top.comp").alias("_most")), "key").filter("_open > 0")
        few = big.filter(F.col("_open") <= 2 * open_pairs)  # the rows outside the largest component meet each part of it
        parts, spread = F.ceil(F.col("_n") * 2 / node), F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("_n") * 2 / node))
        few = few.withColumn("_part", F.explode(F.when(F.col("comp") == F.col("_most"), F.array(spread)).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))))
        done = done.unionByName(few.select(F.xxhash64("key", F.lit("part"), "_part").alias("key"), *own, F.lit(level).alias("level")))
        big = big.filter(F.col("_open") > 2 * open_pairs)
        if level == depth:  # parts, each with each
            parts = F.ceil(F.col("_n") * 2 / node)
            mine = F.pmod(F.xxhash64("id", "key"), parts)
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: F.struct(F.least(x, mine).alias("x"), F.greatest(x, mine).alias("y")))
            nodes = big.withColumn("_part", F.explode(pairs)).select(F.xxhash64("key", "_part.x", "_part.y").alias("key"), *own)
            break
        token = lambda salt: F.pmod(F.xxhash64("key", F.lit(level), F.lit(salt)), F.lit(TOKENS)).cast("int")  # noqa: E731, B023
        child = lambda k: F.xxhash64("key", k, F.col("sig").substr(k + 1, F.lit(1)))
        second = F.pmod(F.xxhash64("key", F.lit(level), F.lit("second")), F.lit(100)) < round(100 * second_chance(percent))
        paths = F.when(second, F.array(child(token("a")), child(token("b")))).otherwise(F.array(child(token("a"))))
        nodes = stored(big.withColumn("_key", F.explode(paths)).select(F.col("_key").alias("key"), *own), "deeper")
    nodes = nodes.withColumn("level", F.lit(level))
    return nodes if done is None else done.unionByName(nodes)


def first_nodes(sets: DataFrame, part: int = TILE) -> DataFrame:
    """The first round's nodes: the roots of two trees, those of more than `part` sets dealt at random into parts of so many."""
    own = ["id", "sig", "n", "comp"]
    nodes = sets.select(F.posexplode(F.slice("roots", 1, 2)).alias("_tree", "_root"), *own).select("_tree", F.xxhash64("_tree", "_root").alias("key"), *own)
    counts = stored(nodes.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * part), "big-roots")
    parts = F.pmod(F.xxhash64("id", "_tree"), F.ceil(F.col("_n") / part))
    dealt = nodes.join(counts, "key", "left").withColumn("key", F.when(F.col("_n").isNull(), F.col("key")).otherwise(F.xxhash64("key", parts)))
    return dealt.select("key", *own, F.lit(0).alias("level"))


def _links_of_group(ids: list[int], texts: list[str], percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect all that is linked in one group; a row for each id's each text."""
    sets = shingle_sets(texts)
    if len(sets) == 2:
        return [(ids[0], ids[1])] if linked(sets[0], sets[1], percent) else []
    sizes = np.array([len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts >= 2
    place = np.cumsum(shared) - 1
    row, some = np.repeat(np.arange(len(sets)), sizes), shared[column]
    row, column, both = row[some], place[column[some]], np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), 4096):  # so many shingles at a time, a bit for each
        i, j = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(sets), 4096), bool)
        x[row[i:j], column[i:j] - lo] = True
        bits = np.packbits(x, axis=1).view(np.uint64)
        for k in range(len(sets)):
            both[k] += np.bitwise_count(bits & bits[k]).sum(axis=1, dtype=np.int64)
    labels = _labels((100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (sizes[:, None] > 0))
    return [(ids[k], ids[i]) for i, k in enumerate(labels.tolist()) if k >= 0 and ids[k] != ids[i]]


def confirmed(texts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a, b: links between the full sets of members (g, id) of each group, enough to connect what is linked. texts: id, text."""

    def run(batches):
        take_up("near-duplicates")
        group, held, out = None, [], []

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 2, names=["a", "b"])
            out.clear()
            return batch

        for batch in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            for g, i, t in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "text")), strict=True):
                if g != group:
                    if len(held) > 1:
                        out += _links_of_group(*zip(*held, strict=True), percent)
                    group, held = g, []
                held.append((i, t or ""))
            if len(out) > 10_000:
                yield made()
        if len(held) > 1:
            out += _links_of_group(*zip(*held, strict=True), percent)
        yield made()

    return members.join(texts, "id").select("g", "id", "text").repartition("g").sortWithinPartitions("g", "id").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, recall: float = 0.9999, node: int = 20_000, open_pairs: int = 8_000_000, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); with keys, also hashes of the text and of the set."""
    base = stored(signatures(docs), "signatures")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))
    same = base.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min(named).alias("_least"), F.first("sig").alias("sig"), F.first("roots").alias("roots"))
    same = stored(same.select("k1", "k2", "n_shingles", F.col("_least.doc_id").alias("id"), F.col("_least.text_key").alias("text_key"), "sig", "roots"), "sets")
    sets = same.filter("id IS NOT NULL").select("id", "sig", "roots", F.col("n_shingles").alias("n"))
    whole = None  # id, component of ids that have a smaller one

    def labelled(rows: DataFrame) -> DataFrame:
        if whole is None:
            return rows.withColumn("comp", F.col("id"))
        return stored(rows.join(whole, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "labelled")  # each level of the trees reads it

    def grown(members: DataFrame) -> DataFrame:
        """whole after the groups' links."""
        members = stored(members, "members")
        if members.isEmpty():
            return whole
        asked = stored(same.select("id", "text_key").join(members.select("id").distinct(), "id"), "asked")
        texts = _texts(docs).join(asked.select(F.col("id").alias("doc_id"), "text_key"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("id"), "text")
        links = stored(confirmed(texts, members, percent), "links")
        if links.isEmpty():
            return whole
        if whole is not None:
            links = links.unionByName(whole.select(F.col("id").alias("a"), F.col("component").alias("b")))
        return stored(components(links).filter("id <> component"), "rounds")

    def found(nodes: DataFrame, trees: int, name: str) -> tuple[DataFrame, DataFrame]:
        shallow = max((d for d in range(100) if trees_needed(percent, d, recall) <= trees), default=-1)
        got = stored(groups(nodes, percent, open_pairs, shallow), name)
        return got.filter("kind = 0").select(F.col("a").alias("g"), F.col("b").alias("id")), got.filter("kind = 2").select("a", "b")

    whole = grown(found(first_nodes(labelled(sets)), ROOTS, "first-groups")[0])
    made = min(ROOTS, trees_needed(percent, 0, recall))
    members, deep = found(tree_nodes(labelled(sets), made, node, percent=percent, open_pairs=open_pairs), made, "groups")
    whole = grown(members)
    need = [trees_needed(percent, d, recall) for d in range(100)]
    while True:  # more trees for the sets that went deep, until their number meets the recall
        asked = deep.groupBy("a").agg(F.max("b").alias("b")).select(F.col("a").alias("id"), F.array(*map(F.lit, need))[F.col("b").cast("int")].alias("_need"))
        asked = stored(asked.filter(F.col("_need") > made), "deep")
        most = asked.agg(F.max("_need")).first()[0]
        if most is None:
            break
        more = labelled(sets.join(asked, "id")).withColumn("first", F.lit(made)).withColumn("last", F.col("_need") - 1)
        members, deeper = found(tree_nodes(more, node=node, percent=percent, open_pairs=open_pairs), most, "more-groups")
        whole, made, deep = grown(members), most, deep.unionByName(deeper)
    if whole is None:
        whole = docs.sparkSession.createDataFrame([], "id long, component long")
    names = same.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("n_shingles").alias("_n"), "id")
    out = base.select("doc_id", "text_key", "n_shingles", "k1", "k2").join(names, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n_shingles") == F.col("_n")), "left")
    several = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(F.struct("k1", "k2")) != F.max(F.struct("k1", "k2"))).alias("_several")).filter("_several")
    if several.isEmpty():
        key = F.col("id")
    else:  # a doc_id with several sets joins what those are linked with
        ways = out.filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        whole = stored(components(ways.unionByName(whole.select(F.col("id").alias("a"), F.col("component").alias("b")))).filter("id <> component"), "whole")
        key = F.coalesce("doc_id", "id")
    out = out.withColumn("_own", key).join(whole.select(F.col("id").alias("_own"), "component"), "_own", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "_own", "doc_id")).otherwise(F.col("doc_id")))
    more = ["text_key", F.when(F.col("n_shingles") > 0, F.xxhash64("k1", "k2", "n_shingles")).alias("set_key")] if keys else []
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *more)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
each AS MATERIALIZED (SELECT doc_id, hash(x) AS h FROM (SELECT doc_id, unnest(shingles) AS x FROM s)),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM each a JOIN each b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT n.doc_id, n.n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n_shingles
"""
