"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are counted in words. Every source gets a target: the weights share a multiple of all sizes, no target exceeds
`cap` times its source's size, and what is above is shared again by weight. Targets become whole numbers of blocks of
equal size: a block goes to the source with the highest quotient target / (2 * blocks so far + 1). A source's blocks
are given to its shards in the same way, by their sizes. In a shard the documents stand in seeded order; their words
are cut into blocks, and the shard takes its quota of blocks: all of them as often as the quota holds, and of the rest
those of least seeded hash.

Highest quotients without a queue: dividing by the block's size and rounding gives an apportionment for some other
total; the few blocks more or less are the best or the worst among each party's next quotients, and no party can need
more of those than ceil(1.5 * parties * its share) + 3, which sums to a few for each party.

Nulls and odd rows: null or empty text has size 0 and takes 0; null source is a source of its own, last in order; null
doc_id hashes as an empty name; repeated rows each have a row; a source of size 0 has target 0; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


def _seats(votes: DataFrame, key: list[str], whole: list[str], total: str, order: str) -> DataFrame:
    """votes with `seats`: for each `whole`, `total` seats to its parties (key, votes, share = votes / all votes, quota = fair share of seats)."""
    over = Window.partitionBy(*whole) if whole else Window.partitionBy()
    first = votes.withColumn("_n", F.floor(F.col("quota") + 0.5)).withColumn("_off", F.col(total) - F.sum("_n").over(over)).withColumn("_parties", F.count("*").over(over))
    most = F.least(F.abs("_off"), F.ceil(F.lit(1.5) * F.col("_parties") * F.col("share")) + 3, F.when(F.col("_off") < 0, F.col("_n")).otherwise(F.abs("_off")))
    more = first.filter("_off != 0").withColumn("_most", most).filter("_most > 0").select(*whole, *key, order, "votes", "_n", "_off", F.explode(F.sequence(F.lit(1), F.col("_most"))).alias("_j"))
    up = F.col("_off") > 0
    quotient = F.when(up, -F.col("votes") / (2 * (F.col("_n") + F.col("_j")) - 1)).otherwise(F.col("votes") / (2 * (F.col("_n") - F.col("_j")) + 1))
    ranked = more.withColumn("_q", quotient).withColumn("_r", F.row_number().over((Window.partitionBy(*whole) if whole else Window.partitionBy()).orderBy("_q", order, "_j")))
    change = ranked.filter(F.col("_r") <= F.abs("_off")).groupBy(*whole, *key).agg(F.sum(F.signum("_off")).cast("long").alias("_change"))
    return first.join(change, [*whole, *key], "left").withColumn("seats", F.col("_n") + F.coalesce("_change", F.lit(0))).drop("_n", "_off", "_parties", "_change")


def sources(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, shard_docs: int = 2000) -> DataFrame:
    """One row per source: source, rank, source_size, weight, target, block, seats, shards."""
    every = Window.partitionBy()  # one row per source
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    own = own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    own = own.withColumn("all", F.sum("source_size").over(every)).withColumn("n_sources", F.count("*").over(every)).withColumn("most", F.lit(cap) * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    rest = F.lit(share) * F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0))
    own = own.withColumn("full", F.col("most") * F.sum("weight").over(onward) <= F.col("weight") * rest)
    own = own.withColumn("left", F.lit(share) * F.col("all") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(every))
    own = own.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("left") / F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(every)))
    own = own.withColumn("block", F.greatest(F.lit(16), F.least(F.lit(4096), F.expr("`all` div (n_sources * 1000)"))))
    voted = own.withColumn("votes", F.col("target")).withColumn("total", F.floor(F.lit(share) * F.col("all") / F.col("block") + 0.5))
    voted = voted.withColumn("quota", F.col("target") / F.col("block")).withColumn("share", F.coalesce(F.try_divide("target", F.lit(share) * F.col("all")), F.lit(0.0)))
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).alias("shards")
    return _seats(voted, ["rank"], [], "total", "rank").select("source", F.col("rank").cast("long"), "source_size", "weight", "target", F.col("block").cast("long"), "seats", shards)


def _hash32(*parts):
    """The first 32 bits of an md5, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 17, shard_docs: int = 2000) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shard, block for every row of docs (doc_id, text, source)."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")), "mix-sizes")
    by_source = stored(sources(sized, weights, share, cap, shard_docs), "mix-sources")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = sized.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("shard", _hash32(F.lit(str(seed)), F.lit("shard"), name) % F.col("shards"))
    shards = keyed.groupBy("rank", "shard").agg(F.sum("size").alias("votes"), *(F.first(c).alias(c) for c in ("source_size", "seats", "block")))
    shards = shards.withColumn("share", F.coalesce(F.try_divide("votes", "source_size"), F.lit(0.0))).withColumn("quota", F.coalesce(F.try_divide(F.col("votes") * F.col("seats"), F.col("source_size")), F.lit(0.0)))
    shards = _seats(shards.withColumnRenamed("seats", "total"), ["shard"], ["rank"], "total", "shard")
    shards = shards.select("rank", "shard", F.col("seats").alias("_quota"), F.expr("(votes + block - 1) div block").alias("_blocks"))
    order = Window.partitionBy("rank", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("doc"), name)), "doc_id", "size")
    placed = keyed.withColumn("_at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("_row", F.row_number().over(order))
    placed = placed.withColumn("_block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr("_at div block"), F.expr("(_at + size - 1) div block")))))
    placed = placed.withColumn("_words", F.least((F.col("_block") + 1) * F.col("block"), F.col("_at") + F.col("size")) - F.greatest(F.col("_block") * F.col("block"), F.col("_at")))
    drawn = Window.partitionBy("rank", "shard").orderBy(F.col("_block").isNull(), F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("block"), "rank", "shard", "_block")), "_block")
    placed = placed.withColumn("_drawn", F.dense_rank().over(drawn)).join(shards, ["rank", "shard"])
    times = F.least(F.expr("_quota div _blocks + if(_drawn <= _quota % _blocks, 1, 0)"), F.lit(cap))
    done = placed.groupBy("rank", "shard", "_row", "doc_id", "source", "size", "source_size", "target", "block").agg(F.coalesce(F.sum(F.when(F.col("_words") > 0, F.col("_words") * times)), F.lit(0)).cast("long").alias("taken"))
    return done.select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "block")


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken: whole times, and once more with the chance of the rest, by a
    seeded hash. Columns are those of docs. Rows that share a doc_id (or its lack) share the smallest of their decisions."""
    part = F.col("taken") / F.col("size")
    more = _hash32(F.lit(str(seed)), F.lit("copy"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) / F.lit(2.0**32) < part - F.floor(part)
    copies = mix(docs, seed=seed, **options).filter("size > 0 AND taken > 0").select(F.col("doc_id").alias("_id"), (F.floor(part) + more.cast("int")).cast("int").alias("_copies")).groupBy("_id").agg(F.min("_copies").alias("_copies")).filter("_copies > 0")
    out = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
grouped AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk, (sum(source_size) OVER ())::BIGINT AS alls, count(*) OVER () AS n_sources, 2 * source_size AS most FROM grouped),
weighed AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
filling AS (SELECT *, most * sum(weight) OVER (ORDER BY most / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (1.5::DOUBLE * alls - coalesce(sum(most) OVER (ORDER BY most / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM weighed),
levelled AS (SELECT *, 1.5::DOUBLE * alls - sum(CASE WHEN filled THEN most ELSE 0 END) OVER () AS lft, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () AS w_left FROM filling),
aimed AS (SELECT *, CASE WHEN filled THEN most::DOUBLE ELSE weight * lft / w_left END AS target, greatest(16, least(4096, alls // (n_sources * 1000)))::BIGINT AS block FROM levelled),
s0 AS (SELECT *, floor(target / block + 0.5)::BIGINT AS n0, floor(1.5::DOUBLE * alls / block + 0.5)::BIGINT AS total FROM aimed),
s1 AS (SELECT *, (total - sum(n0) OVER ())::BIGINT AS off FROM s0),
s2 AS (SELECT rnk, j, CASE WHEN off > 0 THEN -target / (2 * (n0 + j) - 1) ELSE target / (2 * (n0 - j) + 1) END AS q, off FROM (SELECT *, unnest(range(1, 1 + CASE WHEN off < 0 THEN least(-off, n0) ELSE off END)) AS j FROM s1 WHERE off <> 0)),
s3 AS (SELECT rnk, sum(sign(off))::BIGINT AS chg FROM (SELECT *, row_number() OVER (ORDER BY q, rnk, j) AS r FROM s2) WHERE r <= abs(off) GROUP BY rnk),
srcs AS (SELECT s1.*, n0 + coalesce(chg, 0) AS seats, greatest(1, ceil(n_docs / 2000.0))::BIGINT AS shards FROM s1 LEFT JOIN s3 USING (rnk)),
keyed AS (SELECT d.doc_id, d.size, s.rnk, s.source_size, s.target, s.block, s.seats, coalesce(d.doc_id::VARCHAR, '') AS nm,
    ('0x' || substr(md5('17:shard:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % s.shards AS shard FROM sized d JOIN srcs s ON d.source IS NOT DISTINCT FROM s.source),
h0 AS (SELECT rnk, shard, sum(size)::BIGINT AS votes, first(source_size) AS ssize, first(seats) AS total, first(block) AS block FROM keyed GROUP BY rnk, shard),
h1 AS (SELECT *, CASE WHEN ssize > 0 THEN floor((votes * total)::DOUBLE / ssize + 0.5)::BIGINT ELSE 0 END AS n0 FROM h0),
h2 AS (SELECT *, (total - sum(n0) OVER (PARTITION BY rnk))::BIGINT AS off FROM h1),
h3 AS (SELECT rnk, shard, j, off, CASE WHEN off > 0 THEN -votes::DOUBLE / (2 * (n0 + j) - 1) ELSE votes::DOUBLE / (2 * (n0 - j) + 1) END AS q FROM (SELECT *, unnest(range(1, 1 + CASE WHEN off < 0 THEN least(-off, n0) ELSE off END)) AS j FROM h2 WHERE off <> 0)),
h4 AS (SELECT rnk, shard, sum(sign(off))::BIGINT AS chg FROM (SELECT *, row_number() OVER (PARTITION BY rnk ORDER BY q, shard, j) AS r FROM h3) WHERE r <= abs(off) GROUP BY rnk, shard),
shards AS (SELECT h2.rnk, h2.shard, n0 + coalesce(chg, 0) AS quota, (votes + block - 1) // block AS blocks FROM h2 LEFT JOIN h4 USING (rnk, shard)),
placed AS (SELECT *, (sum(size) OVER w - size)::BIGINT AS pos, row_number() OVER w AS rw FROM keyed WINDOW w AS (PARTITION BY rnk, shard ORDER BY md5('17:doc:' || nm), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pieces AS (SELECT *, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS blk FROM placed WHERE size > 0),
drawn AS (SELECT p.*, least((blk + 1) * block, pos + size) - greatest(blk * block, pos) AS words, dense_rank() OVER (PARTITION BY rnk, shard ORDER BY md5('17:block:' || rnk || ':' || shard || ':' || blk), blk) AS dr FROM pieces p),
took AS (SELECT rnk, shard, rw, sum(words * least(2, quota // blocks + CASE WHEN dr <= quota % blocks THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn JOIN shards USING (rnk, shard) GROUP BY rnk, shard, rw)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken FROM placed p LEFT JOIN took t ON p.rnk = t.rnk AND p.shard = t.shard AND p.rw = t.rw
"""
