"""Document fingerprints: bottom-k sketches of word-shingle hashes, as DataFrame expressions.

A text's shingles are its runs of five words (what white space separates); with fewer words, all of them as one; with
none, there is no shingle. A sketch is the sorted array of the k smallest distinct 64-bit hashes. The sketch of a union
is the k smallest of the sketches' hashes, so sketches of parts merge into the sketch of the whole.

Nulls and odd rows: null text is empty; two texts without shingles are alike (1), one without and one with are not (0);
ties and repeated rows have equal sketches; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 128, 5


def _sketch_of_words(words: Column, k: int) -> Column:
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WIDTH))))
    hashes = F.when(n >= WIDTH, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K) -> DataFrame:
    """df with the sketch of a text column."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return df.withColumn("_words", words).withColumn(out, _sketch_of_words(F.col("_words"), k)).drop("_words")


def merged(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """For each key, the sketch of all its rows' texts together. Hashes are made distinct and cut to k on the map side."""
    each = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    low = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).filter(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both sketches hold."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(low, a), b)) / F.size(low)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: likeness times the union's count over a's."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(union, k) / distinct_count(a, k)))


def packed(sketch: Column) -> Column:
    """A sketch as text: base64 of its hashes, 8 bytes each, most significant first."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def unpacked(text: Column) -> Column:
    raw = F.hex(F.unbase64(text))
    cut = F.transform(F.sequence(F.lit(0), (F.length(raw) / 16).cast("int") - 1), lambda i: F.substring(raw, i * 16 + 1, F.lit(16)))
    low = lambda h: F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")
    high = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    value = F.transform(cut, lambda h: F.shiftleft(high(h), 32).bitwiseOR(low(h)))
    return F.when(F.length(raw) == 0, F.array().cast("array<bigint>")).otherwise(value)


def _below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below a value: first among every n-th of n * n, then in the n of that place."""
    if not cuts:
        return F.lit(0)
    n = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + n] for i in range(0, len(cuts), n)]
    upto = F.size(F.filter(F.lit([x[-1] for x in parts]), lambda c: c < value))
    within = F.size(F.filter(F.coalesce(F.get(F.lit(parts), upto), F.array().cast("array<bigint>")), lambda c: c < value))
    return F.least(upto * n + within, F.lit(len(cuts)))


def with_next(docs: DataFrame, columns: list[str], derive=lambda df: df, parts: int | None = None) -> DataFrame:
    """derive(docs) (doc_id, columns) with next_<column>: the next row's, by ascending doc_id; after the last, the first's.

    Rows are put into runs of neighbouring ids, by quantiles of doc_id; a run is ordered by itself, with the first row of
    the run after it at its end. Null doc_ids stand first; rows with equal ids stand in order of their columns.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)))
    run = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_below(F.col("doc_id"), [int(c) for c in cuts]))
    own = derive(docs).withColumn("_run", run).withColumn("_end", F.lit(False))
    runs = docs.withColumn("_run", run).groupBy("_run").agg(F.min("doc_id").alias("_first"))
    back = Window.orderBy("_run")  # a row per run
    runs = runs.withColumn("_to", F.coalesce(F.lag("_run").over(back), F.max("_run").over(Window.partitionBy())))
    ends = derive(docs.join(F.broadcast(runs), F.col("doc_id").eqNullSafe(F.col("_first"))))  # at most `parts` ids
    ends = ends.groupBy("_to").agg(F.min(F.struct(*columns)).alias("_row")).select(F.lit(None).cast("bigint").alias("doc_id"), *(F.col(f"_row.{c}").alias(c) for c in columns), F.col("_to").alias("_run"), F.lit(True).alias("_end"))
    order = Window.partitionBy("_run").orderBy("_end", "doc_id", *columns)
    both = own.select("doc_id", *columns, "_run", "_end").unionByName(ends)
    both = both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return both.filter("NOT _end").drop("_run", "_end")


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, edited_text, sketch, edited_sketch, next_sketch: a document, and it with its last quarter replaced by the next one's beginning."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(own, ["text", "sketch"], lambda df: with_sketch(df, k=k))
    n = F.char_length("text")
    moved = F.floor(n / 4).cast("int")
    both = both.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved)))
    return with_sketch(both, "edited_text", "edited_sketch", k).drop("next_text")
