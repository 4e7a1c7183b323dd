"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z. A block is a window of 2 * L words that begins
at a multiple of L, so that any passage of up to L words stands whole in some block; L is 16 or, for longer templates, the next
power of 4 from a template's words on (64, 256, 1024 ...), so whole license texts match as well. A block matches a template if it holds at
least `threshold` of the template's distinct words.

The join, exact: template tokens are ordered by how many documents hold them, rarest first. A block that holds
`needed` of a template's n tokens holds one of its first n - needed + 1 (prefix filter); it has at least `needed`
template words at all (length filter); and with the shared token at place i of the template and j of the block, at most
1 + min(n - i - 1, size - j - 1) tokens can be shared (positional filter, applied to the first token shared). What is
left is counted on the full sets. Templates and their tokens' counts are bounded by the template list.

Nulls and odd rows: null text is empty (no words, no labels, score 0); repeated rows each have a row; null doc_ids are
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9

# Phrases and labels, and templates as their words.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def step_of(words: int) -> int:
    step = 16
    while step < words:
        step *= 4
    return step


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (label, first word, share of the template) of every row of docs (doc_id, text)."""
    lower = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    parsed = [(label, len(text.split()), sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, _, words in parsed for w in words})

    # one pass for the words of all documents: counts, phrases, and where template words stand
    own = lower.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).withColumn("n_words", F.size("_words").cast("long"))
    for k, (phrase, _) in enumerate(phrases):
        words = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.size("_words") - len(words)), _stands(words))
        own = own.withColumn(f"_at{k}", F.when((F.size("_words") >= len(words)) & _all([F.contains("_text", F.lit(w)) for w in words]), at).otherwise(F.array().cast("array<int>")))
    ats = [F.col(f"_at{k}") for k in range(len(phrases))]
    every = F.concat(*ats)
    own = own.select(
        "doc_id", "_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(label)) for a, (_, label) in zip(ats, phrases, strict=True)))).alias("_base"), F.when(F.size("_words") > 0, F.transform(F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_words", i).isin(vocabulary)), lambda i: F.struct(i.alias("p"), F.get("_words", i).alias("w")))).alias("_hits"),
    )
    own = stored(own, "licenses")
    counts = dict.fromkeys(vocabulary, 0) | {r.w: r.n for r in own.select(F.explode(F.array_distinct("_hits.w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per template word

    order = sorted(vocabulary, key=lambda w: (counts[w], w))
    place = {w: i for i, w in enumerate(order)}
    rows, firsts = [], []
    for t, (label, length, words) in enumerate(parsed):
        ranked = sorted(words, key=place.get)
        needed = math.ceil(threshold * len(ranked) - 1e-9)
        step = step_of(length)
        rows.append(F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(step).alias("step"), F.lit(needed).alias("needed"), _strings(ranked).alias("tokens")))
        firsts += [F.struct(F.lit(t).alias("t"), F.lit(w).alias("token"), F.lit(i).alias("i"), F.lit(step).alias("step"), F.lit(needed).alias("needed"), F.lit(len(ranked)).alias("n")) for i, w in enumerate(ranked[: len(ranked) - needed + 1])]
    if not rows:
        return own.select("doc_id", "n_words", "n_base", "first_word", "last_word", _joined(F.col("_base")).alias("base_labels"), _joined(F.col("_base")).alias("labels"), (F.col("n_base") > 0).cast("double").alias("score"), F.array().cast("array<struct<label:string,first:int,share:double>>").alias("blocks"))
    spark = docs.sparkSession
    table = spark.range(1).select(F.inline(F.array(*rows)))
    prefixes = spark.range(1).select(F.inline(F.array(*firsts)))

    # blocks around words of some template's prefix that hold as many template words as some template needs
    by_step = {s: sorted({x for t, (_, n, words) in enumerate(parsed) if step_of(n) == s for x in sorted(words, key=place.get)[: len(words) - math.ceil(threshold * len(words) - 1e-9) + 1]}) for s in sorted({step_of(n) for _, n, _ in parsed})}
    least = {s: min(math.ceil(threshold * len(words) - 1e-9) for _, n, words in parsed if step_of(n) == s) for s in by_step}
    some = own.filter(F.arrays_overlap("_hits.w", _strings(sorted({w for x in by_step.values() for w in x}))))
    some = some.select("doc_id", "_key", F.explode_outer(F.array_distinct(F.concat(*(_blocks(words, step, least[step]) for step, words in by_step.items())))).alias("_spot")).filter(F.col("_spot").isNotNull())
    some = some.select("doc_id", "_key", "_spot.step", "_spot.block", F.array_intersect(_strings(order), "_spot.tokens").alias("_tokens"))  # in the global order
    each = some.select("*", F.posexplode("_tokens").alias("j", "token"))
    close = each.join(F.broadcast(prefixes), ["token", "step"]).filter(F.size("_tokens") >= F.col("needed"))
    first = close.groupBy("doc_id", "_key", "step", "block", "t").agg(F.min(F.struct("i", "j", "n", "needed", "_tokens")).alias("_m"))
    first = first.filter(1 + F.least(F.col("_m.n") - F.col("_m.i") - 1, F.size("_m._tokens") - F.col("_m.j") - 1) >= F.col("_m.needed"))
    found = first.join(F.broadcast(table.select("t", "label", "needed", "tokens")), "t").withColumn("_both", F.size(F.array_intersect("tokens", "_m._tokens"))).filter("_both >= needed")
    found = found.withColumn("_share", F.col("_both") / F.size("tokens"))
    by_doc = found.groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_k")).agg(F.max("_share").alias("_share"), F.collect_set("label").alias("_labels"), F.sort_array(F.collect_list(F.struct("label", (F.col("block") * F.col("step")).cast("int").alias("first"), F.col("_share").alias("share")))).alias("blocks"))
    out = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k")), "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", _joined(F.col("_base")).alias("base_labels"), _joined(F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("_share", F.lit(0.0)), (F.col("n_base") > 0).cast("double")).alias("score"), F.coalesce("blocks", F.array().cast("array<struct<label:string,first:int,share:double>>")).alias("blocks"),
    )


def _stands(words: list[str]):
    return lambda i: _all([F.get("_words", i + j) == w for j, w in enumerate(words)])


def _blocks(words: list[str], step: int, least: int) -> Column:
    """The blocks of a step that hold one of the words and `least` template words: step, block, tokens. A hit's blocks lie within
    2 * step - 1 words on either side, so within as many hits."""
    own = F.filter(F.sequence(F.lit(0), F.size("_hits") - 1), lambda k: F.get("_hits", k)["w"].isin(words))

    def block(k: Column, back: int) -> Column:
        number = F.floor(F.get("_hits", k)["p"] / step).cast("int") - back
        near = F.slice("_hits", F.greatest(k - 2 * step + 2, F.lit(1)), F.lit(4 * step))
        inside = F.filter(near, lambda h: F.floor(h["p"] / step).cast("int").between(number, number + 1))
        return F.struct(F.lit(step).alias("step"), number.alias("block"), F.array_distinct(F.transform(inside, lambda h: h["w"])).alias("tokens"))

    return F.filter(F.flatten(F.transform(own, lambda k: F.array(block(k, 0), block(k, 1)))), lambda b: (b["block"] >= 0) & (F.size(b["tokens"]) >= least))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def sql(phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same by comparing every block with every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    hits = ", ".join(f"[i FOR i IN range(0, greatest(0, n_words - {len(p.split())} + 1)) IF " + " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(p.split())) + f"] AS a{k}" for k, (p, _) in enumerate(phrases))
    base = "list_filter([" + ", ".join(f"CASE WHEN len(a{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases)) + "], lambda x: x IS NOT NULL)"
    each = "list_concat(" * (len(phrases) - 1) + "a0" + "".join(f", a{k})" for k in range(1, len(phrases)))
    values = ", ".join(f"('{label}', {step_of(len(t.split()))}, {math.ceil(threshold * len(set(t.split())) - 1e-9)}, {quoted(sorted(set(t.split())))})" for label, t in templates)
    steps = ", ".join(f"({s})" for s in sorted({step_of(len(t.split())) for _, t in templates}))
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
n AS (SELECT *, len(words)::BIGINT AS n_words FROM w),
h AS (SELECT *, {hits} FROM n),
b AS (SELECT rid, doc_id, n_words, {each} AS every, {base} AS base FROM h),
templates(label, step, needed, tokens) AS (VALUES {values}),
blocks AS (SELECT rid, step, list_distinct(words[k * step + 1 : k * step + 2 * step]) AS block FROM (SELECT rid, words, step, unnest(range(0, (n_words + step - 1) // step)) AS k FROM n, (VALUES {steps}) s(step))),
found AS (SELECT rid, label, len(list_intersect(block, tokens)) / len(tokens) AS share FROM blocks JOIN templates USING (step) WHERE len(list_intersect(block, tokens)) >= needed),
f AS (SELECT rid, max(share) AS share, list(label) AS labels FROM found GROUP BY rid)
SELECT doc_id, n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
    array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
    greatest(coalesce(share, 0.0::DOUBLE), CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)::DOUBLE AS score
FROM b LEFT JOIN f USING (rid)
"""
