"""License scan: phrases, and an exact set-similarity join of text blocks with notice templates.

A template is looked for in blocks of consecutive words, a new one every half
block. Blocks are at least twice as long as the template (``BLOCK`` words, or
the next power of two), so wherever a text holds it, it lies whole in one. It is
found where a block holds at least ``percent`` of its distinct words. The join is exact:
words are ordered by their count over all documents, rarest first, and a pair
that reaches the threshold must share a word of the template's prefix
(prefix filter), the block must be large enough (length filter), and enough
words must remain behind the shared one (positional filter). What passes is
verified on the whole word sets.

Defined results: a null or empty text has no words and no labels; repeated
rows get the same answer; a null id is carried as it is; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import A_TO_Z, literal_array, row_key, stage, words_of

BLOCK = 64
PERCENT = 90
#: Words before lower-casing: the contract's pattern with A-Z let in.
CASED_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of common notices, by label.
TEMPLATES = {
    "agpl": ["gnu affero general public license version 3"],
    "all-rights-reserved": ["copyright all rights reserved"],
    "apache": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-attribution": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike license"],
    "gpl": [
        "licensed under the gnu general public license version 3",
        "redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "lgpl": ["gnu lesser general public license"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
    "mpl": ["subject to the terms of the mozilla public license"],
    "public-domain": ["free and unencumbered software released into the public domain"],
}


def _lower(word: Column) -> Column:
    return F.translate(word, A_TO_Z, A_TO_Z.lower())


def scanned(docs: DataFrame, vocabulary: list[str], phrases: dict[str, str]) -> DataFrame:
    """One pass over the texts: word count, places of the phrases, and (place, number) of vocabulary words."""
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), words_of(F.col("text"), CASED_WORDS).alias("_cased"))
    # all words of the phrases and templates are ASCII, so lower() decides membership as A-Z lower-casing does but for signs that it turns into ASCII
    known = F.filter(F.transform("_cased", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: F.lower(x["w"]).isin(vocabulary))
    numbers = literal_array(vocabulary, "string")
    rows = rows.withColumn("_known", F.transform(known, lambda x: F.struct(x["at"].alias("at"), F.array_position(numbers, _lower(x["w"])).cast("short").alias("t"))))
    rows = rows.select("doc_id", "key", F.size("_cased").cast("long").alias("n_words"), F.filter("_known", lambda x: x["t"] > 0).alias("known"))

    def places_of(words: list[str]) -> Column:
        numbers = [vocabulary.index(w) + 1 for w in words]

        def here(x: Column, i: Column) -> Column:
            # the first test is cheap and fails for nearly all words
            test = x["t"] == numbers[0]
            for k, number in enumerate(numbers[1:], 1):
                y = F.get("known", i + k)
                test = test & F.coalesce((y["t"] == number) & (y["at"] == x["at"] + k), F.lit(False))
            return test

        return F.transform(F.filter("known", here), lambda x: x["at"])

    places = [places_of(phrase.split()) for phrase in phrases]
    return rows.withColumn("places", F.array(*places))


def rarest_first(rows: DataFrame, vocabulary: list[str]) -> list[int]:
    """Vocabulary numbers by their counts over all documents; the collected table has one row per word."""
    counts = {r["t"]: r["n"] for r in rows.select(F.explode("known.t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(range(1, len(vocabulary) + 1), key=lambda t: (counts.get(t, 0), vocabulary[t - 1]))


def block_size(words: int, least: int = BLOCK) -> int:
    """Words of the blocks in which a template of ``words`` words is looked for."""
    return max(least, 1 << (2 * words - 1).bit_length())


def template_matches(rows: DataFrame, templates: list[tuple[str, list[int]]], order: list[int], percent: int, block: int) -> DataFrame:
    """(key, label, containment) of the blocks that hold ``percent`` of a template's words."""
    rank = {t: i for i, t in enumerate(order)}
    index, wanted = [], {}
    for label, numbers in templates:
        words, size = sorted({rank[t] for t in numbers}), block_size(len(numbers), block)
        need = math.ceil(len(words) * percent / 100 - 1e-9)
        index += [(label, words, need, r, j, size) for j, r in enumerate(words[: len(words) - need + 1])]
        wanted.setdefault(size, set()).update(words[: len(words) - need + 1])
    spark = rows.sparkSession
    prefixes = spark.createDataFrame(index, "label string, words array<int>, need int, r int, j int, size int")
    ranks = literal_array([-1, *[rank[t] for t in range(1, len(order) + 1)]], "int")

    def holds(sizes: list[int]) -> Column:
        numbers = sorted({order[r] for size in sizes for r in wanted[size]})
        return F.exists("known", lambda x: x["t"].isin(numbers))

    near = rows.filter(holds(list(wanted))).dropDuplicates(["key"])
    # only of the classes of blocks one of whose templates may be in the text
    sizes = [F.when(holds([size]), F.lit(size)) for size in sorted(wanted)]
    spots = near.select("key", F.explode("known").alias("x"), F.array_compact(F.array(*sizes)).alias("sizes")).select("key", "x", F.explode("sizes").alias("size"))
    half = F.col("size") / 2
    spots = spots.select(
        "key", "size", F.explode(F.array(F.floor(F.col("x.at") / half), F.floor(F.col("x.at") / half) - 1)).alias("block"), F.get(ranks, F.col("x.t").cast("int")).alias("r")
    )
    # no more words than the vocabulary has
    blocks = spots.groupBy("key", "size", "block").agg(F.sort_array(F.collect_set("r")).alias("own")).withColumn("m", F.size("own"))
    met = blocks.select("key", "size", "own", "m", F.posexplode("own").alias("i", "r")).join(F.broadcast(prefixes), ["r", "size"])
    met = met.filter((F.col("m") >= F.col("need")) & (1 + F.least(F.col("m") - F.col("i"), F.size("words") - F.col("j")) - 1 >= F.col("need")))
    overlap = F.size(F.array_intersect("own", "words"))
    return (
        met.withColumn("both", overlap)
        .filter("both >= need")
        .groupBy("key", "label")
        .agg(F.max(F.col("both") / F.size("words")).alias("containment"))
    )


def scan(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in t.split()} | {w for p in phrases for w in p.split()})
    rows = stage(scanned(docs, vocabulary, phrases), "license-words")
    numbered = [(label, [vocabulary.index(w) + 1 for w in t.split()]) for label, texts in templates.items() for t in texts]
    found = template_matches(rows, numbered, rarest_first(rows, vocabulary), percent, block)
    found = found.groupBy("key").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))  # at most one entry per label
    every = F.flatten("places")
    named = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(v)) for i, v in enumerate(phrases.values())]))
    joined = rows.join(found, "key", "left").withColumn("_base", F.array_sort(F.array_distinct(named)))
    return joined.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
