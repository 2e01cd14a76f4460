"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of word shingles. Each partition
has one sketch length: the items' least MinHash values, as many as the
threshold allows to be missing from a text, plus one (taken at the
partition's upper size, so it fits each of its items). A text that contains an
item to the threshold must then hold at least one sketch shingle: texts of any
length are found by one join on hashes, and no signature of a long text is
needed. Candidates are verified on the shingles themselves.

Words are runs of letters and digits, lower-cased. An item of fewer than ``n``
words is one shingle of all its words, which is looked for among the shingles
of that many words of every text.

Defined results: null or empty texts and items contain and match nothing; a
null id is reported as null; rows that repeat id and text are reported once;
repeated items likewise; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import LETTER_WORDS, measured_small, row_key, stage, words_of


def _windows(words: Column, n: int, make) -> Column:
    """``make`` of the words of each shingle."""
    size = F.size(words)
    some = F.transform(F.sequence(F.lit(0), size - n), lambda i: make([F.get(words, i + k) for k in range(n)]))
    return F.when(size >= n, some).when(size > 0, F.array(make([F.get(words, F.lit(k)) for k in range(n)]))).otherwise(F.array().cast("array<long>"))


def hashed(words: Column, n: int) -> Column:
    return _windows(words, n, lambda w: F.xxhash64(*w))


def spelled(words: Column, n: int) -> Column:
    size = F.size(words)
    some = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(size >= n, some).when(size > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def of_text(words: Column, n: int, short: list[int], make) -> Column:
    """The ``n``-word shingles of a text, and those as long as the items of fewer words."""
    sized = [F.when(F.size(words) >= k, make(words, k)) for k in [n, *short]]
    return sized[0] if len(sized) == 1 else F.flatten(F.array_compact(F.array(*sized)))


def _words(text: str) -> Column:
    return words_of(F.lower(F.col(text)), LETTER_WORDS)


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """(ikey, item_id, q, shingles) of the items that have words."""
    rows = items.select("item_id", "text", row_key(F.col("item_id"), F.col("text")).alias("ikey")).dropDuplicates(["ikey"])
    rows = rows.withColumn("_words", _words("text")).withColumn("shingles", F.array_distinct(spelled(F.col("_words"), n)))
    rows = rows.withColumn("hashes", F.array_distinct(hashed(F.col("_words"), n)))
    return rows.filter(F.size("shingles") > 0).select("ikey", "item_id", F.size("shingles").alias("q"), F.size("_words").alias("n_words"), "shingles", "hashes")


def needed(q: Column, percent: int) -> Column:
    """Fewest shingles of an item that reach the threshold."""
    return F.ceil(q * percent / F.lit(100.0) - 1e-9).cast("int")


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """(hash, ikey): the sketch of each item, of its size partition's length."""
    part = F.floor(F.log2("q"))
    upper = (F.pow(F.lit(2), part + 1) - 1).cast("int")
    length = upper - needed(upper, percent) + 1
    least = F.sort_array(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit(5)).alias("order"), h.alias("h"))))
    return shingles.withColumn("_least", F.slice(least, F.lit(1), length)).select(F.explode("_least.h").alias("hash"), "ikey")


def _small(df: DataFrame) -> DataFrame:
    """Mark for broadcast if its measured size allows it; else Spark shuffles both sides."""
    return F.broadcast(df) if measured_small(df) else df


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, item_shingles, hits, containment for each text that holds ``percent`` of an item's shingles."""
    listed = stage(item_shingles(items, n), "items")
    sketch = stage(sketches(listed, percent), "sketches")
    short = sorted(r["k"] for r in listed.filter("n_words < " + str(n)).select(F.col("n_words").alias("k")).distinct().collect())  # fewer than ``n`` numbers
    rows = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))

    worded = rows.select("key", "doc_id", _words("text").alias("_words"))
    found = worded.select("key", F.explode(of_text(F.col("_words"), n, short, hashed)).alias("hash")).join(_small(sketch), "hash").select("key", "ikey").distinct()
    found = stage(found, "candidates")

    whole = stage(listed.select("ikey", "item_id", "q", F.explode("shingles").alias("shingle")), "item-shingles")
    hit_rows = rows.join(found.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", "doc_id", _words("text").alias("_words"))
    hits = (
        hit_rows.select("key", "doc_id", F.explode(F.array_distinct(of_text(F.col("_words"), n, short, spelled))).alias("shingle"))
        .join(_small(whole), "shingle")
        .join(found, ["key", "ikey"], "left_semi")
        .groupBy("key", "ikey", "doc_id", "item_id", "q")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return hits.filter(F.col("hits") >= needed(F.col("q"), percent)).select(
        "doc_id", "item_id", F.col("q").cast("long").alias("item_shingles"), "hits", F.round(F.col("hits") / F.col("q"), 6).alias("containment"), "key"
    )
