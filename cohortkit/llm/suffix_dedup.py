"""Repeated passages by a sparse suffix array.

Suffixes are kept only where a minimiser stands: every window of ``MIN_WORDS``
words holds at least one place whose ``GRAM``-word hash is least in it, and
copies of a window hold the same one. Suffixes are keyed by the words around
that place and met through Spark's shuffle by equal keys, not by a sorted
order; those whose key stands in no other text are dropped: a repeated window
either shares ``RIGHT`` words from the place on, or ``LEFT`` words before it. Around the suffixes that
remain, matches are extended left and right: every window that has the place
as its minimiser is keyed as a whole, and runs of windows met in another
document become one span.

Neighbours in one sorted order alone would miss a window whose best right
neighbour is not its best left one, so extension works on whole windows; this
is exact (64-bit keys). Texts that are equal as wholes are one text in all
steps and are spans from end to end.

Words are runs of non-space, A-Z lower-cased. Defined results: null, empty and
short texts have no spans; repeated rows of one id are no copies of each
other, but are each reported; a row without an id is a document of its own and
reported with a null id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortkit.llm.common import stage
from cohortkit.llm.shingles import mix, word_hashes

MIN_WORDS, GRAM = 50, 5
LEFT = 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


class Keys:
    """64-bit keys of runs of words of one text."""

    def __init__(self, text: str):
        words = word_hashes(text)
        self.n = len(words)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, np.uint64(_BASE))]))
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(words * power[:-1])])
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, np.uint64(_BACK))]))

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.uint64(length))

    def minimisers(self, window: int, gram: int) -> np.ndarray:
        """For each window of words, the place of its least gram."""
        grams = self.of(np.arange(self.n - gram + 1), gram)
        return np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(self.n - window + 1)


def suffixes(docs: DataFrame, window: int = MIN_WORDS, gram: int = GRAM, left: int = LEFT) -> DataFrame:
    """(th, doc_id, n_words, places): kept places of each text with their left and right keys."""
    right = window - left + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, at, lefts, rights = [], [], [], []
            for text in batch["text"]:
                keys = Keys(text)
                sizes.append(keys.n)
                if keys.n < window:
                    for x in (at, lefts, rights):
                        x.append([])
                    continue
                a = np.unique(keys.minimisers(window, gram))
                before, after = np.full(len(a), None, object), np.full(len(a), None, object)
                ok = a >= left
                before[ok] = keys.of(a[ok] - left, left + gram).astype("i8").tolist()
                ok = a + right <= keys.n
                after[ok] = keys.of(a[ok], right).astype("i8").tolist()
                at.append(a.tolist())
                lefts.append(before.tolist())
                rights.append(after.tolist())
            made = pd.DataFrame({"th": batch["th"], "doc_id": batch["doc_id"].astype("Int64"), "n_words": sizes, "at": at, "lefts": lefts, "rights": rights})
            yield made

    rows = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("th"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "th long, doc_id long, n_words int, at array<int>, lefts array<long>, rights array<long>")


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that stand in two different texts."""
    return keyed.groupBy("k").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo < hi").select("k")


def repeated_windows(docs: DataFrame, kept: DataFrame, window: int, gram: int, left: int) -> DataFrame:
    """(th, k, s): keys of the windows around the kept places ``kept`` (th, places of left and right matches)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for th, text, lefts, rights in zip(batch["th"], batch["text"], batch["lefts"], batch["rights"], strict=True):
                keys = Keys(text)
                least = keys.minimisers(window, gram)
                start = np.arange(len(least))
                far = least - start >= left
                s = start[(far & np.isin(least, lefts)) | (~far & np.isin(least, rights))]
                if len(s):
                    yield pd.DataFrame({"th": th, "k": keys.of(s, window).astype("i8"), "s": s.astype("i4")})

    texts = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("th"), "text")
    met = texts.join(kept, "th")
    return met.select("th", "text", "lefts", "rights").mapInPandas(run, "th long, k long, s int")


def repeated_spans(docs: DataFrame, window: int = MIN_WORDS, gram: int = GRAM, left: int = LEFT) -> DataFrame:
    """doc_id, start_word, end_word, n_words: longest runs of words whose every ``window`` words stand in another document."""
    rows = stage(suffixes(docs, window, gram, left), "suffixes")
    # a row without an id is a document of its own
    no_id, has_id = F.count_if(F.col("doc_id").isNull()), F.max(F.col("doc_id").isNotNull().cast("int"))
    texts = stage(
        rows.groupBy("th").agg(F.max("n_words").alias("n_words"), (F.coalesce(F.min("doc_id") < F.max("doc_id"), F.lit(False)) | (no_id + has_id > 1)).alias("copied")),
        "suffix-texts",
    )
    places = rows.filter(F.size("at") > 0).select("th", F.explode(F.arrays_zip("at", "lefts", "rights")).alias("x")).select("th", "x.*")
    sides = F.explode(F.array(F.struct(F.col("lefts").alias("k"), F.lit(True).alias("is_left")), F.struct(F.col("rights").alias("k"), F.lit(False).alias("is_left"))))
    keyed = places.select("th", "at", sides.alias("y")).select("th", "at", "y.k", "y.is_left")
    keyed = keyed.filter("k is not null")
    kept = keyed.join(_shared(keyed), "k", "left_semi").groupBy("th").agg(
        F.collect_set(F.when(F.col("is_left"), F.col("at"))).alias("lefts"), F.collect_set(F.when(~F.col("is_left"), F.col("at"))).alias("rights")
    )
    kept = stage(kept, "suffix-kept")
    windows = stage(repeated_windows(docs, kept, window, gram, left), "suffix-windows")
    starts = windows.join(_shared(windows), "k", "left_semi").select("th", "s").distinct()
    order = W.partitionBy("th").orderBy("s")  # the windows of one text
    fresh = F.coalesce(F.col("s") > F.lag("s").over(order) + window, F.lit(True)).cast("int")
    runs = starts.withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(order)).groupBy("th", "_run").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    spans = runs.select("th", F.col("a").alias("start_word"), (F.col("b") + window).alias("end_word"))
    copied = texts.filter(F.col("copied") & (F.col("n_words") >= window)).select("th", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"))
    spans = spans.join(copied.select("th"), "th", "left_anti").unionByName(copied)
    out = rows.select("th", "doc_id").join(spans, "th")
    return out.select("doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"), (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"))
