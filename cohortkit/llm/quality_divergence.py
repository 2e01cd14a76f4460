"""Quality rule: distance of a text's histograms from the references of its language.

Two histograms are made of each text: character classes of its words, and
common words of the language tables (all else as one entry). References are
the sums over all texts that pass the base rules, by language. A text fails
when either Jensen-Shannon distance is above its limit; texts too short for a
stable histogram are not judged by it.

All columns are built-in expressions: one narrow pass over the text writes a
feature table, from which references and verdicts come.

Defined results: a null or empty text has no words, so it fails the base
rules; a language without a table is judged by the base rules alone, a null
one by the reference it is nearest to; repeated rows get the same answer; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import SPACE_WORDS, literal_array, stage, words_of

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Histograms of fewer characters or words than these are not judged.
MIN_CHARS, MIN_COMMON_WORDS = 200, 100
#: Limits of the Jensen-Shannon distances (base 2, 0 to 1).
CHAR_LIMIT, WORD_LIMIT = 0.34, 0.30

#: Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was this with on as be by are at from".split(),
    "de": "der die und in den zu von das mit sich ein des auf für ist im dem nicht als eine".split(),
    "fr": "de la le et des les en du un une est que qui pour dans sur pas au par avec".split(),
    "es": "de la que el en y los se del las un por no con una es al su para lo".split(),
}
#: Character classes as the patterns of all else; lower-case letters are what remains.
CLASSES = {
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "high": r"[\x00-\x7F]+",
    "stop": r"[^.,;:!?'\"()-]+",
    "symbol": r"[^#*$%&|<>]+",
}


def _doubled(words: Column, n: Column) -> Column:
    """Sorted (hash, place) of the 3-word windows; equal hashes are neighbours."""
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    )
    return F.when(n >= 3, F.sort_array(windows))


def features(docs: DataFrame, common: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and both histograms of every text."""
    every = sorted({w for words in common.values() for w in words})
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text"), SPACE_WORDS)).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(SPACE_WORDS)))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("_joined", F.array_join("_words", ""))
    df = df.withColumn("_windows", _doubled(F.col("_words"), F.size("_words")))
    same = lambda a, b: F.get(F.col("_windows"), a)["h"] == F.get(F.col("_windows"), b)["h"]
    twice = F.filter(F.col("_windows"), lambda x, k: F.coalesce(F.when(k > 0, same(k, k - 1)), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform(F.col("_places"), lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(F.col("_places"), k - 1))))
    df = df.withColumn("_common", F.transform(F.filter("_words", lambda w: F.lower(w).isin(every)), F.lower))
    counted = F.transform(
        F.array_distinct("_common"), lambda w: F.struct(w.alias("word"), (F.size("_common") - F.size(F.array_remove(F.col("_common"), w))).cast("long").alias("n"))
    )
    left = lambda pattern: F.length(F.regexp_replace("_joined", pattern, "")).cast("long")
    df = df.select(
        "doc_id",
        "lang",
        "n_words",
        F.length("_joined").cast("long").alias("word_chars"),
        *[left(p).alias(f"_{c}") for c, p in CLASSES.items()],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        counted.alias("common"),
    )
    lower = F.col("word_chars") - sum(F.col(f"_{c}") for c in CLASSES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.array(lower, *[F.col(f"_{c}") for c in CLASSES]).alias("classes"), "common",
    )


def references(feats: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """One row per language of ``common``: shares of the character classes and of the common words."""
    good = feats.filter(~F.col("base_failed") & F.col("lang").isin(list(common)))
    k = len(CLASSES) + 1
    sums = good.groupBy("lang").agg(F.sum("n_words").alias("w"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(k)])
    words = good.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.word").agg(F.sum("x.n").alias("n"))
    listed = F.create_map(*[F.lit(v) if isinstance(v, str) else literal_array(v, "string") for kv in common.items() for v in kv])
    words = words.filter(F.array_contains(F.element_at(listed, F.col("lang")), F.col("word")))
    words = words.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("n"))  # at most the words of one table
    total = sum(F.col(f"c{i}") for i in range(k))
    return sums.join(words, "lang", "left").select(
        F.col("lang").alias("ref"),
        F.array(*[F.col(f"c{i}") / total for i in range(k)]).alias("ref_classes"),
        F.coalesce(F.transform_values("n", lambda _, n: n / F.col("w")), F.create_map().cast("map<string,double>")).alias("ref_words"),
    )


def _part(p: Column, q: Column) -> Column:
    """What one entry adds to the divergence of p and q."""
    m = (p + q) / 2
    return F.when(p > 0, p / 2 * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q / 2 * F.log2(q / m)).otherwise(0.0)


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def char_distance(ref: Column) -> Column:
    """Jensen-Shannon distance of the row's character classes from a reference."""
    by_class = F.zip_with("classes", ref["ref_classes"], lambda n, q: _part(n / F.col("word_chars"), q))
    return _root(F.aggregate(by_class, F.lit(0.0), lambda a, x: a + x))


def word_distance(ref: Column) -> Column:
    """Jensen-Shannon distance of the row's common words from a reference.

    A listed word that the text lacks adds half its share; the last entry is every other word.
    """
    known = ref["ref_words"]
    both = F.transform(
        F.filter("common", lambda x: F.map_contains_key(known, x["word"])),
        lambda x: F.struct((x["n"] / F.col("n_words")).alias("p"), F.element_at(known, x["word"]).alias("q")),
    )
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    add = lambda a, x: F.struct((a["d"] + _part(x["p"], x["q"])).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q"))
    every = F.aggregate(F.map_values(known), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(both, start, add, lambda a: _root(a["d"] + (every - a["q"]) / 2 + _part(1 - a["p"], 1 - every)))


def judge(feats: DataFrame, refs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Add both distances and the verdict ``kept``. ``refs`` has one row per language table."""
    one = refs.agg(F.map_from_entries(F.collect_list(F.struct("ref", F.struct("ref_classes", "ref_words")))).alias("refs"))
    df = feats.crossJoin(F.broadcast(one))  # a single row
    own = F.array_compact(F.array(F.element_at("refs", F.col("lang"))))
    df = df.withColumn("_rivals", F.when(F.col("lang").isNull(), F.map_values("refs")).otherwise(own))
    nearest = lambda f: F.array_min(F.transform("_rivals", f))
    df = df.withColumn("char_distance", F.when(F.col("word_chars") >= MIN_CHARS, nearest(char_distance)))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_COMMON_WORDS, nearest(word_distance)))
    far = F.coalesce(F.col("char_distance") > char_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~far).drop("refs", "_rivals")


def quality_verdicts(docs: DataFrame, common: dict[str, list[str]] | None = None, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Features, distances and verdicts of all rows of ``docs`` (doc_id, text, lang)."""
    common = COMMON_WORDS if common is None else common
    feats = stage(features(docs, common), "quality")
    return judge(feats, references(feats, common), char_limit, word_limit)
