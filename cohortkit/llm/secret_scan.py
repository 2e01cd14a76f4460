"""Secret scan with a random forest that removes false positives.

Candidates are every value assigned to a credential name (any length, with or
without digits, quoted or not, also in URLs, .env lines and JSON), long runs
of key characters that hold a digit, and provider tokens. A name before ``=``
belongs to the lead, not to the value. Each candidate gets features of its
length, character transitions, spread, dictionary coverage, path and
neighbouring words. A random forest trained on labelled findings tells secrets
from card numbers, checksums, ids and the like. Labelled findings may be
given; else provider formats, assignments to credential names and well-known
harmless forms label a bounded sample of the corpus's own candidates.

All columns are built-in expressions, the forest is Spark's.

Defined results: null and empty texts have no candidates; repeated rows are
reported each; a null id is carried as it is; with labelled findings of one
kind only (or none) the labels' rule decides alone; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import free_name, row_key, SPACE_WORDS, stage, words_of
from cohortkit.llm.sampling import bounded_sample

#: Documented bound of the training sample, per kind.
SAMPLE = 3000
MASK = "[SECRET]"
#: Token formats of public services, at token borders.
PROVIDER = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
    r"|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])|eyJ[A-Za-z0-9_\-]{16,})"
)
#: Words that come before secrets, before harmless digests, and in placeholders.
CREDENTIAL = (
    r"(?i)(token(?!i[sz]|_?type)|secret(?!ar)|passw|passphrase|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key"
    r"|auth(?!or(?!i[sz])|_?type)|bearer|credential)"
)
DIGEST = r"(?i)(commit|sha-?\d*|md5|checksum|digest|etag|uuid|guid|revision|integrity|hash|build|version|isbn|order|invoice|card|phone)"
PLACEHOLDER = r"(?i)(example|sample|placeholder|changeme|your|dummy|test|xxxx|0000000|1234567|^[<\[{$%].*[>\]}%)]$|^\*+$)"
#: Unquoted code that stands for a value, plain words, and sentences.
REFERENCE = r"(?i)^(none|null|nil|true|false|undefined|str|bytes|bool|int)$|^[$%@*]|[(\[{]|^[a-z_]\w*(\.[a-z_]\w*)+$"
PLAIN = r"^[A-Za-z]?[a-z]*(?:(?:[_.\-][A-Z]?|[A-Z])[a-z]+)*[.!?:]?$|^[A-Z_]+$"
SENTENCE = r"^[A-Z][a-z]+ |[.!?:]$|(?i)\b(the|your|you|a|an|is|must|to|of|and|for|be|or|not|in|with)\b"
_KEY = r"[A-Za-z0-9+/_\-]"
#: A run of 16 or more key characters that holds a digit or a provider token; starts only where a run starts, so long runs cost one look.
RUN = rf"(?<!{_KEY})(?=[A-Za-z+/_\-]*+[0-9]|{_KEY}*?{PROVIDER}){_KEY}{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/_=\-]))?+"
_NAME = r"[\w.\-]"
_AFTER_NAME = r"[\"'`\])\\]{0,4}[ \t]*+"
_SIGN = r"(?:=>|:=|={1,3}|:(?!:|//))"
#: Name of one or two words that holds a credential word, the sign of an assignment, a type, an opening quote, an authorisation scheme.
LEAD = (
    rf"(?<!{_NAME})(?={_NAME}++(?: {_NAME}++)?+{_AFTER_NAME}{_SIGN})(?={_NAME}*?{CREDENTIAL}){_NAME}++(?: {_NAME}++)?+{_AFTER_NAME}"
    rf"(?::[ \t]*+[A-Za-z_][\w.\[\]]*+[ \t]*+=(?!=)|{_SIGN})[ \t]*+(?:\\?[\"'`])?(?:(?i:bearer|basic|token|apikey)[ \t]++)?"
)
_INNER = r"""[^\s"'`<>&;,)\]}]"""
_NEXT = r"""\s|$|["'`]|[)\]}&;,]|[A-Za-z_][\w.\-]*+["']?[=:]"""
#: Up to the closing quote of its line; without one up to white space, the next quote or the next name of a list or URL.
ASSIGNED = (
    r"""(?<=\\")[^"\\\r\n]++(?=\\")|(?<=(?<!\\)")(?:[^"\\\r\n]|\\.)++(?=")|(?<=')(?:[^'\\\r\n]|\\.)++(?=')|(?<=`)[^`\r\n]++(?=`)"""
    rf"|(?:{_INNER}|[&;,)\]}}](?!{_NEXT}))++"
)
#: Marks around a value in its text: an assigned value stands before the second, a run after it.
_OPEN, _MID, _SHUT = "\ufffe", "\ufdd1", "\uffff"
#: Parts of identifiers that people write.
DICTIONARY = (
    "access address admin api app auth base build client code commit config content data date default docs document end error event example file form "
    "group handler home http https id image index info item key lib line link list log login main map message model module name new node number object "
    "page password path private public query request response result root script secret server service session set source start state string style "
    "system table test text time token tree type update url user value version view web word"
).split()
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, word_no, word, before, after, prefix, named, value) of every candidate; ``prefix`` is the word's part before the value."""
    bare = lambda c: F.regexp_replace(c, f"[{_OPEN}{_MID}{_SHUT}]", "")
    text = F.coalesce(F.col(text_col), F.lit(""))
    clear = F.when(text.rlike(f"[{_OPEN}{_MID}{_SHUT}]"), F.regexp_replace(text, f"[{_OPEN}{_MID}{_SHUT}]", "\ufffd")).otherwise(text)
    found = f"({LEAD})({ASSIGNED})|({RUN})".replace("(?i)(token", "(?i:token")
    marked = F.regexp_replace(clear, found, f"$1{_OPEN}$2{_MID}$3{_SHUT}")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), marked.alias("_marked")).filter(F.col("_marked").contains(_OPEN))
    rows = rows.select("doc_id", row_key(F.col("doc_id"), F.col("_text")).alias("key"), "_marked", words_of(F.col("_marked"), SPACE_WORDS).alias("_words"))
    held = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].contains(_OPEN))
    count = lambda w: F.size(F.split(w, _OPEN)) - 1
    spots = F.flatten(F.transform(held, lambda x: F.transform(F.sequence(F.lit(1), count(x["w"])), lambda k: F.struct(x["i"].alias("i"), x["w"].alias("w"), k.alias("k")))))
    values = F.regexp_extract_all("_marked", F.lit(f"{_OPEN}[^{_SHUT}]*+"), F.lit(0))
    rows = rows.select("doc_id", "key", "_words", spots.alias("_spots"), values.alias("_values"))
    near = F.zip_with(
        "_spots",
        "_values",
        lambda x, v: F.struct(
            x["i"].cast("long").alias("word_no"),
            bare(x["w"]).alias("word"),
            bare(F.array_join(F.slice("_words", F.greatest(x["i"] - 2, F.lit(1)), F.least(x["i"], F.lit(3))), " ")).alias("before"),
            bare(F.coalesce(F.get("_words", x["i"] + 1), F.lit(""))).alias("after"),
            bare(F.call_function("substring_index", x["w"], F.lit(_OPEN), x["k"])).alias("prefix"),
            v.endswith(_MID).alias("named"),
            bare(v).alias("value"),
        ),
    )
    return rows.select("doc_id", "key", F.explode(near).alias("x")).select("doc_id", "key", "x.*")


def _kept_share(value: str, pattern: str) -> Column:
    """Share of the value's characters that ``pattern`` removes."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


FEATURES = [
    "length", "class_runs", "digits", "uppers", "letters", "symbols", "vowel_turns", "distinct", "hex", "dictionary",
    "path_marks", "extension", "url", "credential_near", "digest_near", "placeholder", "assigned", "quoted", "provider", "plain", "sentence",
]


def with_features(found: DataFrame) -> DataFrame:
    """Numeric features of candidates."""
    flag = lambda c: c.cast("double")
    runs = lambda pattern: F.size(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))) / F.length("value")
    lead = F.concat_ws(" ", "before", "prefix")
    quoted = F.col("_lead").rlike("[\"'`]$") | F.col("value").contains(" ")
    plain = F.col("value").rlike(PLAIN) & ~quoted & ~F.col("_lead").rlike("[A-Z0-9_]=$") & (F.length("value") < 16)
    return found.withColumn("_lead", lead).withColumns(
        {
            "length": F.length("value").cast("double"),
            "class_runs": runs(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"),
            "digits": _kept_share("value", "[0-9]"),
            "uppers": _kept_share("value", "[A-Z]"),
            "letters": _kept_share("value", "[A-Za-z]"),
            "symbols": _kept_share("value", "[^A-Za-z0-9]"),
            "vowel_turns": runs("[aeiouAEIOU][b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]"),
            "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
            "hex": flag(F.col("value").rlike("^[0-9a-fA-F]+$")),
            "dictionary": _kept_share("value", "(?i)(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)) + ")"),
            "path_marks": F.least(_kept_share("word", r"[/\\.]"), F.lit(1.0)),
            "extension": flag(F.col("word").rlike(r"\.[a-z]{2,4}\b")),
            "url": flag(F.col("word").rlike("(?i)(https?|ftp|www)[:.]")),
            "credential_near": flag(F.col("_lead").rlike(CREDENTIAL) | F.col("named")),
            "digest_near": flag(F.col("_lead").rlike(DIGEST)),
            "placeholder": flag(F.col("value").rlike(PLACEHOLDER) | (F.col("named") & ~quoted & F.col("value").rlike(REFERENCE))),
            "assigned": flag(F.col("_lead").rlike("[=:]\\s*[\"']?$") | F.col("named")),
            "quoted": flag(quoted),
            "provider": flag(F.col("value").rlike(PROVIDER)),
            "plain": flag(plain),
            "sentence": flag(F.col("value").contains(" ") & F.col("value").rlike(SENTENCE)),
        }
    )


def weak_label(prefix: str = "") -> Column:
    """1 a secret, 0 harmless, null where the rules do not tell."""
    c = lambda name: F.col(prefix + name)
    named = (c("credential_near") == 1) & (c("assigned") == 1)
    harmless = (c("digits") == 1) | c("value").rlike(UUID) | ((c("url") == 1) & ~named) | (c("placeholder") == 1) | ((c("digest_near") == 1) & (c("credential_near") == 0))
    harmless = harmless | (c("dictionary") > 0.5) | ((c("distinct") < 0.15) & (c("distinct") * c("length") < 10)) | (c("plain") == 1) | (c("sentence") == 1)
    secret = (c("provider") == 1) | (named & (c("digits") < 1) & (~c("value").contains(" ")))
    return F.when(harmless & (c("provider") == 0), 0).when(secret, 1)


def train(labelled: DataFrame, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel | None:
    """Forest from labelled findings (features and ``label``); None if they are of one kind."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled.select(*FEATURES, F.col("label").cast("double").alias("label")))
    rows = stage(rows.select("features", "label"), "secret-labels")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, minInstancesPerNode=2).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with its score and the verdict ``secret``: doc_id, key, word_no, value, score, secret."""
    found = stage(with_features(candidates(docs, id_col, text_col)), "secret-candidates")
    if labelled is None:
        marked = found.withColumn("label", weak_label()).withColumn("_k", F.xxhash64("key", "word_no", "value"))
        labelled = bounded_sample(marked, "label", "_k", SAMPLE, 5)
    model = train(labelled)
    if model is None:
        scored = found.withColumn("score", F.coalesce(weak_label(), F.lit(0)).cast("double"))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "key", "word_no", "value", "score", (F.col("score") >= at_least).alias("secret"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with their secrets replaced by a mask; same columns, every row kept.

    Values of 16 or more characters go wherever they stand, shorter ones where
    they stand as a whole token; short ones of letters only go after the sign
    of an assignment, as they may be words of the text. ``n_chars``, where
    there is one, follows the changed text.
    """
    key, held = free_name(docs, "_key"), free_name(docs, "_values")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    ranked = F.struct((-F.length("value")).alias("n"), F.col("value").alias("v"))  # a value may hold another: longest first
    values = found.filter("secret").groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set(ranked)).alias(held))  # of one text
    out = keyed.join(values, key, "left")

    def without(text: Column, x: Column) -> Column:
        literal = F.regexp_replace(x["v"], r"([^A-Za-z0-9\s])", r"\\$1")
        start = F.when(x["v"].rlike("^[A-Za-z]+$"), r"(?<=[=:>][ \t]{0,8}\\?[\"'`]?(?i:bearer |basic |token )?)").otherwise("(?<![A-Za-z0-9])")
        return F.when(x["n"] <= -16, F.replace(text, x["v"], F.lit(MASK))).otherwise(F.regexp_replace(text, F.concat(start, literal, F.lit("(?![A-Za-z0-9])")), F.lit(MASK)))

    masked = F.aggregate(held, F.col("text"), without)
    out = out.withColumn("text", F.when(F.col(held).isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(held).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])
