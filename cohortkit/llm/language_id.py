"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs within it.

Texts become square roots of hashed byte n-gram shares (1 to 4 bytes, lower
case, white space runs as one space), scaled to unit length. A classifier over
families picks the family; its own pairwise SVMs pick the language. The fit
uses at most ``SAMPLE`` documents of each language; predictions read every
whole text. The winner of a vote says nothing of texts in no learned language;
``Familiarity`` tells those by the mean log share of their n-grams in the
winner's sample, against what held-out sample rows of that length have.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where nothing could be learned; rows with a null language are predicted but
not learned from; repeated rows get the same answer; a null id counts as the
empty text in the split; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import crc_remainder, free_name
from cohortkit.llm.linear_svm import OneVersusOne
from cohortkit.llm.sampling import bounded_sample

#: Documented bound of the training sample, per language.
SAMPLE = 500
BUCKETS = 4096
#: Texts judged at a time: the tables of ``Familiarity`` take about 100 kB for each.
JUDGED = 64
#: Language codes of the larger European families. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "finnic": ("fi", "et"),
    "baltic": ("lt", "lv"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: What may be a letter; numbers such as one half or a Roman numeral sign are told apart by their category.
_MAY_BE_LETTER = re.compile(r"[^\W\d_]")
_SPACES = re.compile(r"\s+")
_OTHER = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def has_letter(text: str) -> bool:
    """Whether the text holds a character of a Unicode category L."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _MAY_BE_LETTER.finditer(text))


def features(texts: list[str]) -> np.ndarray:
    """One unit-length row of ``BUCKETS`` numbers per text."""
    out = np.zeros((len(texts), BUCKETS), "float32")
    for i, text in enumerate(texts):
        b = np.frombuffer(b" " + _SPACES.sub(" ", text.lower()).strip().encode() + b" ", "u1").astype("u4")
        counts = np.zeros(BUCKETS)
        gram = np.zeros(len(b), "u4")
        for n in range(1, 5):
            # a gram's code takes in one more byte at each step, then is spread by a multiplier
            gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
        root = np.sqrt(counts)
        out[i] = root / np.linalg.norm(root)
    return out


def letters_only(texts: list[str]) -> np.ndarray:
    """``features`` of the words alone: marks, digits and symbols tell nothing of whether a language is a learned one."""
    return features([_OTHER.sub(" ", t) for t in texts])


class Familiarity:
    """Whether a text's n-grams are as usual in a language as those of its learned rows, each judged without itself."""

    #: Deviations that any learned row may have; grams that overlap count as one; weight of a bucket not seen.
    DEVIATIONS, OVERLAP, UNSEEN = 4.0, 8.0, 1e-5

    def __init__(self, x: np.ndarray):
        shares = (x * x).astype("float64")  # of the grams, as rows are roots of shares
        total, n = shares.sum(axis=0), len(x)
        self.log_share = np.log((total + self.UNSEEN * n) / (n * (1 + BUCKETS * self.UNSEEN)))
        m = n - 1
        own = np.array([v @ np.log((total - v).clip(0) + self.UNSEEN * max(m, 1)) - np.log(max(m, 1) * (min(m, 1) + BUCKETS * self.UNSEEN)) for v in shares])
        self.mean, self.spread = np.median(own), 1.4826 * np.median(np.abs(own - np.median(own)))
        usual = total / n
        self.of_gram = max(usual @ self.log_share**2 - (usual @ self.log_share) ** 2, 0.0)
        self.limit = max(self.DEVIATIONS, np.quantile(self.deviations(shares, own), 0.995))

    def deviations(self, shares: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How far below the mean, in standard deviations of texts of that length."""
        grams = 1 / np.where(shares > 0, shares, 1).min(axis=1)  # some gram of a text occurs once
        return (self.mean - value) / np.sqrt(self.spread**2 + self.OVERLAP * self.of_gram / grams + 1e-9)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        shares = (x * x).astype("float64")
        return self.deviations(shares, shares @ self.log_share) <= self.limit


class HierarchicalModel:
    """Families told apart by one vote of SVMs, the languages of each family by another."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, familiar: dict[str, Familiarity] | None = None):
        families = np.array([family_of(v) for v in langs])
        self.top = OneVersusOne(x, families)
        self.within = {f: OneVersusOne(x[families == f], langs[families == f]) for f in self.top.classes}
        self.familiar = familiar or {}
        members = [self.top, *(self.within[f] for f in self.top.classes)]
        weights = np.vstack([m.weights for m in members])
        self.weights, self.bias = np.ascontiguousarray(weights[:, :-1].T), weights[:, -1]
        self.cuts = np.cumsum([0, *(len(m.weights) for m in members)])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = x @ self.weights + self.bias
        family, sure = self.top.predict(margins[:, : self.cuts[1]])
        langs, score = np.empty(len(x), object), sure.copy()
        for k, name in enumerate(self.top.classes):
            at = np.flatnonzero(family == k)
            won, own = self.within[name].predict(margins[at, self.cuts[k + 1] : self.cuts[k + 2]])
            langs[at] = np.array(self.within[name].classes, object)[won]
            score[at] = np.minimum(score[at], own)
        return langs, score


    def is_familiar(self, words: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Whether each text, given by ``letters_only``, reads as its predicted language."""
        out = np.zeros(len(words), bool)
        for lang in set(langs):
            at = np.flatnonzero(langs == lang)
            out[at] = self.familiar[lang](words[at])
        return out


def training_sample(docs: DataFrame, may_learn: Column, per_language: int = SAMPLE) -> DataFrame:
    """At most ``per_language`` distinct labelled rows of each language."""
    rows = docs.filter(may_learn & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    return bounded_sample(rows, "lang", "doc_id", per_language, 11).select("lang", "text")


def fit(docs: DataFrame, may_learn: Column, per_language: int = SAMPLE, judged: bool = True) -> HierarchicalModel | None:
    """Fit on the bounded sample; None if it has no usable row. Features are made by the executors; those of familiarity only if ``judged``."""
    makers = {"x": features} | ({"words": letters_only} if judged else {})

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            if len(batch):
                yield pd.DataFrame({"lang": batch["lang"]} | {c: [v.astype("float16").tobytes() for v in make_x(list(batch["text"]))] for c, make_x in makers.items()})

    schema = ", ".join(["lang string", *(f"{c} binary" for c in makers)])
    sample = training_sample(docs, may_learn, per_language).mapInPandas(make, schema).toArrow().combine_chunks()
    if not len(sample):
        return None
    packed, langs = {c: _matrix(sample.column(c)) for c in makers}, sample.column("lang").to_numpy()
    del sample  # each matrix goes when it has served
    order = sorted(range(len(langs)), key=lambda i: (langs[i], hashlib.blake2b(packed["x"][i], digest_size=16).digest()))
    langs = langs[order]
    words = packed.pop("words", None)
    by_lang = {v: np.array(order)[langs == v] for v in dict.fromkeys(langs)}
    familiar = {v: Familiarity(words[at].astype("float32")) for v, at in by_lang.items()} if judged else None
    del words
    return HierarchicalModel(packed.pop("x")[order].astype("float32"), langs, familiar)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of ``BUCKETS`` half-precision numbers from a column of packed rows."""
    parts = [np.frombuffer(c.buffers()[2], "float16", BUCKETS * len(c), c.offset * BUCKETS * 2).reshape(len(c), BUCKETS) for c in column.chunks if len(c)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def with_prediction(docs: DataFrame, model: HierarchicalModel | None, name: str, judged: bool = False) -> DataFrame:
    """Add the struct ``name`` of lang_pred, score and, if ``judged``, whether it is familiar; the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            familiar = np.zeros(len(batch), bool)
            at = np.array([i for i, t in enumerate(batch) if t is not None and has_letter(t)], int)
            for part in np.array_split(at, len(at) // 512 + 1) if shared.value is not None and len(at) else []:
                whole = [batch.iloc[i] for i in part]
                langs[part], scores[part] = shared.value.predict(features(whole))
                for k in range(0, len(part), JUDGED) if judged else []:
                    few = part[k : k + JUDGED]
                    familiar[few] = shared.value.is_familiar(letters_only(whole[k : k + JUDGED]), langs[few])
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "familiar": familiar})

    return docs.withColumn(name, F.pandas_udf(score, "lang_pred string, score double, familiar boolean")(F.col("text")))


def accepted(docs: DataFrame, model: HierarchicalModel | None, languages: list[str] | None = None, at_least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that read as a learned language (among ``languages``) with a score of ``at_least``; same columns."""
    name = free_name(docs, "_found")
    found = with_prediction(docs, model, name, judged=True)
    said = F.col(name)
    good = (said["lang_pred"] != "und") & said["familiar"] & (said["score"] >= at_least)
    if languages is not None:
        good = good & said["lang_pred"].isin(languages)
    return found.filter(good).select(*[f"`{c}`" for c in docs.columns])


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2, per_language: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; rows held out are never learned from."""
    out = crc_remainder(F.col("doc_id"), modulus) == held_out
    model = fit(docs, ~out, per_language, judged=False)
    found = with_prediction(docs.select("doc_id", "text", out.alias("held_out")), model, "_found")
    return found.select("doc_id", "held_out", "_found.lang_pred", "_found.score")
