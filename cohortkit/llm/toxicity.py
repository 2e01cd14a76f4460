"""Toxicity by a lexicon that tolerates misspellings, scored in context.

Terms come from a seed list and from labelled rows (words and stems that a
greedy cover of the toxic rows needs and that others rarely hold), each
weighed by its share of toxic rows. A stem (``abc*``) takes any ending. The Levenshtein
automata of all terms are run against their common trie at once: states are
sets of (trie node, edits), numbered when a word first reaches them, and all
words of a batch step together. Words are runs of Unicode letters, marks and digits,
folded and split alike in learning and matching; characters without a shape
(soft hyphens, zero-width ones) are passed over, and an edit is one code point.
Around each hit a window of words tells quotation
from abuse. A logistic model over the hits gives the score.

Only labelled rows outside the held-out remainder are learned from, at most
``SAMPLE`` of each label; every whole text is scored from its text alone.

Defined results: null and empty texts have no hits and get the model's lowest
scores; without labelled rows of both kinds a fixed model is used; a document
with several labels counts as toxic if any is; repeated rows get the same
answer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import crc_remainder, stage
from cohortkit.llm.sampling import bounded_sample

#: Documented bound of the training sample, per label.
SAMPLE = 2000
LEARNED_TERMS = 40
WINDOW = 6
#: States of the automaton kept from one batch of texts to the next.
STATES = 100_000
#: Seed terms of abuse.
SEEDS = (
    "idiot moron stupid scum loser trash clown pathetic worthless disgusting imbecile bastard vermin parasite "
    "coward scumbag dumbass asshole retard bitch whore filth lowlife cretin"
).split()
#: Words that report speech.
REPORTING = frozenset("said says called calls wrote writes quote quoted quotes reported term word phrase insult insulted".split())
QUOTES = "\"“”„«»‘’"
#: U+2019 between letters is an apostrophe.
_APOSTROPHE = re.compile(r"(?<=[^\W\d_])’(?=[^\W\d_])")


class _CodePoints:
    """Kind and folded form of code points, looked up by pages of 256 when a text first holds one."""

    def __init__(self):
        n = sys.maxunicode + 1
        self.inside, self.unseen, self.fold = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, "u4")
        self._known = np.zeros(n >> 8, bool)

    def learn(self, codes: np.ndarray) -> None:
        for page in np.flatnonzero(np.bincount(codes >> 8, minlength=len(self._known)).astype(bool) & ~self._known):
            for c in range(page << 8, (page + 1) << 8):
                kind = unicodedata.category(chr(c))
                self.inside[c], self.unseen[c] = kind[0] in "LMN", kind == "Cf"
                self.fold[c] = ord(_folded(chr(c))) if self.inside[c] else c
            self._known[page] = True


def _folded(c: str) -> str:
    """One code point for one code point."""
    return f if len(f := c.casefold()) == 1 else c.lower()[0]


_POINTS = _CodePoints()
FEATURES = 5


#: Weight of a seed term that the sample does not hold.
SEED_WEIGHT = 0.9


def allowed_edits(term: str) -> int:
    """Short terms must match whole; longer ones forgive one or two edits. Stems must be longer for that."""
    if term.endswith("*"):
        return 0 if len(term) < 9 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """The terms' Levenshtein automata run over their trie; states and steps are made when a word first needs them."""

    def __init__(self, weights: dict[str, float]):
        self.terms = sorted(weights)
        self.weight = np.array([weights[t] for t in self.terms])
        self.children: list[dict[int, int]] = [{}]
        self.limit, self.ends, self.stems = [0], {}, {}
        for t, term in enumerate(self.terms):
            node, edits = 0, allowed_edits(term)
            self.limit[0] = max(self.limit[0], edits)
            for b in map(ord, term.rstrip("*")):
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                node = self.children[node][b]
                self.limit[node] = max(self.limit[node], edits)
            (self.stems if term.endswith("*") else self.ends)[node] = t
        self.letters = [None, *sorted({b for c in self.children for b in c})]
        #: Number of each letter of the terms, 0 for all others; the last place stands for all beyond it.
        self.symbol = np.zeros((self.letters[-1] or 0) + 2, "u2")
        self.symbol[self.letters[1:]] = np.arange(1, len(self.letters))
        self._forget()

    def _forget(self) -> None:
        """Only the dead state 0 and the first state 1."""
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.table = np.zeros((0, len(self.letters)), "i4")
        #: Edits and term of the nearest accepted term of each state; -1 if none.
        self.edits, self.term = np.zeros(0, "i1"), np.zeros(0, "i4")
        self._number(frozenset())
        self._number(self._closed({0: 0}))

    def _number(self, state: frozenset) -> int:
        """The state's number; new states get a row of steps not made yet."""
        if state not in self.numbers:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n == len(self.table):
                more = max(256, n)
                self.table = np.vstack([self.table, np.full((more, len(self.letters)), -1, "i4")])
                self.edits, self.term = np.append(self.edits, np.full(more, -1, "i1")), np.append(self.term, np.zeros(more, "i4"))
            hits = [(e, kind[at]) for kind in (self.ends, self.stems) for at, e in state if at in kind and e <= allowed_edits(self.terms[kind[at]])]
            if hits:
                self.edits[n], self.term[n] = max(hits, key=lambda x: (self.weight[x[1]] * (1.0, 0.8, 0.6)[x[0]], x))
        return self.numbers[state]

    def _closed(self, found: dict[int, int]) -> frozenset:
        """Add the nodes reached by leaving letters out."""
        queue = list(found.items())
        while queue:
            node, e = queue.pop()
            for child in self.children[node].values():
                if e < self.limit[child] and found.get(child, 99) > e + 1:
                    found[child] = e + 1
                    queue.append((child, e + 1))
        return frozenset(found.items())

    def _step(self, state: frozenset, letter: int | None) -> frozenset:
        found: dict[int, int] = {}
        for node, e in state:
            if node in self.stems and e <= allowed_edits(self.terms[self.stems[node]]):
                found[node] = min(e, found.get(node, 99))
            if e < self.limit[node] and found.get(node, 99) > e + 1:
                found[node] = e + 1
            for b, child in self.children[node].items():
                cost = e + (b != letter)
                if cost <= self.limit[child] and found.get(child, 99) > cost:
                    found[child] = cost
        return self._closed(found)

    def _stepped(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        to = self.table[state, symbol]
        if (to < 0).any():
            for pair in np.unique(state[to < 0].astype("i8") * len(self.letters) + symbol[to < 0]):
                s, k = divmod(int(pair), len(self.letters))
                number = self._number(self._step(self.states[s], self.letters[k]))
                self.table[s, k] = number
            to = self.table[state, symbol]
        return to

    def match(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Final state of each word (0: no term near) of a text of folded code points; numbers hold until the next call."""
        if len(self.states) > STATES:
            self._forget()
        state, at, k = np.ones(len(starts), "i4"), np.arange(len(starts)), 0
        while len(at):
            state[at] = self._stepped(state[at], self.symbol[np.minimum(text[starts[at] + k], len(self.symbol) - 1)])
            k += 1
            at = at[(lengths[at] > k) & (state[at] > 0)]
        return state


def quotation(window: str, before: str) -> float:
    """0 to 1: how far a window reads as quoting. Quotation marks on both sides count most."""
    window, before = _APOSTROPHE.sub("", window), _APOSTROPHE.sub("", before)
    marks = sum(window.count(q) for q in QUOTES)
    opened = any(q in before for q in QUOTES)
    reported = bool(REPORTING & set(window.lower().split()))
    return min(1.0, 0.5 * (marks >= 2 and opened) + 0.4 * reported + 0.1 * (marks > 0))


def split_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the end of each text behind its line feed, starts and lengths of the words."""
    parts = [t or "" for t in texts]
    raw = np.frombuffer("".join(p + "\n" for p in parts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(p) + 1 for p in parts])
    _POINTS.learn(raw)
    seen = ~_POINTS.unseen[raw]
    if not seen.all():
        raw, ends = raw[seen], np.cumsum(seen)[ends - 1]
    edge = np.diff(_POINTS.inside[raw].astype("i1"), prepend=0)
    starts = np.flatnonzero(edge == 1)
    return raw, ends, starts, np.flatnonzero(edge == -1) - starts


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def words_to_learn(text: str | None) -> list[str]:
    """Distinct folded words of three or more characters that hold a letter, split as the matcher does."""
    raw, _, starts, lengths = split_words([text])
    folded = _text(_POINTS.fold[raw])
    words = dict.fromkeys(folded[a : a + n] for a, n in zip(starts, lengths, strict=True) if n >= 3)
    return [w for w in words if any(c.isalpha() for c in w)]


def hit_features(texts: list[str | None], lexicon: FuzzyLexicon) -> np.ndarray:
    """Per text: strongest hit, summed exact hits, summed misspelled hits, hits per word, quoted share."""
    out = np.zeros((len(texts), FEATURES))
    raw, ends, starts, lengths = split_words(texts)
    begins = np.concatenate([[0], ends[:-1]])
    state = lexicon.match(_POINTS.fold[raw], starts, lengths)
    document = np.searchsorted(ends, starts, "right")
    words = np.bincount(document, minlength=len(texts))
    edits = lexicon.edits[state]
    sums = np.zeros((len(texts), 4))
    for w in np.flatnonzero(edits >= 0):
        d = document[w]
        lo, hi = max(begins[d], starts[max(w - WINDOW, 0)]), min(ends[d], starts[min(w + WINDOW, len(starts) - 1)] + 1)
        before = _text(raw[lo : starts[w]])
        window = _text(raw[lo:hi])
        quoted = quotation(window, before)
        strength = lexicon.weight[lexicon.term[state[w]]] * (1 - 0.7 * quoted) * (1.0, 0.8, 0.6)[edits[w]]
        out[d, 0] = max(out[d, 0], strength)
        sums[d] += (strength * (edits[w] == 0), strength * (edits[w] > 0), 1, quoted)
    out[:, 1:3] = np.log1p(sums[:, :2])
    out[:, 3] = np.minimum(1, 20 * sums[:, 2] / np.maximum(words, 20))
    out[:, 4] = sums[:, 3] / np.maximum(sums[:, 2], 1)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both classes weighing the same; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([*[1.0] * (x.shape[1] - 1), 0.02])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), gradient)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


#: Used where there is nothing to learn from.
FIXED_MODEL = np.array([4.0, 1.0, 0.5, 1.0, -2.0, -2.5])


def labelled_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of labelled rows."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(marks.filter(may_learn), "toxic", "doc_id", per_label, 6)
    # at most ``per_label`` rows of each label
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def term_weights(sample: DataFrame, limit: int = LEARNED_TERMS) -> dict[str, float]:
    """Seed terms, and words and stems that a greedy cover of the toxic rows needs, with their toxic shares.

    The cover keeps out words that are frequent only because one toxic text
    was copied often.
    """
    weights = dict.fromkeys(SEEDS, SEED_WEIGHT)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return weights

    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(words_to_learn)

    rows = sample.select("toxic", F.pandas_udf(split, "array<string>")(F.col("text")).alias("words"))  # bounded sample
    stems = lambda w: F.transform(F.sequence(F.lit(3), F.least(F.length(w) - 1, F.lit(7))), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("*")))
    forms = F.flatten(F.transform("words", lambda w: F.array_append(F.when(F.length(w) > 3, stems(w)).otherwise(F.array().cast("array<string>")), w)))
    rows = stage(rows.select("toxic", F.filter(F.array_distinct(forms), lambda w: F.length(w) <= 24).alias("forms")), "toxic-forms")
    counts = rows.select("toxic", F.explode("forms").alias("form")).groupBy("form").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = (F.col("bad") / n[1]) / ((F.col("good") + 0.5) / n[0])
    share = (F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1)
    counts = stage(counts.filter((F.col("bad") >= 3) & (odds > 8) | F.col("form").isin(SEEDS)).withColumn("share", share), "toxic-counts")
    weights |= {r["form"]: r["share"] for r in counts.filter(F.col("form").isin(SEEDS)).collect()}
    top = {r["form"]: r["share"] for r in counts.orderBy(F.desc(F.col("bad") * F.col("share")), "form").limit(1000).collect()}
    if top:
        listed = F.array(*[F.lit(w) for w in top])
        left = [set(r["w"]) for r in rows.filter("toxic = 1").select(F.array_intersect("forms", listed).alias("w")).collect()]  # bounded sample
        for _ in range(limit):
            tally: dict[str, int] = {}
            for s in left:
                for w in s:
                    tally[w] = tally.get(w, 0) + 1
            best = max(tally, key=lambda w: (tally[w] * top[w] ** 2, w), default=None)
            if best is None or tally[best] < 2:
                break
            weights[best] = top[best]
            left = [s for s in left if best not in s]
    return {w: v for w, v in weights.items() if v >= 0.2}


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = SAMPLE) -> tuple[FuzzyLexicon, np.ndarray]:
    sample = stage(labelled_sample(docs, labels, may_learn, per_label), "toxic-sample")
    lexicon = FuzzyLexicon(term_weights(sample))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = pd.DataFrame(hit_features(list(batch["text"]), shared.value), columns=[f"x{i}" for i in range(FEATURES)])
            yield x.assign(toxic=batch["toxic"].to_numpy())

    schema = ", ".join(f"x{i} double" for i in range(FEATURES)) + ", toxic int"
    rows = sample.mapInPandas(make, schema).toPandas()  # at most ``per_label`` short rows of each label
    if rows["toxic"].nunique() < 2:
        return lexicon, FIXED_MODEL
    rows = rows.sort_values(list(rows.columns))
    return lexicon, fit_logistic(rows.iloc[:, :FEATURES].to_numpy(), rows["toxic"].to_numpy(float))


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, at_least: float = 0.7, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; rows held out are never learned from."""
    out = crc_remainder(F.col("doc_id"), modulus) == held_out
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~out, per_label))

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, w = model.value
        for batch in texts:
            scores = np.zeros(len(batch))
            for i in range(0, len(batch), 256):
                x = hit_features([t if isinstance(t, str) else None for t in batch.iloc[i : i + 256]], lexicon)
                scores[i : i + 256] = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
            yield pd.Series(scores)

    scored = docs.select("doc_id", out.alias("held_out"), F.pandas_udf(score, "double")(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= at_least).cast("int"))
