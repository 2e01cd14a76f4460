"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts with equal shingle sets form one class (a third of all rows may be
   one class; only its least id goes on).
2. Banded MinHash gives candidate buckets. Texts that share one with another
   text are read once more; all later steps read that smaller table.
3. Every document is compared with the pivot of each of its buckets: the text
   that meets most others in its buckets, so the middle of a group of near
   copies rather than any of them. The links found join the components of
   large groups. Where comparing the buckets in full would still be far more
   work than reading them, rounds follow: in small cells of each bucket every
   text meets one of another component, and the partner with the most equal
   signature values is confirmed; a round that no longer helps is the last.
4. Buckets that still hold several components are compared in full, except
   inside a component, where links cannot change the result. In large buckets
   (texts that drifted from one source) rare shingles decide which pairs are
   met: a linked text can miss only so many of another's shingles, so a text
   with more rare ones than that shares some of them with each text it is
   linked to, and is found through these; only texts with few rare shingles
   are compared bucket by bucket. No pair that reaches the threshold is lost.
5. Pairs are checked in batches of signature values: a pair whose posterior
   chance of reaching the threshold falls below ``MISS`` is pruned. All
   survivors are confirmed on their whole shingle sets.
6. Components spread by steps that halve paths; nothing is collected.

Defined results: null or empty texts and texts without words have an empty
set and are linked with nothing; rows without an id are linked with nothing
and kept; a row takes the component of its own text, also where rows share an
id (repeated rows are all kept or all dropped); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import small_batches, stage
from cohortkit.llm.shingles import mix, shingle_set

#: Values per band, and the chance at which a pair at the threshold may miss all bands.
ROWS, BAND_MISS = 5, 5e-7
#: Signature values compared per step, and the miss probability of pruning a pair.
BATCH, MISS = 25, 1e-7
#: Buckets above so many texts go by rare shingles: those that so many texts of such buckets have at most.
LARGE, RARE = 64, 64
#: Rounds go on while full comparison looks at more than so many rows for each row (it writes few of them), and a round saves this share of it; texts of a cell.
WORTH, SAVED, CELL = 256, 0.2, 8
_RNG = np.random.default_rng(85)
_FACTOR = _RNG.integers(1, 2**63, 1000, dtype="u8") * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(1, 2**63, ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)


def bands_for(threshold: float) -> int:
    """Fewest bands that keep the miss chance: 25 at 0.85, 37 at 0.8."""
    return max(1, min(len(_FACTOR) // ROWS, math.ceil(math.log(BAND_MISS) / math.log1p(-(threshold**ROWS) + 1e-12))))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """MinHash values of a set under ``size`` multipliers."""
    low, factors = np.full(size, np.uint64(2**64 - 1)), _FACTOR[:size]
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * factors).min(axis=0))
    return low


def signed(docs: DataFrame, n: int, bands: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class digest (c1, c2), band keys and one byte of each MinHash value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(bands, dtype="u8") << np.uint64(32)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, n)
                if not len(s):
                    out.append((doc, 0, None, None, None, None))
                    continue
                low = mix(signature(s, bands * ROWS))
                keys = mix((low.reshape(bands, ROWS) * _FOLD).sum(axis=1) + salt)
                digest = (mix(s ^ _FOLD[0]).sum(), mix(s ^ _FOLD[1]).sum())
                out.append((doc, len(s), *(int(d.astype("i8")) for d in digest), keys.astype("i8"), low.astype("u1").tobytes()))
            made = pd.DataFrame(out, columns=["doc_id", "n_shingles", "c1", "c2", "keys", "sig"])
            for c in ("doc_id", "c1", "c2"):
                made[c] = made[c].astype("Int64")
            yield made

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, c1 long, c2 long, keys array<long>, sig binary")


def least_matches(threshold: float, n: int, miss: float) -> int:
    """Fewest equal values among ``n`` that leave the threshold a posterior chance of ``miss`` or more.

    Values are bytes, so different minima agree once in 256. With a uniform
    prior the posterior tail is a binomial sum.
    """
    c = threshold + (1 - threshold) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * c**m * (1 - c) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def pruned(pairs: DataFrame, signs: DataFrame, threshold: float, total: int, miss: float = MISS, batch: int = BATCH) -> DataFrame:
    """Candidate pairs (a, b) that pass the sequential posterior test, with their equal signature values."""
    steps = [0, *range(batch, total, batch), total]
    bounds = [(i, k, least_matches(threshold, k, miss)) for i, k in zip(steps, steps[1:])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            a = np.frombuffer(b"".join(rows["sig_a"]), "u1").reshape(-1, total)
            b = np.frombuffer(b"".join(rows["sig_b"]), "u1").reshape(-1, total)
            alive, matches = np.arange(len(rows)), np.zeros(len(rows), int)
            for i, k, least in bounds:
                matches[alive] += (a[alive, i:k] == b[alive, i:k]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield rows.iloc[alive][["a", "b"]].assign(equal=matches[alive])

    one = lambda c: signs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long, equal long")


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their whole shingle sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for rows in batches:
            keep = np.zeros(len(rows), bool)
            for i, (ta, tb) in enumerate(zip(rows["ta"], rows["tb"], strict=True)):
                if last[0] != ta:
                    last = (ta, shingle_set(ta, n))
                x, y = last[1], shingle_set(tb, n)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield rows[keep][["a", "b"]]

    one = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long").distinct()


def rare_shingles(texts: DataFrame, chosen: DataFrame, n: int, most: int = RARE) -> DataFrame:
    """(s, id, n): the shingles of the chosen documents that ``most`` of their texts have at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, n).astype("i8") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["doc_id"], "n": [len(s) for s in sets], "sh": sets})

    rows = texts.join(chosen, "doc_id", "left_semi").mapInPandas(run, "id long, n long, sh array<long>").select("id", "n", F.explode("sh").alias("s"))
    rare = rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= most).select("s")
    return stage(rows.join(rare, "s", "left_semi").distinct(), "rare")


def needed(threshold: float) -> Column:
    """Least intersection of linked sets of sizes n and n2."""
    return F.ceil((F.col("n") + F.col("n2")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes that ``links`` (a, b) name; component is the least node.

    Every step links each node's greater neighbours with its least one and moves
    all ends up to the parent's parent, so paths halve; a step that changes no
    edge ends it. A step is one partially aggregated minimum and two joins with
    it, so a hub's edges are never in one task; every step is written to the
    shared folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc")
    while True:
        parents = edges.groupBy("u").agg(F.min("v").alias("m"))
        hooked = edges.join(parents, "u").select("u", "v", "m")
        above = parents.select(F.col("u").alias("m"), F.col("m").alias("top"))
        moved = hooked.join(above, "m", "left")
        changed = (F.col("v") != F.col("m")) | F.col("top").isNotNull()
        moved = moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.coalesce("top", "m").alias("v"), changed.alias("changed"))
        edges = stage(moved.groupBy("u", "v").agg(F.max("changed").alias("changed")), "cc")
        if not edges.agg(F.max("changed")).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        edges = edges.drop("changed")


def with_components(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """Add ``comp``, the component of ``id`` (the id itself if it has no link)."""
    found = rows.join(joined.withColumnRenamed("node", "id"), "id", "left")
    return found.withColumn("comp", F.coalesce("component", "id")).drop("component")


def open_buckets(binned: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, n, bin, comp, major, most, all): rows of the bins that hold several components, with each bin's largest one, its rows and all rows."""
    known = stage(with_components(binned, joined), "known")
    sizes = known.groupBy("bin", "comp").agg(F.count(F.lit(1)).alias("c"))
    bins = sizes.groupBy("bin").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    return stage(known.join(bins.select("bin", F.col("m.comp").alias("major"), F.col("m.c").alias("most"), "all"), "bin"), "open")


def central_pivots(shared: DataFrame) -> DataFrame:
    """(bin, id2, n2): of each bin's rows (id, n, bin, weight) the one with the greatest weight, of equal ones the least id."""
    one = F.struct("weight", (-F.col("id")).alias("least"), F.col("n").alias("n2"), F.col("id").alias("id2"))
    return shared.groupBy("bin").agg(F.max(one).alias("p")).select("bin", "p.id2", "p.n2")


def partners(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b, n, n2): each row of a bin and one of another component; ``turn`` deals a bin's rows over other cells.

    A row meets the least component of its cell, or the greatest if it belongs to
    the least. Cells are small, so no bin is one task, and a row makes one pair.
    """
    cells = F.greatest(F.ceil(F.col("all") / F.lit(CELL)), F.lit(1))
    dealt = rows.select("id", "n", "comp", "bin", F.pmod(F.xxhash64("id", F.lit(turn)), cells).alias("cell"))
    one = F.struct(F.col("comp").alias("comp2"), F.col("id").alias("id2"), F.col("n").alias("n2"))
    ends = dealt.groupBy("bin", "cell").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo.comp2 < hi.comp2")
    met = dealt.join(ends, ["bin", "cell"]).withColumn("o", F.when(F.col("comp") == F.col("lo.comp2"), F.col("hi")).otherwise(F.col("lo")))
    return met.select(F.least("id", "o.id2").alias("a"), F.greatest("id", "o.id2").alias("b"), "n", F.col("o.n2").alias("n2"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Two documents are linked when their ``n``-word shingle sets have a Jaccard
    similarity of at least ``percent`` / 100; a component keeps its least id.
    Every step that hands texts to Python is written before this returns.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, n, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    threshold = percent / 100
    bands = bands_for(threshold)
    total = bands * ROWS
    all_rows = stage(signed(docs, n, bands, id_col, text_col), "signed")
    rows = all_rows.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("rid")), "classes")
    reps = (
        rows.join(classes.withColumnRenamed("rid", "doc_id"), ["c1", "c2", "doc_id"]).dropDuplicates(["doc_id", "c1", "c2"]).select("doc_id", "n_shingles", "keys", "sig")
    )
    reps = stage(reps, "reps")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    near_size = F.least("n", "n2") >= F.lit(threshold - 1e-9) * F.greatest("n", "n2")

    # buckets of two or more; a text weighs as much as the buckets that it is in (one in each band)
    keyed = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("bin"))
    full = keyed.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = keyed.join(full, "bin").withColumn("weight", F.sum("c").over(Window.partitionBy("id"))).drop("c")
    shared = stage(shared, "bins")
    met = shared.select(F.col("id").alias("doc_id")).distinct()
    met = stage(met, "met")
    signs = stage(reps.select("doc_id", "sig").join(met, "doc_id", "left_semi"), "signatures")
    texts = stage(texts.join(met, "doc_id", "left_semi"), "texts")

    pivots, binned = central_pivots(shared), shared.drop("weight")
    first = binned.join(pivots, "bin").filter((F.col("id") != F.col("id2")) & near_size)
    first = stage(first.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "first-pairs")
    links = stage(confirmed(pruned(first, signs, threshold, total), texts, n, percent), "links")
    joined = connected_components(links)

    # rounds: one partner of another component for each document
    before, turn = math.inf, 0
    while True:
        open_rows = open_buckets(binned, joined)
        size, work = open_rows.agg(F.count(F.lit(1)), F.sum(F.col("all") - F.col("most"))).first()
        if (work or 0) <= WORTH * size or work > (1 - SAVED) * before:
            break
        before, turn = work, turn + 1
        met = pruned(partners(open_rows, turn).filter(near_size).select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), signs, threshold, total)
        ends = stage(met.select("a", "b", "equal", F.explode(F.array("a", "b")).alias("id")), "partners")
        chosen = ends.groupBy("id").agg(F.max(F.struct("equal", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        chosen = stage(chosen, "chosen")
        first = first.union(chosen)
        more = confirmed(chosen, texts, n, percent)
        joined = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        binned = open_rows.select("id", "n", "bin")

    # what still meets across components
    large = open_rows.filter(F.col("all") > LARGE)
    rare = rare_shingles(texts, large.select(F.col("id").alias("doc_id")).distinct(), n)
    rarity = rare.groupBy("id", "n").agg(F.count(F.lit(1)).alias("rare"))
    # one row of each text with its bins, one for each band at most
    held = large.groupBy("id", "n", "comp").agg(F.collect_list(F.struct("bin", "major")).alias("at"))
    held = stage(held.join(rarity, ["id", "n"], "left").withColumn("rare", F.coalesce("rare", F.lit(0))), "large")
    slack, slack2 = F.col("n") - needed(threshold), F.col("n2") - needed(threshold)

    def across(rows: DataFrame, extra: Column) -> DataFrame:
        """Pairs of different components in a bucket; one side is outside its largest component."""
        named = {c: f"{c}2" for c in rows.columns if c not in ("bin", "major", "all", "most")}
        met = rows.filter("comp != major").drop("major", "all", "most").join(rows.withColumnsRenamed(named).drop("all", "most"), "bin")
        # between two minor rows the pair is met from both sides
        one = (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("major")) | (F.col("id") < F.col("id2")))
        return met.filter(one & near_size & extra).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))

    # texts of one source share most of their bins: each pair is met in the least one alone
    few = held.filter(F.col("rare") <= F.lit(1 - threshold + 1e-9) * F.col("n"))
    few = few.select("id", "n", "comp", "rare", F.col("at.bin").alias("bins"), F.explode("at").alias("x")).select("id", "n", "comp", "rare", "bins", "x.*")
    least_bin = F.array_min(F.array_intersect("bins", "bins2")) == F.col("bin")
    direct = across(few, (F.col("rare") <= slack) & (F.col("rare2") <= slack2) & least_bin)
    small = across(open_rows.filter(F.col("all") <= LARGE), F.lit(True))
    told = rare.join(held.drop("at"), ["id", "n"])
    other = told.withColumnsRenamed({c: f"{c}2" for c in ("id", "n", "comp", "rare")})
    by_rare = told.join(other, "s").filter((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & near_size)
    by_rare = by_rare.groupBy("id", "n", "rare", "id2", "n2", "rare2").agg(F.count(F.lit(1)).alias("c"))
    by_rare = by_rare.filter((F.col("c") >= F.col("rare") - slack) & (F.col("c") >= F.col("rare2") - slack2)).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    pairs = small.union(direct).union(by_rare).distinct().join(first, ["a", "b"], "left_anti")
    more = confirmed(pruned(pairs, signs, threshold, total), texts, n, percent)
    found = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    named = classes.join(found.withColumnRenamed("node", "rid"), "rid", "left").select("c1", "c2", F.coalesce("component", "rid").alias("_comp"))
    out = all_rows.select("doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
