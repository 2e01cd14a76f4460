"""Risk-set sums of a Cox model over rows in time order.

Rows are counted (equal rows are one), dealt to blocks by descending duration
and sorted, once per fit. A pass over the blocks then needs no shuffle:

1. every block sums its rows (``w = exp(eta)``, ``w z``, ``w z z'``, and the same
   over events). The blocks' totals, added up from the latest one, are what each
   block starts from.
2. every block streams its rows, forms the risk set of each of its times and
   adds up its Efron terms: log likelihood, gradient and Hessian.

A time may stand in many blocks (a third of all units may be censored on one
day): blocks are cut by duration and a hash. Each block also sums its first
and last time, so the driver joins such a time, and the tasks leave it out.
What reaches the driver is a fixed number of sums for each of at most
``max_blocks`` blocks, whatever the number of rows or times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that all blocks together may send to the driver, numbers held at once in a task, tied events summed at once.
DRIVER_NUMBERS, TASK_NUMBERS, TIE_BLOCK = 8_000_000, 4_000_000, 65_536


@dataclass(frozen=True)
class Sums:
    """Places of the sums of one time in a vector: units, w, events' w, events, events' eta, w z, events' w z, events' z, w zz', events' w zz'."""

    p: int

    @property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.triu_indices(self.p)

    @property
    def width(self) -> int:
        return 5 + 3 * self.p + self.p * (self.p + 1)

    def of_rows(self, n: np.ndarray, e: np.ndarray, z: np.ndarray, beta: np.ndarray) -> np.ndarray:
        eta = z @ beta
        w = n * np.exp(eta)
        j, k = self.pairs
        zz = z[:, j] * z[:, k]
        ew, ne = (e * w)[:, None], (n * e)[:, None]
        return np.hstack([n[:, None], w[:, None], ew, ne, ne * eta[:, None], w[:, None] * z, ew * z, ne * z, w[:, None] * zz, ew * zz])

    def parts(self, m: np.ndarray) -> dict[str, np.ndarray]:
        p, q = self.p, self.p * (self.p + 1) // 2
        at = np.cumsum([5, p, p, p, q, q])
        out = dict(zip(("n", "s0", "d0", "d", "eta"), m.T[:5], strict=True))
        for name, a, b in zip(("s1", "d1", "x", "s2", "d2"), at, at[1:], strict=False):
            out[name] = m[:, a:b]
        for name in ("s2", "d2"):
            full = np.zeros((len(m), p, p))
            j, k = self.pairs
            full[:, j, k] = full[:, k, j] = out[name]
            out[name] = full
        return out


def efron(p: int, risk: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log partial likelihood, gradient, Hessian and Efron weighted means of times, given the sums of their risk sets and their own."""
    sums = Sums(p)
    at = np.flatnonzero(own[:, 3] > 0)
    r, o = sums.parts(risk[at]), sums.parts(own[at])
    means = np.zeros((len(own), p))
    d = np.rint(o["d"]).astype(int)
    ll, grad = float(o["eta"].sum()), o["x"].sum(axis=0)
    one = d == 1
    r0, r1, r2 = r["s0"][one], r["s1"][one], r["s2"][one]
    ratio = r1 / r0[:, None]
    ll -= float(np.log(r0).sum())
    grad = grad - ratio.sum(axis=0)
    hess = ratio.T @ ratio - np.einsum("ijk,i->jk", r2, 1 / r0)
    means[at[one]] = ratio
    for i in np.flatnonzero(~one):
        # phi and its derivatives are linear in the tie index, so sums of scalars suffice
        a0 = a1 = b0 = b1 = b2 = 0.0
        for first in range(0, d[i], TIE_BLOCK):
            frac = np.arange(first, min(first + TIE_BLOCK, d[i])) / d[i]
            phi = r["s0"][i] - frac * o["d0"][i]
            ll -= float(np.log(phi).sum())
            a0, a1 = a0 + (1 / phi).sum(), a1 + (frac / phi).sum()
            b0, b1, b2 = b0 + (1 / phi**2).sum(), b1 + (frac / phi**2).sum(), b2 + (frac**2 / phi**2).sum()
        all_units, dead = r["s1"][i], o["d1"][i]
        ratio = all_units * a0 - dead * a1
        grad = grad - ratio
        cross = np.outer(all_units, dead)
        hess = hess - (r["s2"][i] * a0 - o["d2"][i] * a1 - (np.outer(all_units, all_units) * b0 - (cross + cross.T) * b1 + np.outer(dead, dead) * b2))
        means[at[i]] = ratio / d[i]
    return ll, grad, hess, means


def _times(batches: Iterator[pd.DataFrame], zcols: list[str], beta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(times, sums) of a block in descending order; a time is handed over when all its rows are in."""
    sums = Sums(len(zcols))
    step = max(1, TASK_NUMBERS // sums.width)
    open_t, open_m = np.zeros(0), np.zeros((0, sums.width))
    for pdf in batches:
        for i in range(0, len(pdf), step):
            part = pdf.iloc[i : i + step]
            t = part["__t"].to_numpy(float)
            m = sums.of_rows(part["__n"].to_numpy(float), part["__e"].to_numpy(float), part[zcols].to_numpy(float), beta)
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            t, m = t[starts], np.add.reduceat(m, starts, axis=0)
            if len(open_t) and open_t[0] == t[0]:
                m[0] += open_m[0]
            elif len(open_t):
                t, m = np.concatenate([open_t, t]), np.vstack([open_m, m])
            if len(t) > 1:
                yield t[:-1], m[:-1]
            open_t, open_m = t[-1:], m[-1:]
    if len(open_t):
        yield open_t, open_m


@dataclass
class Risk:
    """What the blocks start from at one beta, and the times that stand in several blocks, complete."""

    beta: np.ndarray
    before: dict[int, np.ndarray]
    times: np.ndarray
    risk: np.ndarray
    own: np.ndarray


class TimeOrder:
    """Rows (duration, event, covariates) in blocks of descending duration."""

    def __init__(self, rows: DataFrame, duration: str, event: str, zcols: Sequence[str], rows_per_block: int = 50_000):
        self.zcols = list(zcols)
        self.sums = Sums(len(self.zcols))
        named = rows.select(F.col(duration).cast("double").alias("__t"), F.col(event).cast("double").alias("__e"), *self.zcols)
        counted = named.groupBy("__t", "__e", *self.zcols).agg(F.count(F.lit(1)).alias("__n")).checkpoint(eager=True)
        max_blocks = max(64, DRIVER_NUMBERS // (4 * self.sums.width))
        n = min(max_blocks, max(1, math.ceil(counted.count() / rows_per_block)))
        salted = counted.withColumn("__salt", F.xxhash64("__e", *self.zcols))
        dealt = salted.repartitionByRange(n, F.col("__t").desc(), F.col("__salt")) if n > 1 else salted.coalesce(1)
        self.rows = dealt.sortWithinPartitions(F.col("__t").desc(), "__salt").drop("__salt").checkpoint(eager=True)

    def risk(self, beta: np.ndarray) -> Risk:
        zcols, width, b = self.zcols, self.sums.width, np.asarray(beta, float).copy()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, first, last = np.zeros(width), None, None
            for t, m in _times(batches, zcols, b):
                total += m.sum(axis=0)
                first = first or (t[0], m[0].copy())
                last = (t[-1], m[-1].copy())
            if first:
                yield pd.DataFrame(
                    {"part": [TaskContext.get().partitionId()], "first_t": [first[0]], "last_t": [last[0]], "first": [first[1].tobytes()], "last": [last[1].tobytes()], "total": [total.tobytes()]}
                )

        found = self.rows.mapInPandas(run, "part int, first_t double, last_t double, first binary, last binary, total binary").collect()  # a row for each block
        parts = sorted(found, key=lambda r: r["part"])
        vector = lambda v: np.frombuffer(v)
        before, so_far = {}, np.zeros(width)
        joined: dict[float, list[np.ndarray]] = {}
        for k, r in enumerate(parts):
            before[r["part"]] = so_far
            so_far = so_far + vector(r["total"])
            if k and parts[k - 1]["last_t"] == r["first_t"]:
                t, own = r["first_t"], vector(r["first"])
                if t in joined:
                    joined[t][1] = joined[t][1] + own
                    joined[t][0] = joined[t][0] + own
                else:
                    # the block before ends with this time
                    joined[t] = [before[r["part"]] + own, vector(parts[k - 1]["last"]) + own]
        times = np.array(list(joined))
        risk, own = (np.array([joined[t][i] for t in joined]).reshape(len(joined), width) for i in (0, 1))
        return Risk(b, before, times, risk, own)

    def terms(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, Risk]:
        """Log partial likelihood, gradient, Hessian, and (units, events) at ``beta``."""
        zcols, p = self.zcols, self.sums.p
        at = self.risk(beta)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ll, grad, hess, n = 0.0, np.zeros(p), np.zeros((p, p)), np.zeros(2)
            risk = at.before.get(TaskContext.get().partitionId())
            for t, m in _times(batches, zcols, at.beta):
                sets = risk + np.cumsum(m, axis=0)
                risk = sets[-1]
                n += m[:, [0, 3]].sum(axis=0)
                inside = ~np.isin(t, at.times)
                a, g, h, _ = efron(p, sets[inside], m[inside])
                ll, grad, hess = ll + a, grad + g, hess + h
            yield pd.DataFrame({"ll": [ll], "grad": [grad.tobytes()], "hess": [hess.tobytes()], "n": [n.tobytes()]})

        rows = self.rows.mapInPandas(run, "ll double, grad binary, hess binary, n binary").collect()  # a row for each block
        ll, grad, hess, _ = efron(p, at.risk, at.own)
        ll += math.fsum(r["ll"] for r in rows)
        grad = grad + sum(np.frombuffer(r["grad"]) for r in rows)
        hess = hess + sum(np.frombuffer(r["hess"]).reshape(p, p) for r in rows)
        return ll, grad, hess, sum((np.frombuffer(r["n"]) for r in rows), np.zeros(2)), at

    def event_times(self, at: Risk, units: float) -> DataFrame:
        """(__t, d, time_rank, mean_j...) of every time with an event: average rank of the duration among all units, Efron weighted means."""
        zcols, p = self.zcols, self.sums.p
        names = ["__t", "d", "time_rank", *[f"mean_{j}" for j in range(p)]]

        def table(t: np.ndarray, risk: np.ndarray, own: np.ndarray) -> pd.DataFrame:
            has = own[:, 3] > 0
            t, risk, own = t[has], risk[has], own[has]
            # units with a shorter life come before, those with the same one share their ranks
            rank = units - risk[:, 0] + (own[:, 0] + 1) / 2
            return pd.DataFrame(np.column_stack([t, own[:, 3], rank, efron(p, risk, own)[3]]), columns=names)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            risk = at.before.get(TaskContext.get().partitionId())
            for t, m in _times(batches, zcols, at.beta):
                sets = risk + np.cumsum(m, axis=0)
                risk = sets[-1]
                inside = ~np.isin(t, at.times)
                yield table(t[inside], sets[inside], m[inside])

        schema = ", ".join(f"{n} double" for n in names)
        found = self.rows.mapInPandas(run, schema)
        joined = table(at.times, at.risk, at.own)  # less than one time for each block
        return found.unionByName(self.rows.sparkSession.createDataFrame(joined.values.tolist(), schema)) if len(joined) else found
