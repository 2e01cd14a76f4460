"""Greedy nearest-neighbour matching along a score line, in chunks of bounded size.

Treated units come in ascending (score, id) order and each takes the nearest
free control. Seen from the walk along the line, the free controls behind form
a stack (the nearest on top; of equal scores the lowest id first), and those
ahead a queue whose front has been taken up to one pointer. So a chunk with m
treated units depends on what came before only through that pointer and the m
uppermost entries of the stack, and it takes at most m controls beyond its own
end: whatever the scores, and also if a third of all units share one, no chunk
needs more than its own rows and 2 m more.

An input that a chunk missed is felt about one caliper further on, so the
rounds below are as many as there are chunks within a caliper, or more. Chunks
are therefore widened with the table (``chunk_rows``): up to ``WIDEST`` rows
each, a table has about ``CHUNKS`` of them whatever its size.

Chunks run in parallel on assumed inputs. The driver then replays the line on
counts (entries taken from the stack, controls taken beyond the end, entries
left), gives each chunk the ranges that it should have seen, and those whose
inputs differ from what they saw run again, until none does. After r rounds at
least the first r chunks are final, which makes the result that of the plain
loop. Units of different strata never meet: small strata are chunks of their
own, many to a chunk; large ones are lines of several chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Control = tuple[float, object]  # score, id

CHUNKS = 32
WIDEST = 100_000


def chunk_rows(units: int, least: int) -> int:
    """Rows of a chunk for a table of ``units``: ``least`` or, for about ``CHUNKS`` chunks, more, but then no more than ``WIDEST``."""
    return max(least, min(WIDEST, math.ceil(units / CHUNKS)))


def walk(treated: list[Control], own: list[Control], used: int, left: list[Control], right: list[Control], caliper: float) -> tuple[list[tuple], int, int, list[Control]]:
    """Match ``treated`` (ascending) with their own controls (ascending, the first ``used`` taken), the stack ``left`` (top first)
    and the queue ``right`` beyond the own ones.

    Returns pairs (treated id, control id, distance), entries taken from ``left``,
    controls taken from ``right``, and the own controls left, in stack order.
    """
    stack = [(x, c, False) for x, c in reversed(left)]
    queue = own + right
    front, passed, from_left, pairs = used, 0, 0, []

    def pass_until(score: float) -> None:
        """Controls below ``score`` that are free go on the stack, the lowest id of a score uppermost."""
        nonlocal passed, front
        first = max(passed, front)
        while passed < len(own) and own[passed][0] < score:
            passed += 1
        k = passed
        runs = []
        while k > first:
            start = k - 1
            while start > first and own[start - 1][0] == own[k - 1][0]:
                start -= 1
            runs.append((start, k))
            k = start
        for start, end in reversed(runs):
            stack.extend((x, c, True) for x, c in reversed(own[start:end]))
        front = max(front, passed)

    for s, t in treated:
        pass_until(s)
        behind = s - stack[-1][0] if stack else math.inf
        ahead = queue[front][0] - s if front < len(queue) else math.inf
        if min(behind, ahead) > caliper:
            continue
        if behind < ahead or (behind == ahead and stack[-1][1] < queue[front][1]):
            _, c, is_own = stack.pop()
            from_left += not is_own
            pairs.append((t, c, behind))
        elif ahead < math.inf:
            pairs.append((t, queue[front][1], ahead))
            front += 1
    pass_until(math.inf)
    return pairs, from_left, max(0, front - len(own)), [(x, c) for x, c, is_own in reversed(stack) if is_own]


def _positions(units: DataFrame, n_units: int, size: int) -> DataFrame:
    """Add ``pos``, the place in (stratum, score, treated first, id) order: a distributed sort and one count per partition."""
    order = ["stratum", "x", "kind", "uid"]
    n = max(1, math.ceil(n_units / (4 * size)))
    dealt = units.repartitionByRange(n, *order) if n > 1 else units.coalesce(1)
    dealt = dealt.sortWithinPartitions(*order).checkpoint(eager=True)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [sum(len(b) for b in batches)]})

    sizes = {r["part"]: r["n"] for r in dealt.select("kind").mapInPandas(count, "part int, n long").collect()}  # a row for each partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]

    # the id's low 33 bits count the rows of a partition, the others are its number
    first = dealt.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    numbered = dealt.withColumn("mono", F.monotonically_increasing_id())
    numbered = numbered.withColumn("part", F.shiftright("mono", 33).cast("int")).withColumn("at", F.col("mono").bitwiseAND((1 << 33) - 1))
    return numbered.join(F.broadcast(first), "part").withColumn("pos", F.col("before") + F.col("at")).drop("part", "before", "at", "mono")


def chunked(units: DataFrame, rows_per_chunk: int) -> DataFrame:
    """(stratum, uid, kind, x, chunk, pos): kind 0 treated, 1 control; at most about 3 times ``chunk_rows`` rows in a chunk.

    A line is cut at multiples of that size; controls of one score stay
    together unless they are more than that, when they are cut among themselves.
    """
    units = units.checkpoint(eager=True)
    n_units = units.count()
    size = chunk_rows(n_units, rows_per_chunk)
    placed = _positions(units, n_units, size).checkpoint(eager=True)
    runs = placed.groupBy("stratum", "x").agg(F.min(F.when(F.col("kind") == 1, F.col("pos"))).alias("c0"), F.count_if(F.col("kind") == 1).alias("n_run"))
    strata = placed.groupBy("stratum").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n_stratum"))
    bins = max(1, math.ceil(n_units / size))
    rows = placed.join(runs, ["stratum", "x"]).join(strata, "stratum")
    place = F.when((F.col("kind") == 1) & (F.col("n_run") <= size), F.col("c0")).otherwise(F.col("pos"))
    regular = (F.col("start") + F.floor((place - F.col("start")) / size) * size) * 2
    crowded = (F.col("c0") + F.floor((F.col("pos") - F.col("c0")) / size) * size) * 2 + 1
    line = F.when((F.col("kind") == 1) & (F.col("n_run") > size), crowded).otherwise(regular)
    chunk = F.when(F.col("n_stratum") <= size, -1 - F.pmod(F.xxhash64("stratum"), F.lit(bins))).otherwise(line)
    return rows.select("stratum", "uid", "kind", "x", chunk.cast("long").alias("chunk"), "pos").checkpoint(eager=True)


class _Line:
    """The chunks of all lines in order, and the replay of the walk on counts."""

    def __init__(self, table: list, caliper: float):
        self.chunks = [r["chunk"] for r in table]
        self.n_treated = {r["chunk"]: r["n_t"] for r in table}
        self.n_own = {r["chunk"]: r["n_c"] for r in table}
        self.stratum = {r["chunk"]: r["line"] for r in table}
        self.first_treated = {r["chunk"]: r["t_lo"] for r in table}
        self.last_control = {r["chunk"]: r["c_hi"] for r in table}
        self.crowd = {r["chunk"]: r["c_hi"] if r["chunk"] >= 0 and r["chunk"] % 2 else None for r in table}
        self.caliper = caliper
        #: Last outputs: entries taken from the stack, controls taken beyond the end, entries left, their version.
        self.out = {c: (0, 0, self.n_own[c], 0) for c in self.chunks}

    def inputs(self) -> dict[int, tuple]:
        """What each chunk should see: own controls taken, ranges (chunk, from, to, version) of the stack, ranges (chunk, from, to) beyond its end."""
        wanted: dict[int, tuple] = {}
        stack: list[list] = []  # chunk, entries taken, entries left
        line, ahead = None, 0  # controls beyond the last chunk that are taken
        group: list[list] = []  # chunks of one crowded score: the first of them is uppermost
        crowd = None
        for k, c in enumerate(self.chunks):
            if c < 0 or self.stratum[c] != line:
                line, ahead, stack, group, crowd = self.stratum[c], 0, [], [], None
            if group and self.crowd[c] != crowd:
                stack += reversed(group)
                group = []
            used, m = min(ahead, self.n_own[c]), self.n_treated[c]
            left, right = [], []
            if m and c >= 0:
                least = self.first_treated[c] - self.caliper
                least -= 1e-9 * (abs(least) + 1)  # never by rounding alone
                stack = [s for s in stack if self.last_control[s[0]] >= least]
                need = m
                for of, taken, n in reversed(stack):
                    if need <= 0:
                        break
                    take = min(need, n)
                    left.append((of, taken, taken + take, self.out[of][3]))
                    need -= take
                need, skip = m, max(0, ahead - self.n_own[c])
                for j in range(k + 1, len(self.chunks)):
                    of = self.chunks[j]
                    if need <= 0 or self.stratum[of] != line:
                        break
                    take = min(need, self.n_own[of] - skip)
                    if take > 0:
                        right.append((of, skip, skip + take))
                        need -= take
                    skip = max(0, skip - self.n_own[of])
            wanted[c] = (used, tuple(left), tuple(right))
            popped, beyond, rest, _ = self.out[c]
            while popped > 0 and stack:
                take = min(popped, stack[-1][2])
                stack[-1][1] += take
                stack[-1][2] -= take
                popped -= take
                if not stack[-1][2]:
                    stack.pop()
            ahead = max(0, ahead - self.n_own[c]) + beyond
            if rest and c >= 0:
                entry = [c, 0, rest]
                if self.crowd[c] is not None:
                    group.append(entry)
                    crowd = self.crowd[c]
                else:
                    stack.append(entry)
        return wanted


def match_line(units: DataFrame, caliper: float, rows_per_chunk: int) -> DataFrame:
    """(chunk, seq, treated_id, control_id, distance) and the chunks' order, for units (stratum, uid, kind, x)."""
    from ..session import scratch_path

    spark = units.sparkSession
    rows = chunked(units, rows_per_chunk)
    kind_of_id = rows.schema["uid"].dataType.simpleString()
    t, c = F.col("kind") == 0, F.col("kind") == 1
    table = rows.groupBy("chunk").agg(
        F.count_if(t).alias("n_t"), F.count_if(c).alias("n_c"), F.min("stratum").alias("line"), F.min(F.when(t, F.col("x"))).alias("t_lo"),
        F.max(F.when(c, F.col("x"))).alias("c_hi"), F.min("pos").alias("first"),
    )
    table = sorted(table.collect(), key=lambda r: (r["chunk"] < 0, r["first"]))  # a row for each chunk
    line = _Line(table, caliper)
    by_queue = Window.partitionBy("chunk").orderBy("x", "uid")
    by_stack = Window.partitionBy("chunk").orderBy(F.desc("x"), "uid")
    # in a chunk of bounded size; packed strata have no neighbours
    controls = rows.filter(c & (F.col("chunk") >= 0)).withColumn("queue_at", F.row_number().over(by_queue) - 1).withColumn("stack_at", F.row_number().over(by_stack) - 1)
    controls = controls.select(F.col("chunk").alias("of"), "uid", "x", "queue_at", "stack_at").checkpoint(eager=True)
    base = scratch_path(spark, "matching")
    schema = f"chunk long, what string, seq long, uid {kind_of_id}, control_id {kind_of_id}, x double, popped long, beyond long, hash long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, kind = int(pdf["chunk"].iloc[0]), pdf["uid"].dtype
        popped = beyond = rest_hash = 0
        pairs, rest = [], []
        for _, part in pdf.sort_values("stratum", kind="stable").groupby("stratum", sort=False):
            side = {k: g for k, g in part.groupby("kind")}

            def listed(k: int, by: list[str], side=side) -> list[Control]:
                rows = side[k].sort_values(by) if k in side else part.iloc[:0]  # noqa: B023
                return list(zip(rows["x"].tolist(), rows["uid"].tolist(), strict=True))

            found, p, b, rest = walk(listed(0, ["x", "uid"]), listed(1, ["x", "uid"]), int(part["used"].iloc[0]), listed(2, ["seq"]), listed(3, ["seq"]), caliper)
            popped, beyond = popped + p, beyond + b
            pairs += found

        def table(what: str, uid: list, control: list, x: list, **numbers: int) -> pd.DataFrame:
            ids = {"uid": pd.Series(uid, dtype=kind), "control_id": pd.Series(control, dtype=kind)}
            made = pd.DataFrame({"chunk": chunk, "what": what, "seq": np.arange(len(uid)), **ids, "x": np.array(x, float), "popped": 0, "beyond": 0, "hash": 0})
            return made.assign(**numbers)

        any_id = pdf["uid"].iloc[:1].tolist()
        out = []
        if pairs:
            treated, control, distance = zip(*pairs, strict=True)
            out.append(table("pair", treated, control, distance))
        if chunk >= 0 and rest:  # a chunk of a line has one stratum
            x, ids = zip(*rest, strict=True)
            out.append(table("left", ids, ids, x))
            hashes = pd.util.hash_array(np.array([str(u) for u in ids], dtype=object))
            rest_hash = int((hashes * np.arange(1, 2 * len(rest), 2, dtype="u8")).sum() >> np.uint64(1))
        out.append(table("end", any_id, any_id, [0.0], seq=len(pairs), popped=popped, beyond=beyond, hash=rest_hash))
        return pd.concat(out, ignore_index=True)

    seen: dict[int, tuple] = {}
    done: dict[int, int] = {}
    number = 0
    while True:
        wanted = line.inputs()
        todo = [k for k in line.chunks if seen.get(k) != wanted[k]]
        if not todo:
            break
        chosen = spark.createDataFrame([(k, wanted[k][0]) for k in todo], "chunk long, used long")
        inputs = rows.join(chosen, "chunk").select("chunk", "stratum", "kind", "x", "uid", F.lit(0).cast("long").alias("seq"), "used")
        for side, name in ((2, "stack_at"), (3, "queue_at")):
            needs, stratum = [], {}
            for k in todo:
                at = 0
                for of, lo, hi, *version in wanted[k][side - 1]:
                    needs.append((k, of, lo, hi, at, line.stratum[k], wanted[k][0], done.get(of, -1) if version else -1))
                    at += hi - lo
            if not needs:
                continue
            asked = spark.createDataFrame(needs, "chunk long, of long, lo long, hi long, first long, stratum string, used long, round int")
            source = controls.select("of", "uid", "x", F.col(name).alias("at"), F.lit(-1).alias("round"))
            if side == 2 and done:
                left = spark.read.schema(schema + ", round int").parquet(base).filter("what = 'left'")
                source = source.unionByName(left.select(F.col("chunk").alias("of"), "uid", "x", F.col("seq").alias("at"), "round"))
            got = source.join(asked, ["of", "round"]).filter("at >= lo AND at < hi")
            got = got.select("chunk", "stratum", F.lit(side).alias("kind"), "x", "uid", (F.col("first") + F.col("at") - F.col("lo")).alias("seq"), "used")
            inputs = inputs.unionByName(got)
        inputs.groupBy("chunk").applyInPandas(run, schema).write.parquet(f"{base}/round={number}")
        ends = spark.read.schema(schema).parquet(f"{base}/round={number}").filter("what = 'end'").select("chunk", "seq", "popped", "beyond", "hash")
        sizes = spark.read.schema(schema).parquet(f"{base}/round={number}").filter("what = 'left'").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
        for r in ends.join(sizes, "chunk", "left").collect():  # a row for each chunk that ran
            line.out[r["chunk"]] = (r["popped"], r["beyond"], r["n"] or 0, r["hash"])
            done[r["chunk"]], seen[r["chunk"]] = number, wanted[r["chunk"]]
        number += 1
    if not done:
        return spark.createDataFrame([], f"match_id long, treated_id {kind_of_id}, control_id {kind_of_id}, distance double")
    latest = spark.createDataFrame(list(done.items()), "chunk long, round int")
    pairs = spark.read.schema(schema + ", round int").parquet(base).filter("what = 'pair'").join(latest, ["chunk", "round"])
    counts = {r["chunk"]: r["n"] for r in pairs.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each chunk
    offsets, total = [], 0
    for k in line.chunks:
        offsets.append((k, total))
        total += counts.get(k, 0)
    pairs = pairs.join(spark.createDataFrame(offsets, "chunk long, first long"), "chunk")
    return pairs.select((F.col("first") + F.col("seq")).alias("match_id"), F.col("uid").alias("treated_id"), "control_id", F.col("x").alias("distance"))


def strata(exact_on: Sequence[str]):
    """One string per stratum; null is a value like any other."""
    return F.to_json(F.struct(*exact_on)) if exact_on else F.lit("")
