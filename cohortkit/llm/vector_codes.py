"""Vector code compression: codebooks per part, searched exactly with an integer Walsh-Hadamard transform.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook. The nearest entry of a part is found on transformed
values: parts and entries are padded with zeros to a power of two and
transformed without division, so squared distances grow by exactly that power.
Coefficients come in sequency order; the squared differences of the first few
give each part a first guess, whose whole distance bounds the search, and an
entry goes as soon as its partial sum exceeds the bound. Sums are 64-bit
integers, or Python integers where a batch holds values too large for that.
There is no floating point after the components are made.

Each round sends the codebooks (parts x entries x width integers) to the tasks
and adds their sums per entry; only those sums come back.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped, as are those beyond ``LARGEST``, whose distances fit
nowhere; vectors of other lengths are padded with zeros to the longest one, and
that to a multiple of the number of parts; an empty vector is all zeros. Rows
with a null id are coded but start no codebook; repeated rows are coded each,
and of the rows that share an id the least vector may start a codebook. An
error that exceeds 64 bits is null. Fewer ids than entries make smaller
codebooks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortkit.llm.common import join_small, stage

#: Largest component, vectors searched at once, coefficients added between two eliminations.
LARGEST, AT_ONCE, STEP = 2.0**50, 1024, 4


def transform(values: np.ndarray) -> np.ndarray:
    """Rows, padded with zeros to a power of two, under the integer Walsh-Hadamard transform in sequency order."""
    size = 1 << (values.shape[1] - 1).bit_length()
    x = np.zeros((len(values), size), values.dtype)
    x[:, : values.shape[1]] = values
    return _butterflies(x)[:, sequency_order(size)]


def _butterflies(x: np.ndarray) -> np.ndarray:
    half = 1
    while half < x.shape[1]:
        pair = x.reshape(len(x), -1, 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(x.shape)
        half *= 2
    return x


def sequency_order(size: int) -> np.ndarray:
    """Places of the transform's rows by their number of sign changes."""
    rows = _butterflies(np.eye(size, dtype="i8"))
    return np.argsort((np.diff(rows, axis=0) != 0).sum(axis=0))


def fits(largest: int, width: int) -> bool:
    """Whether scaled squared distances of such values stay below 2 ** 63."""
    size = 1 << (width - 1).bit_length()
    return 4 * size * size * largest * largest < 2**63


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index of the nearest entry of each row, and its squared distance."""
    if values.dtype != object and not fits(max(int(np.abs(values).max(initial=0)), int(np.abs(entries).max(initial=0))), values.shape[1]):
        values, entries = values.astype(object), entries.astype(object)
    a, b = transform(values), transform(entries)
    size, first = a.shape[1], min(STEP, a.shape[1])
    seen = np.zeros((len(a), len(b)), a.dtype)
    for c in range(first):
        gap = a[:, c, None] - b[None, :, c]
        seen += gap * gap
    gap = a - b[seen.argmin(axis=1)]
    bound = (gap * gap).sum(axis=1)
    row, entry = np.nonzero(seen <= bound[:, None])
    seen = seen[row, entry]
    for c in range(first, size, STEP):
        gap = a[row, c : c + STEP] - b[entry, c : c + STEP]
        seen = seen + (gap * gap).sum(axis=1)
        stays = np.flatnonzero(seen <= bound[row])
        row, entry, seen = row[stays], entry[stays], seen[stays]
    # a row's entries are in ascending order, and its guess always stays
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(seen, starts) if len(starts) else seen
    best = np.flatnonzero(seen == np.repeat(least, np.diff(starts, append=len(row))))
    best = best[np.diff(row[best], prepend=-1) > 0]
    return entry[best], seen[best] // size


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(id, label, v) of the kept rows, staged, with the width of a part."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST / scale)))
    rows = rows.filter(good).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
    rows = stage(rows, "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, math.ceil(longest / parts))
    return rows, width


def _values(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), "i8")
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _entry_sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, place, total) of a task; place -1 has the number of parts."""
    sums = [np.zeros((len(b), width + 1), object) for b in books]
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            x = _values(batch.column(0).slice(i, AT_ONCE), width * len(books))
            for p, book in enumerate(books):
                own = x[:, p * width : (p + 1) * width]
                chosen, _ = nearest(own, book)
                order = np.argsort(chosen, kind="stable")
                starts = np.flatnonzero(np.diff(chosen[order], prepend=-1))
                at = chosen[order][starts]
                # of at most ``AT_ONCE`` integers below 2 ** 51
                sums[p][at, 1:] += np.add.reduceat(own[order], starts, axis=0)
                sums[p][at, 0] += np.diff(starts, append=len(order))
    for p, s in enumerate(sums):
        entry = np.flatnonzero(s[:, 0] > 0)
        n = len(entry)
        out = [np.full(n * (width + 1), p), np.repeat(entry, width + 1), np.tile(np.arange(-1, width), n), [str(t) for t in s[entry].ravel()]]
        yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int32()) for k in range(3)] + [pa.array(out[3], pa.string())], names=["part", "entry", "place", "total"])


def first_codebooks(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """Parts of the vectors of the ``entries`` smallest ids."""
    ids = rows.filter(F.col("id").isNotNull()).select("id").distinct().orderBy("id").limit(entries)
    chosen = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()  # ``entries`` rows
    x = np.zeros((len(chosen), width * parts), "i8")
    for k, r in enumerate(chosen):
        x[k, : len(r["v"])] = r["v"]
    return [np.ascontiguousarray(x[:, p * width : (p + 1) * width]) for p in range(parts)]


def refined(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of the parts nearest to them; an unused entry stays."""
    found = rows.select("v").mapInArrow(lambda batches: _entry_sums(batches, books, width), "part int, entry int, place int, total string")
    found = found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.copy() for b in books]
    counts, totals = {}, []
    for r in found.collect():  # parts x entries x (width + 1) rows
        if r["place"] < 0:
            counts[r["part"], r["entry"]] = int(r["total"])
        else:
            totals.append(r)
    for r in totals:
        out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // counts[r["part"], r["entry"]]
    return out


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, codes, error) of every kept row, and the final codebooks (entries x width) by part."""
    rows, width = integers(vectors, id_col, vector_col, label_col, scale, parts)
    books = first_codebooks(rows, width, parts, entries)
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not len(books[0]):  # no id to start from
        return rows.filter("false").select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), books
    for _ in range(rounds):
        books = refined(rows, books, width)
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, parts), "i4"), np.zeros(batch.num_rows, object)
            for i in range(0, batch.num_rows, AT_ONCE):
                x = _values(batch.column(2).slice(i, AT_ONCE), width * parts)
                for p, book in enumerate(books):
                    codes[i : i + AT_ONCE, p], far = nearest(x[:, p * width : (p + 1) * width], book)
                    errors[i : i + AT_ONCE] += far
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * parts, pa.int32()), pa.array(codes.ravel(), pa.int32()))
            known = pa.array([int(e) if e < 2**63 else None for e in errors], pa.int64())
            columns = [batch.column(0), batch.column(1), listed, known]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select("id", "label", "v").mapInArrow(encode, schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over the rows of an equal label (null like any other); null beyond 64 bits."""
    coded = stage(coded, "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.count(F.lit(1)) == F.count("error")
    sums = coded.groupBy("label").agg(F.when(whole, total.try_cast("long")).alias("label_error"))
    return join_small(coded, sums, ["label"], F.xxhash64("id"))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
