"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents are tokenised, ended with one id and cut into pieces of at most
``capacity`` ids. Only the histogram of piece lengths (at most ``capacity``
rows) reaches the driver. There lengths are placed longest first, each into
the shortest open pack that takes it, as counts of packing patterns. Patterns
are joined back to the pieces by their rank among pieces of equal length.

Defined results: a null or empty text is one piece with the end id; repeated
rows are packed each; a null id is carried as it is; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortkit.llm.common import stage

CAPACITY = 2048
END_ID = 1
#: Pieces of one length are ranked in so many parts.
PARTS = 256
#: The chunk cache of a worker is emptied at this many entries (about 100 MB).
CACHE = 400_000
#: White space as the tokenizer's pattern means it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The tokenizer never joins across these cuts, so ids of a text are the ids of its chunks in turn.
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBPE:
    """Ids of whole texts under the vocabulary of a byte-level BPE json file.

    The vocabulary's ids are its merge ranks, which tiktoken runs. A text is
    first cut at the file's added tokens, which have ids of their own wherever
    they stand, as in ``tokenizers``. Chunks repeat a lot, so their ids are
    remembered in a bounded cache.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip or need borders are not supported")
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids."""
        if any(token in text for token in self.added):
            parts = self.at_added.split(text)  # texts and tokens in turn
            return np.concatenate([np.array([self.added[p]], "<u4") if k % 2 else self._plain(p) for k, p in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        chunks, known = _CHUNK.findall(text), self.known
        try:
            return np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        for c in chunks:
            if c not in known:
                known[c] = array("I", self.encode(c)).tobytes()
        return np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and the ids themselves)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end = _tokenizer(vocabulary), np.array([end_id], "<u4")
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([bpe.ids(text), end])
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((doc, start, len(part), zlib.crc32(part), len(ids), *([part.astype("int32")] if with_ids else [])))
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns with their counts, from the counts of lengths.

    Longest lengths first; each goes to the open packs with the most space
    left, or opens packs where none takes it. Packs of one content are one
    counted pattern, so the work follows the number of lengths, not of pieces.
    """
    open_by_space: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max(open_by_space, default=0)
            if space >= length:
                count, pattern = open_by_space[space].pop()
                if count > left:
                    open_by_space[space].append((count - left, pattern))
                if not open_by_space[space]:
                    del open_by_space[space]
                # a pack takes as many of this length as keep it the shortest open one
                take = min(count, left)
            else:
                take, pattern, space = left, (), capacity
            left -= take
            grown = (*pattern, length)
            if space == length:
                done.append((take, grown))
            else:
                open_by_space.setdefault(space - length, []).append((take, grown))
    return done + [x for packs in open_by_space.values() for x in packs]


def _segments(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks (ascending), first sequence ids and offsets of its runs of packs."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            found.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, "int64") for x in zip(*runs, strict=True)) for length, runs in found.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (columns of ``pieces``) its sequence_id and offset."""
    spark = cut.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int")
    rows = stage(cut.withColumn("_part", part), "pieces")
    cells = stage(rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "piece-cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(_segments(shortest_pack_first(histogram, capacity)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    rank = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = (
        rows.withColumn("_rank", rank)
        .join(cells.select("length", "_part", before.alias("_before")), ["length", "_part"])
        .withColumn("_rank", (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .select(*cut.columns, "_rank")
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), "int64"), np.zeros(len(batch), "int64")
            ranks = batch["_rank"].to_numpy()
            for length, at in batch.groupby("length").indices.items():
                first, sequences, offsets = runs.value[int(length)]
                k = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at], offset[at] = sequences[k] + ranks[at] - first[k], offsets[k]
            yield batch.drop(columns="_rank").assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInPandas(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents. ``with_ids`` adds each piece's ids."""
    return pack(pieces(docs, vocabulary or default_vocabulary(), capacity, with_ids=with_ids, id_col=id_col, text_col=text_col), capacity)
