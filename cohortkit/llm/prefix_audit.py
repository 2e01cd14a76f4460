"""Source divergence audit over the terms of iceberg prefix refinement.

Terms that few documents of a language hold say nothing of its sources, and
most distinct terms are such. They are found without counting them all: byte
prefixes are counted in documents, level by level, each twice as long as the
one before; a prefix below the threshold goes with all its terms, as none of
them can reach it; a term that is no longer than the level counts as complete.
The search ends when no open prefix is left.

Texts are read once. Blocks of texts of one language (up to ``BLOCK``
characters, or one longer text) hold their distinct terms in byte order with
the documents and numbers of each, so a prefix is a run of terms and its
documents are counted inside the block; blocks add up. Every level writes the
blocks that are left, with the terms that are left.

Each (language, source) group then has a share of each kept term. Sources are
compared by the absolute differences summed over all kept terms, in blocks of
terms by tiles of sources, so no group and no pair of sources is held whole.

Defined results: null text, language and source are read as ''; groups without
terms and languages without kept terms have their pairs too (value 0 without
kept terms); repeated rows are documents each; an empty table gives no rows;
other columns, the id among them, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from cohortkit.llm.common import join_small, stage

#: Characters of text in a block, bytes of the first prefixes.
BLOCK, FIRST = 16_000_000, 4
#: Terms of a block and sources of a tile in the comparison of sources, about.
TERMS, SOURCES = 512, 256
#: Ends the key of a complete term; no term holds it.
_END = b"\0"
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_IN_TERM = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])

_BLOCKS = "block long, lang string, sources array<string>, held binary, keys array<binary>, key_docs array<long>"


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower case) and of characters beyond ASCII."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts (UTF-8) in order, and the number of the text of each; the same terms as ``terms_of``, found by byte masks."""
    whole = np.frombuffer(b"".join([*(t + _END for t in texts), _END]).lower(), "u1")
    inside = _IN_TERM[whole]
    edges = np.diff(inside.view("i1"), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, "i4")
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole[inside])])
    return words, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


class TermBlock:
    """Texts of one language: distinct terms in byte order, the documents and numbers of each, the source of each document."""

    _ARRAYS = {"doc_source": "u4", "sizes": "u4", "docs": "u4", "times": "u4", "settled": "u1", "key_of": "i4"}

    def __init__(self, terms: pa.Array, **arrays: np.ndarray):
        self.terms = terms
        self.doc_source, self.sizes, self.docs, self.times = (arrays[k] for k in ("doc_source", "sizes", "docs", "times"))
        self.settled, self.key_of = arrays["settled"].astype(bool), arrays["key_of"]

    def keys(self, length: int) -> tuple[pa.Array, np.ndarray]:
        """Prefixes of ``length`` bytes of the terms not settled, and the number of documents that hold each."""
        at = np.flatnonzero(~self.settled)
        terms = self.terms.take(pa.array(at))
        longer = pc.greater(pc.binary_length(terms), length)
        keys = pc.if_else(longer, pc.binary_slice(terms, 0, length), pc.binary_join_element_wise(terms, pa.scalar(_END, pa.binary()), pa.scalar(b"", pa.binary())))
        # terms are in byte order, so equal keys are neighbours
        fresh = np.ones(len(at), bool)
        if len(at) > 1:
            fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(at) - 1)).to_numpy(zero_copy_only=False)
        self.key_of = np.full(len(self.terms), -1, "i4")
        self.key_of[at] = np.cumsum(fresh) - 1
        number = np.repeat(self.key_of, self.sizes)
        held = number.astype("i8") << 32 | self.docs
        held = held[number >= 0]
        # a term of its own has distinct documents
        alone = np.bincount(self.key_of[at], minlength=1)[held >> 32] == 1 if len(held) else np.zeros(0, bool)
        held = np.concatenate([held[alone], np.unique(held[~alone])])
        return keys.filter(pa.array(fresh)), np.bincount(held >> 32, minlength=int(fresh.sum()))

    def keep(self, alive: np.ndarray, complete: np.ndarray) -> None:
        """Leave only the terms that are settled or whose key is in ``alive``; the complete ones become settled."""
        stays = self.settled | np.isin(self.key_of, alive)
        of_posting = np.repeat(stays, self.sizes)
        self.settled = (self.settled | np.append(complete, True)[self.key_of])[stays]
        self.terms = self.terms.filter(pa.array(stays))
        self.sizes, self.key_of = self.sizes[stays], self.key_of[stays]
        self.docs, self.times = self.docs[of_posting], self.times[of_posting]

    def packed(self) -> bytes:
        """All but the keys, as differences and byte planes, compressed."""
        arrays = [np.diff(self.docs.astype("u4"), prepend=np.uint32(0)) if k == "docs" else getattr(self, k) for k in self._ARRAYS]
        planes = [a.astype(kind).view("u1").reshape(len(a), np.dtype(kind).itemsize).T.tobytes() for a, kind in zip(arrays, self._ARRAYS.values(), strict=True)]
        terms = _END.join(self.terms.to_pylist())
        head = np.array([len(self.terms), len(terms), *(len(p) for p in planes)], "<i8").tobytes()
        whole = b"".join([head, terms, *planes])
        return np.array([len(whole)], "<i8").tobytes() + pa.compress(whole, "zstd", asbytes=True)

    @classmethod
    def unpacked(cls, blob: bytes) -> TermBlock:
        whole = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], "<i8")[0]), "zstd", asbytes=True)
        at = 8 * (2 + len(cls._ARRAYS))
        n, size, *sizes = np.frombuffer(whole[:at], "<i8").tolist()
        terms = pa.array(whole[at : at + size].split(_END) if n else [], pa.binary())
        at, arrays = at + size, {}
        for (name, kind), size in zip(cls._ARRAYS.items(), sizes, strict=True):
            width = np.dtype(kind).itemsize
            arrays[name] = np.frombuffer(whole[at : at + size], "u1").reshape(width, size // width).T.copy().view(kind).ravel()
            at += size
        arrays["docs"] = np.cumsum(arrays["docs"], dtype="u4")
        return cls(terms, **arrays)


def _row(number: int, lang: str, sources: list[str], block: TermBlock, length: int, schema: pa.Schema) -> pa.RecordBatch:
    keys, docs = block.keys(length)
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = [pa.array([number]), pa.array([lang], pa.string()), listed(pa.array(sources, pa.string())), pa.array([block.packed()], pa.binary()), listed(keys), listed(pa.array(docs, pa.int64()))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def word_block(words: pa.Array, doc: np.ndarray, doc_source: list[int]) -> TermBlock:
    """A block from all its terms, the document of each and the source numbers of the documents."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.zeros(len(order), "i8")
    rank[order] = np.arange(len(order))
    held, times = np.unique(rank[coded.indices.to_numpy()] << 32 | doc, return_counts=True)
    return TermBlock(
        coded.dictionary.take(pa.array(order)), doc_source=np.array(doc_source, "u4"), sizes=np.bincount(held >> 32, minlength=len(order)), docs=held & 0xFFFFFFFF, times=times,
        settled=np.zeros(len(order), bool), key_of=np.full(len(order), -1, "i4"),
    )


def term_block(texts: list[list[bytes]], doc_source: list[int]) -> TermBlock:
    """A block from the terms and the source numbers of its documents."""
    words = pa.array([t for terms in texts for t in terms], pa.binary())
    return word_block(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), doc_source)


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        open_blocks: dict[str, tuple[list, list, dict]] = {}
        sizes: dict[str, int] = {}
        text = batch.column(2)
        rows = zip(*(batch.column(k).to_pylist() for k in range(2)), text.cast(pa.binary()), pc.utf8_length(text).to_pylist(), strict=True)
        for lang, source, text, size in rows:
            texts, doc_source, sources = open_blocks.setdefault(lang, ([], [], {}))
            texts.append(text.as_py())
            doc_source.append(sources.setdefault(source, len(sources)))
            sizes[lang] = sizes.get(lang, 0) + size
            if sizes[lang] >= limit:
                del open_blocks[lang]
                yield _row(number, lang, list(sources), word_block(*words_of(texts), doc_source), FIRST, schema)
                number, sizes[lang] = number + 1, 0
        for lang, (texts, doc_source, sources) in open_blocks.items():
            yield _row(number, lang, list(sources), word_block(*words_of(texts), doc_source), FIRST, schema)
            number += 1


def kept_term_counts(docs: DataFrame, least: int = 30, block: int = BLOCK) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms that ``least`` documents of their language hold; staged.

    ``docs`` has lang, source and text without nulls.
    """
    schema = T.StructType.fromDDL(_BLOCKS)
    arrow = to_arrow_schema(schema)
    blocks = stage(docs.select("lang", "source", "text").mapInArrow(lambda batches: _cut(batches, arrow, block), schema), "prefixes")
    length = FIRST
    while True:
        counted = blocks.select("lang", F.explode(F.arrays_zip("keys", "key_docs")).alias("k")).groupBy("lang", F.col("k.keys").alias("key"))
        alive = stage(counted.agg(F.sum("k.key_docs").alias("n")).filter(F.col("n") >= least).select("lang", "key"), "alive-prefixes")
        uses = blocks.select(F.col("block").alias("of"), "lang", F.posexplode("keys").alias("at", "key"))
        found = uses.join(alive, ["lang", "key"]).select("of", "at")
        pairs = blocks.groupBy("block").cogroup(found.groupBy("of"))
        if alive.filter(F.substring("key", -1, 1) != F.lit(_END)).isEmpty():
            counts = pairs.applyInArrow(_counts, "lang string, source string, term binary, n long")
            total = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
            return stage(total.withColumn("term", F.col("term").cast("string")), "term-counts")
        length *= 2
        blocks = stage(pairs.applyInArrow(_refined(length, arrow), schema), "prefixes")


def _survivors(blocks: pa.Table, found: pa.Table) -> TermBlock:
    """A block's terms without those whose prefix went."""
    block = TermBlock.unpacked(blocks.column("held")[0].as_py())
    ends = pc.binary_slice(blocks.column("keys")[0].values, -1)
    block.keep(found.column("at").to_numpy(), pc.equal(ends, pa.scalar(_END, pa.binary())).to_numpy(zero_copy_only=False))
    return block


def _refined(length: int, schema: pa.Schema):
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        block = _survivors(blocks, found)
        number, lang, sources = (blocks.column(k)[0].as_py() for k in range(3))
        return pa.Table.from_batches([_row(number, lang, sources, block, length, schema)] if len(block.terms) else [], schema=schema)

    return run


def _counts(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """Occurrences of a block's terms by source."""
    block, lang, sources = _survivors(blocks, found), blocks.column("lang")[0].as_py(), blocks.column("sources")[0].as_py()
    many = max(len(sources), 1)
    number = np.repeat(np.arange(len(block.terms)), block.sizes) * many + block.doc_source[block.docs]
    cells, at = np.unique(number, return_inverse=True)
    n = np.bincount(at, weights=block.times, minlength=len(cells)).astype("i8")  # exact: a block's counts are small
    columns = [pa.array([lang] * len(cells), pa.string()), pa.array(sources, pa.string()).take(pa.array(cells % many)), block.terms.take(pa.array(cells // many)), pa.array(n)]
    return pa.Table.from_arrays(columns, names=["lang", "source", "term", "n"])


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly."""
    return F.expr(f"1 + (CAST((CAST({n} AS DECIMAL(20,0)) + 5) * 1000000000 AS DECIMAL(38,0)) div CAST({total} + 5 * {terms} AS DECIMAL(38,0)))")


def _tile_differences(lang: str, rows: pa.Table, across: bool) -> list[tuple]:
    """(lang, a, b, value) of the pairs of sources of one or two tiles over one block of terms."""
    source, term = rows.column("source").to_pylist(), rows.column("term").to_pylist()
    p, tile = rows.column("p").to_numpy(), rows.column("tile").to_numpy()
    usual = {s: (k, v) for s, t, v, k in zip(source, term, p, tile, strict=True) if t is None}
    names = sorted(usual)
    row_of, column_of = {s: k for k, s in enumerate(names)}, {}
    named = [k for k, t in enumerate(term) if t is not None]
    columns = [column_of.setdefault(term[k], len(column_of)) for k in named]
    m = np.repeat(np.array([usual[s][1] for s in names], "i8")[:, None], len(column_of), axis=1)
    m[[row_of[source[k]] for k in named], columns] = p[named]
    tiles = np.array([usual[s][0] for s in names])
    out = []
    for i, name in enumerate(names):
        others = np.flatnonzero(tiles > tiles[i]) if across else np.arange(i + 1, len(names))
        out += [(lang, *sorted((name, names[j])), int(v)) for j, v in zip(others, np.abs(m[others] - m[i]).sum(axis=1), strict=True)]
    return out


def source_differences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every pair of sources of a language, a < b: absolute differences of shares summed over all kept terms.

    ``counts`` has the share p of the terms that a group holds, ``groups`` the
    share usual of any other and the number of kept terms and sources of its
    language. Groups are dealt to each block of terms, and tiles of sources to
    each other tile of their language.
    """
    spread = groups.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int")).withColumn("tiles", F.ceil(F.col("n_sources") / SOURCES).cast("int"))
    told = counts.join(spread.select("lang", "source", "parts", "tiles"), ["lang", "source"])
    told = told.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "tiles")
    usual = spread.select("lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("usual", F.lit(0)).alias("p"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "tiles")
    rows = told.unionByName(usual).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    rows = rows.select("lang", "source", "term", "p", "part", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        found = _tile_differences(lang, group, low != high)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    parts = rows.groupBy("lang", "part", "low", "high").applyInArrow(run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 30, ranks: int = 50, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language (part ``pair``), and
    the ``ranks`` kept terms that it holds most beyond the language's share (part ``term``)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = kept_term_counts(texts, least, block)
    by_term = stage(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "lang-terms")
    langs = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    names = stage(texts.select("lang", "source").distinct(), "groups")
    langs = names.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(langs, "lang", "left").fillna(0, ["terms", "lang_total"])
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = join_small(names, langs, ["lang"], F.xxhash64("source")).join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = stage(groups.withColumn("usual", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "group-totals")
    held = join_small(counts, groups, ["lang", "source"], F.xxhash64("term")).withColumn("p", share("n", "total", "terms"))
    held = stage(held.select("lang", "source", "term", "p", "lang_total", "terms"), "group-shares")

    pairs = source_differences(held.select("lang", "source", "term", "p"), groups)
    pairs = stage(pairs, "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    place = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    beyond = held.join(by_term, ["lang", "term"]).withColumn("value", F.col("p") - share("lang_n", "lang_total", "terms"))
    beyond = beyond.filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    beyond = beyond.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= ranks)
    return both.unionByName(beyond)
