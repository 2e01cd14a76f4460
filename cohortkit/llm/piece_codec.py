"""SentencePiece ids and decoded texts through tables of distinct marked words.

The library marks each space with U+2581 and puts one mark before the text.
Where no piece of the model holds a mark behind another character, no merge
crosses from a word into the next mark, so a text's ids are those of its marked
words (``_+[^_]*``, with _ for the mark) in turn. A task takes its texts in
blocks (up to ``BLOCK`` characters, or one longer text). A block's distinct
words form a table, and each text is the places of its words in it; the library
segments and decodes each word of the table once, and the results are joined
back by position. Nothing is shuffled, as a table over all blocks costs more
than it saves: most words that a block adds to it stand in no other (README).

Defined results: a null or empty text has begin and end id only and decodes to
the empty text; ids of any type, null or repeated, stay as they are (a row for
each row); an empty table gives no rows; other columns are ignored; a model
with a normaliser or with pieces across marks is refused with ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text in a block, and bytes of results handed over at once.
BLOCK, HAND_OVER = 16_000_000, 16_000_000
MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Refuse a model whose texts cannot be cut at marks."""
    model = _library(path)
    if any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("a piece of the model crosses a space mark")
    if model.piece_to_id(MARK) == model.unk_id():
        raise ValueError("the model has no piece for a mark alone")
    if model.normalize(" ½Ａ  é\t") != f"{MARK * 2}½Ａ{MARK * 2}é\t":
        raise ValueError("the model normalises texts or does not mark their start")


def marked_words(text: str | None) -> list[str]:
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(library, words: list[str]) -> list[list[int]]:
    """Ids of marked words; the library itself puts the first mark, but not before an empty text."""
    alone = [library.piece_to_id(MARK)]
    return [alone if w == MARK else ids for w, ids in zip(words, library.encode([w[1:] for w in words], num_threads=1), strict=True)]


class WordTable:
    """The distinct marked words of a block, and its texts as places in them."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.doc_ids: list[pa.Scalar] = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: pa.Scalar, text: str | None) -> None:
        known = self.places
        self.texts.append(np.array([known.setdefault(w, len(known)) for w in marked_words(text)], "u4"))
        self.doc_ids.append(doc_id)
        self.size += len(text or "")

    def results(self, library) -> Iterator[tuple[pa.Scalar, bytes, str]]:
        """(id, ids as little-endian unsigned 32-bit numbers, decoded text) of each text."""
        segmented = segment(library, list(self.places))
        decoded = library.decode(segmented, num_threads=1) if segmented else []
        ids = [np.array(x, "<u4").tobytes() for x in segmented]
        begin, end = (np.array([i], "<u4").tobytes() for i in (library.bos_id(), library.eos_id()))
        for doc_id, text in zip(self.doc_ids, self.texts, strict=True):
            mine = text.tolist()
            # the library leaves out the first mark of a text only
            yield doc_id, b"".join([begin, *[ids[p] for p in mine], end]), " ".join([decoded[p] for p in mine])


def _run(batches: Iterator[pa.RecordBatch], model: str, schema: pa.Schema, block: int, hand_over: int) -> Iterator[pa.RecordBatch]:
    library = _library(model)

    def finished(table: WordTable) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in table.results(library):
            rows.append(row)
            size += len(row[1]) + len(row[2])
            if size > hand_over:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    table = WordTable()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            table.add(doc_id, text.as_py())
            if table.size >= block:
                yield from finished(table)
                table = WordTable()
    yield from finished(table)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def encode_decode(
    docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hand_over: int = HAND_OVER
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers, with begin and end id) and the text decoded from them."""
    model = model or default_model()
    check_model(model)
    schema = T.StructType().add("doc_id", docs.schema[id_col].dataType).add("ids", "binary").add("decoded", "string")
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _run(batches, model, arrow, block, hand_over), schema)
