"""Piece codec (11), vector codes (12) and source audit (13) against the library and plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortkit.llm import common, piece_codec, prefix_audit, vector_codes
from tests.llm.conftest import make

ODD = [
    (1, "a  b ", "en"), (2, " lead", "en"), (3, "\t\n tab nbsp", None), (4, "mark ▁ inside▁▁x", "en"), (5, "<s> </s> <unk> <0x0A>", "en"), (6, "😀‍👩 é é ﬁ", "fr"),
    (7, " ", "en"), (8, "x" * 30_000, "en"), (9, " " * 5_000, "en"), (10, "\x00 nul\x00", "en"), (2**60 + 1, "wide id", "en"),
]


# --------------------------------------------------------------------------- 11
def library_answer(text):
    library = piece_codec._library(piece_codec.default_model())
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return np.array(ids, "<u4").tobytes(), library.decode(ids)


def test_pieces_are_those_of_the_library(spark, docs, corpus):
    rows = piece_codec.encode_decode(docs.unionByName(make(spark, ODD))).collect()
    want = Counter((i, *library_answer(t)) for i, t, _ in [*corpus, *ODD])
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in rows) == want


def test_small_blocks_give_the_same_pieces(spark, docs, corpus):
    rows = piece_codec.encode_decode(docs, block=500, hand_over=300).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in rows) == Counter((i, *library_answer(t)) for i, t, _ in corpus)


def test_each_distinct_word_is_segmented_once(corpus):
    class Counting:
        def __init__(self, library):
            self.library, self.seen = library, Counter()

        def __getattr__(self, name):
            return getattr(self.library, name)

        def encode(self, words, **options):
            self.seen.update(words)
            return self.library.encode(words, **options)

    library, table = Counting(piece_codec._library(piece_codec.default_model())), piece_codec.WordTable()
    for i, t, _ in corpus:
        table.add(i, t)
    assert [(i, ids, text) for i, ids, text in table.results(library)] == [(i, *library_answer(t)) for i, t, _ in corpus]
    assert set(library.seen.values()) == {1}


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" ▁\t\nab"), max_size=60))
def test_marked_words_cut_any_text(text):
    library = piece_codec._library(piece_codec.default_model())
    words = piece_codec.marked_words(text)
    ids = piece_codec.segment(library, words)
    assert sum(ids, []) == library.encode(text)
    assert " ".join(library.decode(ids)) == library.decode(library.encode(text))


def test_pieces_of_empty_and_null_tables(spark, no_docs, null_docs):
    assert piece_codec.encode_decode(no_docs).collect() == []
    rows = piece_codec.encode_decode(null_docs).collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows] == [(None, [1, 2], "")] * 3


def test_text_ids_are_carried(spark):
    rows = piece_codec.encode_decode(spark.createDataFrame([("k", "a b"), (None, "a")], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.decoded) for r in rows} == {("k", "a b"), (None, "a")}


# --------------------------------------------------------------------------- 12
def plain_nearest(values, entries):
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in entries] for v in values]
    return [d.index(min(d)) for d in far], [min(d) for d in far]


@pytest.mark.parametrize(("width", "n", "entries", "largest"), [(16, 80, 256, 300), (5, 40, 7, 3), (1, 30, 3, 2), (16, 20, 20, 2**45), (12, 30, 1, 5)])
def test_nearest_entry_is_exact(width, n, entries, largest):
    rng = np.random.default_rng(width)
    values, book = rng.integers(-largest, largest, (n, width)), rng.integers(-largest, largest, (entries, width))
    book[-1] = book[0]  # ties go to the lower index
    values[0] = book[0]
    chosen, far = vector_codes.nearest(values, book)
    assert (chosen.tolist(), [int(d) for d in far]) == plain_nearest(values, book)


def test_transform_is_in_sequency_order():
    rows = vector_codes.transform(np.eye(16, dtype="i8"))
    assert [int((np.diff(rows[:, k]) != 0).sum()) for k in range(16)] == list(range(16))
    x = np.random.default_rng(1).integers(-50, 50, (9, 13))
    assert ((vector_codes.transform(x) ** 2).sum(axis=1) == 16 * (x**2).sum(axis=1)).all()


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(1, math.ceil(max((len(v) for _, v, _ in kept), default=0) / parts))
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    firsts = {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(firsts.get(i, v), v)
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(firsts[i], p) for i in sorted(firsts)[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            chosen, _ = plain_nearest([cut(v, p) for _, v, _ in kept], books[p])
            for e in set(chosen):
                own = [cut(v, p) for (_, v, _), c in zip(kept, chosen, strict=True) if c == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [plain_nearest([cut(v, p) for _, v, _ in kept], books[p]) for p in range(parts)]
    errors = [sum(f[1][k] for f in found) for k in range(len(kept))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return Counter((i, tuple(f[0][k] for f in found), errors[k], by_label[label]) for k, (i, _, label) in enumerate(kept)), books


def test_codes_match_plain_loops(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([0, 1, None])) for k in range(60)]
    rows += [(None, [0.5] * 8, 1), (7, [-0.9] * 8, 0), (70, None, 1), (71, [None] + [0.0] * 7, 1), (72, [math.inf] * 8, 1), (73, [math.nan] * 8, 1)]
    rows += [(74, [], None), (75, [0.25, -0.25], 0), (76, [1e9] * 8, 2), *[(80 + j, rows[5][1], 0) for j in range(20)], rows[9], rows[9]]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, v string, error double")
    coded, books = vector_codes.compress(frame, parts=4, entries=16, rounds=4)
    want, want_books = plain_codes(rows, 4, 16, 4)
    got = Counter((r.id, tuple(r.codes), r.error, r.label_error) for r in vector_codes.with_label_error(coded).collect())
    assert got == want
    assert [b.tolist() for b in books] == want_books


def test_labels_too_many_to_broadcast_are_salted(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST", 0)
    coded = spark.range(200).selectExpr("id", "IF(id % 3 = 0, NULL, CAST(id % 2 AS INT)) AS label", "array(1) AS codes", "id AS error")
    want = Counter()
    for i in range(200):
        want[None if i % 3 == 0 else i % 2] += i
    rows = vector_codes.with_label_error(coded).collect()
    assert len(rows) == 200 and all(r.label_error == want[r.label] for r in rows)


def test_vector_tables_without_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(None, None, None)] * 3, [(None, [1.0], 2)]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, kind))
        assert vector_codes.with_label_error(coded).collect() == []
        assert all(len(b) == 0 for b in books)


# --------------------------------------------------------------------------- 13
def plain_audit(rows, least, ranks):
    docs = [((lang or ""), (source or ""), [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    held, out = Counter(), set()
    for lang, _, words in docs:
        held.update((lang, w) for w in set(words))
    for lang in {d[0] for d in docs}:
        kept = {w for (of, w), n in held.items() if of == lang and n >= least}
        counts = defaultdict(Counter)
        for of, source, words in docs:
            if of == lang:
                counts[source].update(w for w in words if w in kept)
                counts[source] += Counter()
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])
            out |= {(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(terms[:ranks], 1)}
    return out


def audit_rows(seed, n):
    rng = random.Random(seed)
    stock = ["the", "them", "theme", "a", "ab", "abc", "über", "Überall", "été", "日本", "日本語", "x" * 300, "x" * 301, "don't", "A-B_C"]
    rows = [(" ".join(rng.choice(stock[: rng.randrange(2, 16)]) for _ in range(rng.randrange(40))) + f" only{chr(97 + k % 26)}", rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ſ", "", None])) for k in range(n)]
    return rows + [(None, None, None), (None, "fr", "s1"), ("", "fr", "s2"), ("123 456", "fr", None), ("once only", "it", "s9"), rows[0], rows[0]]


@pytest.mark.parametrize(("block", "terms", "sources"), [(8_000_000, 512, 256), (300, 3, 2)])
def test_audit_matches_a_plain_computation(spark, monkeypatch, block, terms, sources):
    for name, value in (("TERMS", terms), ("SOURCES", sources)):
        monkeypatch.setattr(prefix_audit, name, value)
    rows = audit_rows(block, 200)
    frame = spark.createDataFrame([(k, *r, 0.5, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value double, term string")
    got = prefix_audit.audit(frame, least=9, ranks=4, block=block).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain_audit(rows, 9, 4)


def test_prefixes_below_the_threshold_go_early(spark):
    rows = [(f"common rare{chr(97 + k // 26)}{chr(97 + k % 26)}tail", "en", "s") for k in range(100)]
    counts = prefix_audit.kept_term_counts(spark.createDataFrame(rows, "text string, lang string, source string"), least=100)
    assert [tuple(r) for r in counts.collect()] == [("en", "s", "common", 100)]
    block = prefix_audit.term_block([prefix_audit.terms_of(t) for t, _, _ in rows], [0] * 100)
    keys, held = block.keys(2)
    assert (keys.to_pylist(), held.tolist()) == ([b"co", b"ra"], [100, 100])
    block.keep(np.array([0, 1]), np.array([False, False]))
    block = prefix_audit.TermBlock.unpacked(block.packed())
    keys, held = block.keys(8)
    assert keys.to_pylist()[:2] == [b"common\0", b"rareaata"] and held.tolist() == [100] + [1] * 100


def test_audit_of_empty_and_null_tables(spark, no_docs, null_docs):
    assert prefix_audit.audit(no_docs).collect() == []
    assert prefix_audit.audit(null_docs).collect() == []


def test_words_by_byte_masks_are_the_terms_of_the_texts():
    rng = np.random.default_rng(4)
    alphabet = list("aZ @[`{\x00\x7f\n09.") + ["é", "ß", "İ", "K", "語", "\U0001f600", "\x80"]
    texts = ["", " ", "a", "Z", "..", "a.", "\x00a\x00"] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(300)]
    words, doc = prefix_audit.words_of([t.encode() for t in texts])
    want = [(k, w) for k, t in enumerate(texts) for w in prefix_audit.terms_of(t)]
    assert list(zip(doc.tolist(), words.to_pylist(), strict=True)) == want
    made, plain = prefix_audit.word_block(words, doc, [0] * len(texts)), sorted(set(w for _, w in want))
    assert made.terms.to_pylist() == plain
    assert len(prefix_audit.words_of([])[0]) == 0 and len(prefix_audit.word_block(*prefix_audit.words_of([b"..", b""]), [0, 0]).terms) == 0
