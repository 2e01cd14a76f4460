"""Sharding (2), repeated passages (3), packing (4), secrets (5), decontamination (7), near duplicates (8), pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import common, decontaminate, language_id, near_dup, packing, secret_scan, slot_shards, suffix_dedup
from cohortkit.session import scratch_path
from tests.llm.conftest import EN, make, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def test_shards_are_whole_even_and_gapless(spark, docs, corpus):
    rows = slot_shards.shard_documents(docs, n_shards=4, n_slots=64).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # the largest slot bounds how uneven the shards can be
    slots, shards = Counter(), Counter()
    for r in rows:
        slots[r.vslot] += r["size"]
        shards[r.shard] += r["size"]
    assert max(shards.values()) <= sum(shards.values()) / 4 + max(slots.values())


def test_map_is_versioned_and_edited(spark):
    docs = make(spark, [(k, "x" * (50 + k % 90), "en") for k in range(4000)])
    path = scratch_path(spark, "test-map")
    slot_shards.save_map(slot_shards.first_map(spark, 8, 256).withColumn("moved", F.lit(False)), path, 0)
    first = slot_shards.shard_documents(docs, 8, 256, path)
    load = Counter()
    for r in first.collect():
        load[r.shard] += r["size"]
    assert max(load.values()) <= 1.02 * sum(load.values()) / 8
    again = slot_shards.shard_documents(docs, 9, 256, path)
    assert again.first().map_version == 2
    one, two = ({r.vslot: r.shard for r in slot_shards.load_map(spark, path, v).collect()} for v in (1, 2))
    moved = sum(one[s] != two[s] for s in one)
    assert set(one) == set(two) == set(range(256)) and 0 < moved < 64
    assert slot_shards.load_map(spark, path, 0).count() == 256


def test_shards_of_empty_and_null_tables(no_docs, null_docs):
    assert slot_shards.shard_documents(no_docs, 3, 16).count() == 0
    rows = slot_shards.shard_documents(null_docs, 3, 16).collect()
    assert [(r.doc_id, r["size"], r.text_crc32) for r in rows] == [(None, 8, 0)] * 3 and len({(r.shard, r.slot) for r in rows}) == 3


def plain_spans(rows, size):
    words = {k: space_words(t) for k, (_, t) in enumerate(rows)}
    owners = defaultdict(set)
    for k, w in words.items():
        for s in range(len(w) - size + 1):
            owners[tuple(w[s : s + size])].add(rows[k][1])
    ids = defaultdict(set)
    for i, t in rows:
        ids[t].add(i)
    out = Counter()
    for k, (i, t) in enumerate(rows):
        w = words[k]
        if len(w) >= size and len(ids[t] - {None}) > 1:
            out[(i, 0, len(w))] += 1
            continue
        run = None
        for s in range(len(w) - size + 1):
            if len(owners[tuple(w[s : s + size])]) > 1:
                if run and s <= run[1]:
                    run[1] = s + size
                else:
                    if run:
                        out[(i, *run)] += 1
                    run = [s, s + size]
        if run:
            out[(i, *run)] += 1
    return out


def test_repeated_spans_match_brute_force(spark, docs, corpus):
    rng = random.Random(5)
    passage = prose(77, 64, EN)
    extra = [(900 + k, f"{prose(500 + k, rng.randrange(40), EN)} {passage.upper() if k % 2 else passage} {prose(600 + k, rng.randrange(90), EN)}", "en") for k in range(8)]
    cut = passage.split()
    extra += [(950, " ".join([*cut[20:], prose(70, 60, EN)]), "en"), (951, " ".join([prose(71, 60, EN), *cut[:49]]), "en"), (952, " ".join(cut[:50]), "en")]
    found = suffix_dedup.repeated_spans(docs.unionByName(make(spark, extra))).collect()
    want = plain_spans([(i, t) for i, t, _ in [*corpus, *extra]], 50)
    assert Counter((r.doc_id, r.start_word, r.end_word) for r in found) == want
    assert {900, 901, 952} <= {r.doc_id for r in found} and 951 not in {r.doc_id for r in found}


def test_a_row_without_an_id_is_a_document_of_its_own(spark):
    text, other = prose(70, 60, EN), prose(71, 70, EN)
    found = suffix_dedup.repeated_spans(make(spark, [(1, text, "en"), (None, text, "en"), (2, other, "en"), (2, other, "en")])).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in found} == {(1, 0, 60), (None, 0, 60)}
    found = suffix_dedup.repeated_spans(make(spark, [(None, text, "en"), (None, text, "en")])).collect()
    assert [(r.doc_id, r.n_words) for r in found] == [(None, 60)] * 2


def test_spans_of_empty_and_null_tables(no_docs, null_docs):
    assert suffix_dedup.repeated_spans(no_docs).count() == 0 and suffix_dedup.repeated_spans(null_docs).count() == 0


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_own():
    own, whole = packing.ByteBPE(packing.default_vocabulary()), tokenizer()
    texts = ["", " ", "  a\n\n b\t c  ", "don't we'll", "naïve – 漢字 🙂🙂", "a  b\x85c\xa0 d\x1c\x1d e", "x" * 3000, "<|endoftext|> <|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext", "12 345,6 !!?", "\r\n \r\n"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab1 \n\t'sé. 漢-") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert own.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_packing_is_whole_and_dense(spark, docs, corpus):
    whole = tokenizer()
    rows = packing.pack_documents(docs, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append(r)
    want = Counter()
    for i, t, _ in corpus:
        want[(i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1]))] += 1
    got = Counter()
    for (i, n), own in pieces.items():
        own.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in own)
        for first in {tuple(r.ids) for r in own if r.start == 0}:
            same = sum(tuple(r.ids) == first for r in own if r.start == 0)
            rest = [x for r in own[copies:] for x in r.ids]
            got[(i, (*first, *rest)) if copies == 1 else (i, first)] += same
    assert got == want
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    assert sum(r.length for r in rows) > 0.95 * 2048 * (len(sequences) - 1)


def test_shortest_pack_first_places_all():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(12)}
        patterns = packing.shortest_pack_first(histogram, 64)
        placed = Counter()
        for count, pattern in patterns:
            assert sum(pattern) <= 64
            for length in pattern:
                placed[length] += count
        assert placed == histogram


def test_packing_of_empty_and_null_tables(no_docs, null_docs):
    assert packing.pack_documents(no_docs).count() == 0
    rows = packing.pack_documents(null_docs).collect()
    assert [(r.doc_id, r.length, r.doc_tokens) for r in rows] == [(None, 1, 1)] * 3


def test_secrets_are_told_from_harmless_findings(spark, no_docs, null_docs):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, secret = [], {}
    for k in range(120):
        kind = k % 4
        value = [hexes(40), "".join(rng.choice("0123456789") for _ in range(16)), hexes(40), f"/docs/page{hexes(18)}.html"][kind]
        lead = ["token = \"%s\"", "paid by %s", "commit sha1: %s", "see https://a.example%s"][kind]
        rows.append((k, f"{prose(k, 20, EN)} {lead % value} {prose(k + 1, 9, EN)}", "en"))
        secret[k] = kind == 0
    docs = make(spark, rows)
    found = secret_scan.scan(docs)
    by_doc = defaultdict(bool)
    for r in found.collect():
        by_doc[r.doc_id] |= r.secret
    assert {k: by_doc[k] for k in secret} == secret
    clean = {r.doc_id: r for r in secret_scan.redact(docs, found).collect()}
    for i, t, _ in rows:
        assert (clean[i].text == t) != secret[i] and clean[i].n_chars == len(clean[i].text) and len(clean) == len(rows)
        assert not secret[i] or re.search(r'token = "\[SECRET\]"', clean[i].text)
    assert secret_scan.scan(no_docs).count() == 0 and secret_scan.scan(null_docs).count() == 0
    assert secret_scan.redact(null_docs, secret_scan.scan(null_docs)).count() == 3


def test_secrets_of_every_form_are_candidates_and_masked(spark):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    # lead, value, rest; the value of every form must be found whole, called a secret and masked alone
    forms = [
        ("API_KEY=", lambda: hexes(32), ""),
        ("AWS_ACCESS_KEY_ID=", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(16)), ""),
        ("see https://a.host/x?page=2&access_token=", lambda: hexes(32), "&lang=en"),
        ('{"user":"bob","api_key":"', lambda: hexes(32), '","port":1}'),
        ('password = "', lambda: f"Tr0ub4dor&{rng.randrange(10, 99)}", '"'),
        ("DB_PASSWORD=", lambda: f"hunter{rng.randrange(10, 99)}!", ""),
        ("client_secret: '", lambda: "".join(rng.choice("abcdefghABCDEFGH") for _ in range(24)), "'"),
        ('password: str = "', lambda: f"pw,{hexes(6)};z", '"'),
        ("Authorization: Bearer ", lambda: hexes(40), ""),
        ("token=", lambda: "z" + "".join(rng.choice("qwrtplkj") for _ in range(600)) + hexes(8), ""),
    ]
    rows, values = [], {}
    for k in range(200):
        lead, value, rest = forms[k % 10]
        values[k] = value()
        rows.append((k, f"{prose(k, 20, EN)} {lead}{values[k]}{rest} {prose(k + 1, 9, EN)}", "en"))
    for k in range(200, 300):
        rows.append((k, f"{prose(k, 9, EN)} {['author: walker', 'commit=' + hexes(40), 'token: the light', 'password = None', 'id=' + hexes(32)][k % 5]} end", "en"))
    docs = make(spark, rows)
    found = secret_scan.scan(docs)
    by_doc = defaultdict(set)
    for r in found.filter("secret").collect():
        by_doc[r.doc_id].add(r.value)
    assert {k: v for k, v in by_doc.items() if k < 200} == {k: {v} for k, v in values.items()}
    assert not any(k in by_doc for k in range(200, 300) if k % 5 != 4)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, found).collect()}
    assert all(clean[k] == rows[k][1].replace(v, "[SECRET]") for k, v in values.items())


def test_places_of_candidates_and_masks_of_short_values(spark):
    text = 'a b password = "one two 3" then x=1&token=abc&y key:"q" sun sunny'
    got = [(r.word_no, r.prefix, r.value, r.named) for r in secret_scan.candidates(make(spark, [(1, text, "en")])).collect()]
    assert got == [(4, '"', "one two 3", True), (8, "x=1&token=", "abc&y", True)]
    docs = make(spark, [(1, "pwd=sun sunny sun, pin r2 r2d2 a\\Eb.c", "en")])
    found = docs.select("doc_id", secret_scan.row_key(F.col("doc_id"), F.col("text")).alias("key"), F.explode(F.array(*map(F.lit, ["sun", "r2", "a\\Eb.c"]))).alias("value"))
    masked = secret_scan.redact(docs, found.withColumn("secret", F.lit(True))).first().text
    assert masked == "pwd=[SECRET] sunny sun, pin [SECRET] r2d2 [SECRET]"


def grams(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_contained_items_match_brute_force(spark, docs, corpus, no_docs):
    items = [(k, prose(800 + k, 6 + 9 * k, EN)) for k in range(9)] + [(20, None), (21, ""), (22, "two words"), (3, prose(803, 33, EN))]
    extra = []
    for k, text in items[:9]:
        w = text.split()
        extra.append((900 + k, f"{prose(k, 400, EN)} {text.upper()}! {prose(k + 50, 30, EN)}", "en"))
        w[len(w) // 2] = "changed"
        extra.append((920 + k, f"{prose(k, 30, EN)} {' '.join(w)}", "en"))
    extra += [(940, "Two, words", "en"), (941, "more than two words here", "en"), (942, "two more words", "en")]
    table = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, doc_id string")
    found = decontaminate.contained_items(docs.unionByName(make(spark, extra)), table).collect()
    want = set()
    for i, t, _ in [*corpus, *extra]:
        for j, item in items:
            q = grams(item, 5)
            own = grams(t, min(5, len(next(iter(q)))) if q else 5)
            if q and 100 * len(q & own) >= 80 * len(q):
                want.add((i, j, len(q), len(q & own)))
    assert {(r.doc_id, r.item_id, r.item_shingles, r.hits) for r in found} == want and len(found) == len(want) >= 10
    assert decontaminate.contained_items(no_docs, table).count() == 0
    assert decontaminate.contained_items(docs, table.limit(0)).count() == 0


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = space_words(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "large", "worth"), [(3, 85, 64, 8), (3, 85, 4, 1000), (3, 85, 4, 0), (5, 80, 4, 0)])
def test_near_duplicates_match_brute_force(spark, corpus, n, percent, large, worth, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "WORTH", worth)  # 1000: no rounds; 0: rounds while they help
    rng = random.Random(8)
    base = prose(66, 120, EN).split()
    near = []
    for k in range(60):  # a group whose members drift apart
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        near.append((500 + k, " ".join(w), "en"))
    rows = [r for r in corpus if r[0] is not None] + near
    found = near_dup.near_duplicates(make(spark, [*rows, (None, rows[0][1], "en")]), n, percent).collect()
    want = plain_components([(i, t) for i, t, _ in rows], n, percent)
    named = [r for r in found if r.doc_id is not None]
    assert len(named) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in named} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in named)
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]


def test_partners_belong_to_other_components_and_a_row_makes_one_pair(spark):
    rows = [(i, 10, 1, i % 7, 0, 60, 400) for i in range(400)]  # one bin of seven components
    open_rows = spark.createDataFrame(rows, "id long, n long, bin long, comp long, major long, most long, all long")
    first, second = ([(r.a, r.b) for r in near_dup.partners(open_rows, turn).collect()] for turn in (1, 2))
    assert 300 < len(first) <= 400 and all(a < b and a % 7 != b % 7 for a, b in first)
    assert len(set(first) & set(second)) < 40
    assert near_dup.partners(open_rows.withColumn("comp", F.lit(3)), 1).count() == 0


def test_a_drifting_group_needs_no_rounds_and_one_row_a_band(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(67, 150, EN).split()
    rows = [(k, prose(900 + k, 80, EN), "en") for k in range(40)]  # alone
    for k in range(200):  # a few words off the base each, so that many pairs are near the threshold and below
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randrange(1, 8)):
            w[at] = f"edit{rng.randrange(10**6)}"
        rows.append((500 + k, " ".join(w), "en"))
    staged = {}
    keep = near_dup.stage
    monkeypatch.setattr(near_dup, "stage", lambda df, name: staged.setdefault(name, []).append(keep(df, name)) or staged[name][-1])
    found = near_dup.near_duplicates(make(spark, rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components([(i, t) for i, t, _ in rows], 3, 85)
    assert "partners" not in staged
    bins = staged["bins"][0]
    assert bins.count() <= 200 * near_dup.bands_for(0.85) and bins.groupBy("id", "bin").count().filter("count > 1").count() == 0
    assert {r.doc_id for r in staged["texts"][0].collect()} == {r.id for r in bins.select("id").distinct().collect()} <= set(range(500, 700))


def test_the_pivot_is_the_text_that_meets_most_others(spark):
    rows = [(1, 10, 7, 3), (2, 10, 7, 9), (3, 11, 7, 9), (4, 10, 8, 2), (5, 10, 8, 2)]
    found = near_dup.central_pivots(spark.createDataFrame(rows, "id long, n long, bin long, weight long")).collect()
    assert {r.bin: (r.id2, r.n2) for r in found} == {7: (2, 10), 8: (4, 10)}


def test_near_duplicates_of_empty_and_null_tables(no_docs, null_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert [(r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(null_docs).collect()] == [(0, None, True)] * 3


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(40)]
    hub = [(1000, 1001 + k) for k in range(50)]
    found = near_dup.connected_components(spark.createDataFrame([*path, *hub], "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {k: 0 for k in range(41)} | {k: 1000 for k in range(1000, 1051)}


def test_components_of_random_links_and_a_hub_with_the_greatest_id(spark):
    rng = random.Random(3)
    links = [tuple(rng.randrange(300) for _ in "ab") for _ in range(220)] + [(999, 400 + k) for k in range(60)] + [(7, 7)]
    least = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = near_dup.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == least and len(found) == len(least)


def test_pruning_keeps_pairs_at_the_threshold():
    for n in (25, 50, 125):
        least = near_dup.least_matches(0.85, n, 1e-7)
        assert least < 0.85 * n and near_dup.least_matches(0.85, n, 1e-3) > least


def test_pipeline_with_nulls_repeats_odd_names_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, prose(k, 80, EN), "en") for k in range(12)]
    rows += [rows[3], (None, rows[5][1], "en"), (50, None, "en"), (51, "", None), (None, None, None), (52, f'{prose(52, 40, EN)} token = "{secret}" end', None)]
    kind = "doc_id long, text string, lang string, _key string, _values int, _found string, key string, n_chars long"
    frame = spark.createDataFrame([(i, t, lang, "k", 1, "f", "u", None if t is None else len(t)) for i, t, lang in rows], kind)
    for name, table in (("some", frame), ("none", frame.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "no such item stands in any of these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = table = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, f"{tmp_path}/some")
        assert docs.columns == table.columns
        rows_left = docs.collect()
        assert all((r._key, r._values, r._found, r.key) == ("k", 1, "f", "u") for r in rows_left)
        docs = spark.createDataFrame(rows_left, docs.schema)
    ids = [r.doc_id for r in rows_left]
    assert sorted(i for i in ids if i is not None) == sorted([*range(12), 3, 52]) and ids.count(None) == 1
    assert secret not in next(r.text for r in rows_left if r.doc_id == 52)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    item = prose(99, 30, EN)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, prose(k, 80, EN), "en") for k in range(20)]
    rows += [(100, rows[4][1], "en"), (101, f"{prose(41, 40, EN)} {item}", "en"), (102, f'{prose(42, 40, EN)} token = "{secret}" end', "en"), (103, "123 456", "en")]
    make(spark, rows).drop("score", "label").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("language_id") == {*range(20), 100, 101, 102}
    assert ids("near_duplicates") == {*range(20), 101, 102}
    assert ids("decontamination") == ids("secret_scan") == ids("packing") == {*range(20), 102}
    texts = {r.doc_id: r.text for r in seen["secret_scan"]}
    assert secret not in texts[102] and texts[5] == rows[5][1]


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)

    def sizes(batches):
        for batch in batches:
            yield batch.assign(size=batch["text"].str.len().sum())[["size"]].head(1)

    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 4000).alias("text"))
    with common.small_batches(spark):
        found = [r["size"] for r in texts.mapInPandas(sizes, "size long").collect()]
    assert sum(found) == 12_000_000 and max(found) <= 1.1 * common.BATCH_BYTES

    seen, keep = [], near_dup.stage
    monkeypatch.setattr(near_dup, "stage", lambda df, name: seen.append((name, spark.conf.get(key, None))) or keep(df, name))
    assert near_dup.near_duplicates(make(spark, [(1, prose(1, 40, EN), "en"), (2, prose(1, 40, EN), "en")])).count() == 2
    assert {"signed", "links"} <= {name for name, _ in seen} and {v for _, v in seen} == {str(common.BATCH_BYTES)}
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "1m")  # a bound of the session's own stays
    with common.small_batches(spark):
        assert spark.conf.get(key) == "1m"
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_language_filter_judges_few_texts_at_a_time(spark, monkeypatch):
    class Few:
        def predict(self, x):
            return np.full(len(x), "en", object), np.ones(len(x))

        def is_familiar(self, words, langs):
            return np.full(len(words), len(words) == len(langs) <= 64)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: SimpleNamespace(value=value))  # a local class goes with the function alone
    docs = spark.range(0, 200, 1, 1).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert language_id.accepted(docs, Few()).count() == 200
