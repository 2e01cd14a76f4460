"""Quality divergence (1), language ID (9), toxicity (6), license scan (10) against brute force and held-out rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import language_id, license_scan, quality_divergence, toxicity
from cohortkit.llm.common import stage
from tests.llm.conftest import DE, EN, FR, make, prose

WORDS = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_brute_force(spark, docs, corpus):
    extra = [(900, "a b c a b c\nx y\nx y\n\n x y", "en"), (901, "a a a a a", "en"), (902, "## $5 | <b> &", "en")]
    rows = quality_divergence.quality_verdicts(docs.unionByName(make(spark, extra))).collect()
    want = Counter((i, *base_counts(t)) for i, t, _ in [*corpus, *extra])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def jensen_shannon(p, q):
    m = (p + q) / 2
    half = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0) / 2
    return math.sqrt(max(half(p) + half(q), 0))


def test_distances_match_a_plain_computation(spark, docs):
    feats = stage(quality_divergence.features(docs, quality_divergence.COMMON_WORDS), "quality")
    refs = quality_divergence.references(feats, quality_divergence.COMMON_WORDS)
    by_lang = {r.ref: r for r in refs.collect()}
    for r in quality_divergence.judge(feats, refs).collect():
        if r.word_distance is not None and r.lang is not None:
            ref = by_lang[r.lang]
            p = np.array(r.classes) / r.word_chars
            assert r.char_distance == pytest.approx(jensen_shannon(p, np.array(ref.ref_classes)), abs=1e-6)
            own = {x.word: x.n / r.n_words for x in r.common}
            names = sorted(ref.ref_words)
            a, b = [own.get(w, 0.0) for w in names], [ref.ref_words[w] for w in names]
            want = jensen_shannon(np.array([*a, 1 - sum(a)]), np.array([*b, 1 - sum(b)]))
            assert r.word_distance == pytest.approx(want, abs=1e-6)


def test_noise_fails_and_prose_stays(spark):
    clean = [(k, prose(k, 300, EN), "en") for k in range(12)]
    noisy = [(100, " ".join(w + "$$%" for w in prose(1, 300, EN).split()), "en"), (101, prose(2, 300, EN).upper(), "en")]
    kept = {r.doc_id: r.kept for r in quality_divergence.quality_verdicts(make(spark, clean + noisy)).collect()}
    assert all(kept[i] for i, _, _ in clean) and not kept[100] and not kept[101]


def test_quality_of_empty_and_null_tables(no_docs, null_docs):
    assert quality_divergence.quality_verdicts(no_docs).count() == 0
    rows = quality_divergence.quality_verdicts(null_docs).collect()
    assert len(rows) == 3 and all(r.n_words == 0 and r.base_failed and not r.kept for r in rows)


def test_language_is_right_on_held_out_rows(spark):
    rows = [(k, prose(k, 12 + k % 30, s), lang) for k, (lang, s) in enumerate([("en", EN), ("fr", FR), ("de", DE)] * 40)]
    truth = {i: lang for i, _, lang in rows}
    found = language_id.identify(make(spark, rows)).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows) and len(held) > 10
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edges(docs, no_docs, null_docs):
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for i in (300, 301, 302, 306):
        assert found[i].lang_pred == "und" and found[i].score == 0
    assert language_id.identify(no_docs).count() == 0
    assert {r.lang_pred for r in language_id.identify(null_docs).collect()} == {"und"}


def test_texts_in_unlearned_languages_go_and_short_clean_ones_stay(spark):
    stocks = [("en", EN), ("fr", FR), ("de", DE)]
    rows = [(k, prose(k, 12 + k % 30, s), lang) for k, (lang, s) in enumerate(stocks * 40)]
    model = language_id.fit(make(spark, rows), F.lit(True))
    clean = [(1000 + k, prose(1000 + k, 4 + k % 9, s), lang) for k, (lang, s) in enumerate(stocks * 20)]
    foreign = [
        "Дом стоит на берегу реки, и утром в саду тихо и светло",
        "Το σπίτι είναι κοντά στο ποτάμι και το πρωί είναι ήσυχο",
        "今日は天気がいいので川のそばを散歩しました",
        "Talo on joen rannalla ja aamulla puutarhassa hyvin hiljaista ikkunoiden takana",
        "xq zvkj qqwx pfgh jjzk vbnm kxzq wvvx qjkz hgfk zzxq bvkq",
    ]
    kept = {r.doc_id for r in language_id.accepted(make(spark, [*rows, *clean, *((2000 + k, t, None) for k, t in enumerate(foreign))]), model).collect()}
    assert kept == {i for i, _, _ in [*rows, *clean]}


def test_one_language_only_is_predicted(spark):
    found = language_id.identify(make(spark, [(k, prose(k, 20, EN), "en") for k in range(8)])).collect()
    assert {r.lang_pred for r in found} == {"en"}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    terms = ["idiot", "moron", "worthless", "scum"]
    lexicon = toxicity.FuzzyLexicon(dict.fromkeys(terms, 1.0))
    rng = random.Random(3)
    words = set(terms)
    for _ in range(600):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            match rng.randrange(3):
                case 0:
                    w.insert(at, rng.choice("abeimorst1"))
                case 1 if at < len(w):
                    del w[at]
                case 2 if at < len(w):
                    w[at] = rng.choice("abeimorst1")
        words.add("".join(w))
    words = sorted(w for w in words if w)
    text = np.frombuffer(" ".join(words).encode(), "u1")
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    state = lexicon.match(text, starts, lengths)
    for w, s in zip(words, state, strict=True):
        near = [d for t in terms if (d := edit_distance(w, t)) <= toxicity.allowed_edits(t)]
        assert (lexicon.edits[s] if lexicon.edits[s] >= 0 else None) == min(near, default=None), w


def test_stems_take_any_ending():
    lexicon = toxicity.FuzzyLexicon({"lowei*": 1.0})
    x = toxicity.hit_features(["a loweischaft b", "low ei", "loweithatgoesonforverylong" * 400], lexicon)
    assert x[0, 0] == 1 and x[1, 0] == 0 and x[2, 0] == 1


def test_quotation_weakens_a_hit():
    lexicon = toxicity.FuzzyLexicon({"idiot": 1.0})
    x = toxicity.hit_features(["you are an idiot", 'he said "you idiot" to them', None, ""], lexicon)
    assert x[0, 0] == 1 and x[1, 0] < 0.5 and x[1, 4] > 0.8 and not x[2:].any()


def test_typographic_texts_have_the_hits_of_plain_ones():
    lexicon = toxicity.FuzzyLexicon({"idiot": 1.0, "dépravé": 1.0})
    plain = toxicity.hit_features(["you idiot you"], lexicon)[0]
    for text in ("you idiot\u2026 you", "you \u2014idiot\u2014 you", "you idiot\u00a0! you", "you l\u2019idiot you", "you IDI\u00adOT you"):
        assert toxicity.hit_features([text], lexicon)[0, 0] == plain[0] == 1, text
    quoted = toxicity.hit_features(["he said \u201cidiot\u201d to me", "il dit \u00ab\u00a0idiot\u00a0\u00bb ici", "you\u2019re an idiot, you\u2019re one"], lexicon)
    assert (quoted[:2, 0] < 1).all() and (quoted[:2, 0] > 0).all() and (quoted[:2, 4] >= 0.5).all() and quoted[2, 4] == 0
    folded = toxicity.hit_features(["un D\u00c9PRAV\u00c9 ici", "un deprav\u00e9 ici", "un depravi ici"], lexicon)
    assert folded[0, 0] == 1 and 0.7 < folded[1, 0] < 1 and folded[2, 0] == 0
    assert toxicity.words_to_learn("L\u2019IDIOT \u00ab\u00a0D\u00c9PRAV\u00c9\u2026 123 ab idi0t") == ["idiot", "dépravé", "idi0t"]


def test_toxicity_learns_and_leaves_clean_texts(spark, no_docs, null_docs):
    rows, marks = [], []
    for k in range(240):
        bad = k % 4 == 0
        words = prose(k, 40, EN).split()
        if bad:
            words[k % 40] = ["zorgish", "zorgnik", "idiot", "idi0t"][k // 4 % 4]
        rows.append((k, " ".join(words), "en"))
        marks.append((k, 1, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(make(spark, rows), labels).collect()}
    held = [i for i in found if found[i].held_out]
    assert held and all(found[i].predicted == (i % 4 == 0) for i in held)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    empty = toxicity.toxicity(null_docs, labels.limit(0)).collect()
    assert len(empty) == 3 and all(r.predicted == 0 and not r.held_out for r in empty)


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_licenses(text):
    words = LICENSE_WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, base, more, best = [], set(), set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    for b in range(-1, len(words) // 32 + 1):
        block = set(words[max(0, b * 32) : b * 32 + 64])
        for label, texts in license_scan.TEMPLATES.items():
            for t in texts:
                q = set(t.split())
                if len(q & block) >= math.ceil(0.9 * len(q) - 1e-9):
                    more.add(label)
                    best = max(best, len(q & block) / len(q))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best


def test_licenses_match_brute_force(spark, docs, corpus):
    notices = [t for texts in license_scan.TEMPLATES.values() for t in texts]
    extra = [(900 + k, f"{prose(k, 70, EN)} {t.upper()}, {prose(k + 1, 70, EN)}", "en") for k, t in enumerate(notices)]
    extra += [(990, "MIT-License mit license. MIT\nLicense", "en"), (991, "mit " + "word " * 70 + "license", "en"), (992, " ".join(reversed(notices[0].split())), "en")]
    found = license_scan.scan(docs.unionByName(make(spark, extra))).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in found)
    want = Counter()
    for i, t, _ in [*corpus, *extra]:
        x = plain_licenses(t)
        want[(i, *x[:-1], round(x[-1], 9))] += 1
    assert got == want


def test_long_templates_are_found_wherever_they_start(spark):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    templates = {"short": [" ".join(words[:5])], "hundred": [" ".join(words[:100])], "long": [" ".join(words[50:400])]}
    rows = []
    for k in range(40):
        label = ["short", "hundred", "long"][k % 3]
        rows.append((k, f"{prose(k, int(rng.integers(0, 300)), EN)} {templates[label][0]} {prose(k + 90, 120, EN)}", "en"))
    rows.append((90, " ".join(words[10:100]), "en"))  # 90 of a hundred words
    rows.append((91, " ".join(words[11:100]), "en"))
    found = {r.doc_id: r.labels.split(",") for r in license_scan.scan(make(spark, rows), templates=templates).collect()}
    assert all(["short", "hundred", "long"][k % 3] in found[k] for k in range(40))
    assert "hundred" in found[90] and "hundred" not in found[91]


def test_numbers_are_no_letters(spark):
    table = make(spark, [(k, f"{prose(k, 40, EN if k % 2 else FR)}", "en" if k % 2 else "fr") for k in range(40)] + [(90, "½ ² Ⅷ ① 12", "en"), (91, "12 ª", None)])
    found = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert (found[90].lang_pred, found[90].score) == ("und", 0.0) and found[91].lang_pred != "und"


def test_a_sample_is_bounded_and_the_same_each_time(spark):
    from cohortkit.llm.sampling import bounded_sample

    rows = [(k % 500, "a" if k % 10 else "b", f"t{k}") for k in range(3000)] + [(None, "a", "n"), (7, None, "x")]
    frame = spark.createDataFrame(rows, "k long, label string, t string")
    for bound in (1, 40, 400, 5000):
        one, two = (sorted(bounded_sample(f, "label", "k", bound, 3).collect()) if bound else [] for f in (frame.filter("k is not null"), frame.filter("k is not null").repartition(5)))
        assert one == two
        for label, n in (("a", 500 - 50), ("b", 50)):
            mine = [r for r in one if r.label == label]
            assert len(mine) == len({r.k for r in mine}) == min(bound, n)
            assert all(r.t == min(t for k, v, t in rows if (k, v) == (r.k, label)) for r in mine)
    assert bounded_sample(frame.limit(0), "label", "k", 5, 3).count() == 0


def test_licenses_of_empty_and_null_tables(no_docs, null_docs):
    assert license_scan.scan(no_docs).count() == 0
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in license_scan.scan(null_docs).collect()] == [(0, 0, None, "", 0.0)] * 3
