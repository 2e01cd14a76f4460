"""Fixtures of the training-data operator tests: edge tables and a small mixed corpus."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"


def make(spark, rows):
    """Documents from (doc_id, text, lang), with extra columns whose names operators use themselves."""
    full = [(i, t, lang, f"src{k % 3}", len(t) if t is not None else None, 0.5, "x") for k, (i, t, lang) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int, stock: str) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(stock.split()) + rng.choice(["", "", "", str(rng.randrange(40))]) for _ in range(n))


EN = "the of and to river stone walks house light morning paper under with bright from garden window table slow green for is it that was"
FR = "le la les des une que dans pour rivière pierre maison lumière matin papier sous avec jardin fenêtre lente verte est qui sur au par"
DE = "der die das und fluss stein haus licht morgen papier unter mit garten fenster langsam grün ist nicht auf für im dem ein eine"


@pytest.fixture(scope="session")
def corpus(spark):
    """Sixty texts in three languages with exact copies, near copies, nulls, empty and very long texts."""
    rows = []
    for k, (lang, stock) in enumerate([("en", EN), ("fr", FR), ("de", DE)] * 14):
        rows.append((k, prose(k, 60 + 11 * k, stock), lang))
    base = rows[30][1].split()
    rows += [(100 + j, rows[3][1], "en") for j in range(4)]
    rows += [(200 + j, " ".join([*base[:10], f"edit{j}", *base[11:]]), rows[30][2]) for j in range(4)]
    rows += [(300, None, "en"), (301, "", None), (302, " \n\t ", "fr"), (303, "one two", "en"), (303, "one two", "en"), (None, "no id here at all", "en")]
    rows += [(304, "x" * 50_000, None), (305, prose(9, 20_000, EN), "en"), (306, "1234 !!", "en")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def null_docs(spark):
    """All columns null."""
    return spark.createDataFrame([(None,) * 7] * 3, SCHEMA)
