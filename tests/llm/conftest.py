"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, d2 double, _kept_id string, fingerprint string, score string"


def make(spark, rows):
    """A table of (doc_id, text, lang, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, 0, 7, 0.5, "x", "y", "z") for i, t, lang, src in rows], SCHEMA)


def prose(rng, n, stems):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


STEMS = {"en": ["the", "wh", "ing", "th", "and", "ough", "ly"], "de": ["sch", "ein", "ung", "über", "keit", "tz", "der"]}


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(60, 200), STEMS["en" if i % 2 else "de"]), "en" if i % 2 else "de", f"s{i % 3}") for i in range(3, 90)]
    long = prose(rng, 6000, STEMS["en"])
    out += [(100, None, "en", "s0"), (101, "", "en", None), (102, " \n\t ", None, "s1"), (103, long, "en", "s1"), (104, long + " tail", "en", "s1"), (None, "the thing is here", None, None), (3, out[0][1], "en", "s0"), (105, "12 34 !!", "en", "s2"), (106, out[1][1], "de", "s2"), (107, "日本語 テキスト　x  y", "ja", "s2")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
