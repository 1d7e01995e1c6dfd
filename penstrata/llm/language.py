"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams in order. A
document's own list is held against each profile: every n-gram costs the
number of places it is out by, ``N_RANKS`` if the profile lacks it, and the
language of least total distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstrata.llm.common import bounded_sample, fold

#: n-grams in a list, of a document and of a profile.
N_RANKS = 300
#: Expected documents per language that a profile is learned from. The bound of the sample.
PER_LANGUAGE = 4000
#: The answer for a text that is null or has no letter.
UNKNOWN = "und"
#: Labels at most that a profile is learned for, those with most documents: the bound of the model, which goes to every task.
MOST_LANGUAGES = 4096
_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point the number of its lower-case letter, 0 for what is no letter."""
    if not _TABLE:
        codes = np.zeros(0x110000, np.uint64)
        number: dict[str, int] = {}
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                codes[c] = number.setdefault(low if len(low) == 1 else ch, len(number) + 1)
        _TABLE.append(codes)
    return _TABLE[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and counts of the text's letter n-grams, n from 1 to 3; words carry one blank at either end.

    A key holds 18 bits a letter and n above them.
    """
    letters = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    padded = np.concatenate([letters[:0].astype(np.uint64), np.zeros(1, np.uint64), letters, np.zeros(1, np.uint64)])
    keep = (padded != 0) | np.concatenate([[True], padded[:-1] != 0])
    a = padded[keep]
    if len(a) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (a[:-1] << np.uint64(18)) | a[1:]
    three = (two[:-1] << np.uint64(18)) | a[2:]
    keys = np.concatenate([a[a != 0] | np.uint64(1 << 60), two | np.uint64(2 << 60), three[a[1:-1] != 0] | np.uint64(3 << 60)])
    keys.sort()
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], np.diff(np.append(edge, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = N_RANKS) -> np.ndarray:
    """The ``most`` most frequent keys in order; ties go to the smaller key."""
    if len(keys) > 2 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Distances of documents to the profiles of all languages at once."""

    def __init__(self, profiles: dict[str, list[int]], most: int = N_RANKS) -> None:
        self.langs, self.most = sorted(profiles), most
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.uint64))
        self.rank = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.keys, np.array(profiles[lang], np.uint64))] = np.arange(len(profiles[lang]))

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """Out-of-place distances and the largest possible one; None without a letter or a profile."""
        own = ranked(*grams(text), self.most)
        if not len(own) or not self.langs:
            return None
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        place = self.rank[:, at]
        out = np.where(place < 0, self.most, np.abs(place - np.arange(len(own))))
        return out.sum(axis=1), len(own) * self.most

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if text else None
        if found is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(found[0]))
        return self.langs[best], 1.0 - float(found[0][best]) / found[1]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = N_RANKS) -> Profiles:
    """Profiles from the labelled documents outside the held-out fold.

    About ``per_language`` documents of each language are read, all where
    there are fewer, and of more than MOST_LANGUAGES labels, as dirty ones may
    be, those with most documents. Counts of n-grams are summed per partition
    before they meet; ``most`` rows per language reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, n = grams(text)
                total.setdefault(lang, Counter()).update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    sample = bounded_sample(rows, "lang", per_language, "doc_id", groups=MOST_LANGUAGES).select("lang", "text")
    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, most)


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Ties go to the smaller name. A null, empty or letterless text is ``und``
    with score 0, as is every text where nothing was learned. A very long text
    is read whole. A null id is in no fold: never learned from, held_out
    false. Repeated rows each come back, an empty table gives none. Nothing
    but the text is used, and no other column is read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profiles.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, profiles: Profiles, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language with a score above 0 and of ``least`` or more.

    A score of 0 means that the text shares no n-gram with any profile, as one
    in a script that none was learned in; the name that ``predicted`` gives it
    is but the first of all, so it has no language here. Null, empty and
    letterless texts go. Each row is judged by its own text, whatever its id,
    so repeated rows stay or go together; an empty table stays empty, and
    columns of any name come back as they were.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profiles.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score > 0 and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(each, schema)
