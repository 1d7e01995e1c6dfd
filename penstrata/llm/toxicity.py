"""Toxicity by a factorization machine over hashed terms.

A term is a distinct lower-case word of the whole text, the first letters of
a longer one, or the fact that several distinct words begin so. Terms are hashed, those that tell the
classes apart are kept by a chi-square test on the labelled sample, and a
factorization machine is fitted on them: besides a weight each term has a
vector, and every pair of terms in a text adds the product of their vectors,
so that two terms may mean together what neither means alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstrata.llm.common import bounded_sample, fold, written

#: Hashed terms are of so many bits.
HASH_BITS = 22
#: Letters of the beginnings that are terms, and numbers of distinct words with one that make a further term.
PREFIXES, SEVERAL = (4, 5), (2, 4)
#: Expected labelled documents per class that the model is fitted on. The bound of the sample.
PER_CLASS = 8000
#: Terms kept, and what each must show: documents with it, and chi-square with one degree of freedom.
MOST_TERMS, LEAST_DOCS, LEAST_CHI2 = 16384, 3, 10.83
FACTORS = 4
ROUNDS = 250
#: Where a document counts as toxic.
CUT = 0.7
#: Words whose terms a Python worker keeps; beyond it the memory is emptied, results stay the same.
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def _hash(word: str, kind: int) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(word.encode("utf-8", "replace"), kind) >> (32 - HASH_BITS)


def _several(beginning: int, n: int) -> int:
    """The term that says that ``n`` distinct words have this beginning."""
    return (beginning * 0x9E3779B1 + n * 0x85EBCA6B) % (1 << HASH_BITS)


class Terms:
    """Terms of whole texts; with ``only``, which maps hashes to columns, the columns of those that count."""

    def __init__(self, only: dict[int, int] | None = None) -> None:
        self.only = only
        self.known: dict[str, tuple[int | None, tuple[int, ...]]] = {}

    def _word(self, w: str) -> tuple[int | None, tuple[int, ...]]:
        own = _hash(w, 1)
        begins = tuple(_hash(w[:k], k) for k in PREFIXES if len(w) > k)
        if self.only is not None:
            begins = tuple(b for b in begins if b in self.only or any(_several(b, n) in self.only for n in SEVERAL))
            own = own if own in self.only else None
        self.known[w] = own, begins
        return own, begins

    def of(self, text: str | None) -> set[int]:
        found: set[int | None] = set()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        times: dict[int, int] = {}
        known = self.known
        for w in set(_WORD.findall(text.lower())) if text else ():
            own, begins = known.get(w) or self._word(w)
            if own is not None:
                found.add(own)
            for b in begins:
                times[b] = times.get(b, 0) + 1
        found.update(times)
        found.update(_several(b, n) for b, t in times.items() if t >= SEVERAL[0] for n in SEVERAL if t >= n)
        return found if self.only is None else {self.only[t] for t in found if t in self.only}


class Machine:
    """A fitted factorization machine; a text without terms has the bias alone."""

    def __init__(self, columns: dict[int, int], bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.columns, self.bias, self.weights, self.factors = columns, bias, weights, factors

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        n = np.array([len(r) for r in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), n)
        col = np.fromiter((c for r in rows for c in r), np.int64, int(n.sum()))
        return 1 / (1 + np.exp(-np.clip(self.bias + _raw(row, col, len(rows), self.weights, self.factors)[0], -30, 30)))


def _raw(row: np.ndarray, col: np.ndarray, n: int, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.bincount(row, w[col], n)
    sums = np.stack([np.bincount(row, v[col, f], n) for f in range(v.shape[1])], axis=1) if len(col) else np.zeros((n, v.shape[1]))
    squares = np.bincount(row, (v[col] ** 2).sum(axis=1), n)
    return total + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def fitted(row: np.ndarray, col: np.ndarray, y: np.ndarray, weight: np.ndarray, n_terms: int, columns: dict[int, int], seed: int = 11) -> Machine:
    """Adam on the weighted logistic loss over all rows at once; y 0 or 1."""
    n, share = len(y), float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.0
    if not 0 < share < 1:
        return Machine({}, -30.0 if share == 0 else 30.0, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = weight / weight.sum()
    for t in range(1, ROUNDS + 1):
        b, w, v = params
        raw, sums = _raw(row, col, n, w, v)
        err = (1 / (1 + np.exp(-np.clip(b[0] + raw, -30, 30))) - y) * weight
        at = err[row]
        gw = np.bincount(col, at, n_terms) + 1e-6 * w
        gv = np.stack([np.bincount(col, at * (sums[row, f] - v[col, f]), n_terms) for f in range(FACTORS)], axis=1) + 1e-6 * v
        for i, g in enumerate((np.array([err.sum()]), gw, gv)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - 0.05 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9)
    return Machine(columns, float(params[0][0]), params[1], params[2])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """The model from labelled documents outside the held-out fold.

    About ``per_class`` documents of each class are read, all where there are
    fewer; weights restore the classes' shares. Terms are counted over that
    sample by class; the ``MOST_TERMS`` best and the sample's rows of them
    reach the driver, both of bounded size. An id labelled more than once is
    toxic if any label says so.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y is not null")
    told = told.where(fold(F.col("_id")) != 1).groupBy("_id").agg(F.max(F.when(F.col("_y") > 0, 1).otherwise(0)).alias("_y"))
    sample = bounded_sample(told, "_y", per_class, "_id", groups=2)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            found = [sorted(terms.of(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "terms"])

    seen = written(rows.select("text", "_y").mapInArrow(hashed, "y int, terms array<int>"), "terms")
    classes = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    shares = {r["_y"]: r["count"] for r in told.groupBy("_y").count().collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 or not n0:
        return fitted(np.zeros(0, int), np.zeros(0, int), np.array([1.0 if n1 else 0.0]), np.ones(1), 0, {})
    c = seen.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n0 + n1)
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (float(n0) * float(n1) * (a + b) * (n - a - b))
    best = c.where((a + b >= LEAST_DOCS) & (a + b < n)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(MOST_TERMS)
    columns = {t: i for i, t in enumerate(sorted(r["term"] for r in best.select("term").collect()))}

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cols = [[columns[t] for t in r if t in columns] for r in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(cols, pa.list_(pa.int32()))], names=["y", "cols"])

    got = seen.mapInArrow(narrowed, "y int, cols array<int>").toArrow()
    y = got.column(0).to_numpy().astype(float)
    n_cols = got.column(1).combine_chunks()
    lens = n_cols.value_lengths().to_numpy(zero_copy_only=False)
    weight = np.where(y == 1, shares.get(1, 0) / n1, shares.get(0, 0) / n0)
    return fitted(np.repeat(np.arange(len(y)), lens), n_cols.flatten().to_numpy().astype(np.int64), y, weight, len(columns), columns)


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    The score looks at the text alone. A null or empty text has the model's
    bias; where nothing is labelled, or one class only, the score is 0 or 1
    within 1e-12. A null id is in no fold: held_out false, never learned from.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.columns)
        for b in batches:
            s = model.scores([sorted(terms.of(t)) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")
