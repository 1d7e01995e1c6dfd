"""Packing by optimal length buckets.

The histogram of lengths of the whole table decides the buckets: dynamic
programming over its distinct lengths picks at most ``buckets`` boundaries
such that padding every document to the boundary at or above its length adds
the fewest tokens. Inside a bucket, batches of equal padded length hold as
many documents as a token budget allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstrata.llm.common import written

BUCKETS = 16
#: Padded tokens of a batch; a document longer than it is a batch of its own.
BUDGET = 16384
#: Distinct lengths that the dynamic program turns from arrays into Python's numbers at a time. It takes all of them, however many.
MOST_LENGTHS = 1 << 16


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The boundaries of least padding, ascending; the last is the greatest length.

    ``lengths`` are distinct, ascending. With ``best[j]`` the least padding of
    the first j lengths, one more bucket ending at length j costs
    ``L[j] * (C[j] - C[i]) - (T[j] - T[i])`` from i, a line in L[j] for each
    i; slopes fall with i and L[j] rises, so that one sweep over a lower
    envelope finds all minima of a layer.
    """
    d = len(lengths)
    if d == 0:
        return []
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    t = np.concatenate([[0], np.cumsum(lengths * counts, dtype=np.int64)])
    best = np.full(d + 1, -1, np.int64)  # -1: not with so many buckets
    best[0] = 0
    chosen = []
    for _ in range(min(buckets, d)):
        after = np.full(d + 1, -1, np.int64)
        come = np.zeros(d + 1, np.int64)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at = 0
        for lo in range(0, d, MOST_LENGTHS):
            own, nxt = slice(lo, lo + MOST_LENGTHS), slice(lo + 1, lo + 1 + MOST_LENGTHS)
            cost, via = [], []
            for j, x, b, c0, t0, c1, t1 in zip(range(lo + 1, d + 1), *(v.tolist() for v in (lengths[own], best[own], c[own], t[own], c[nxt], t[nxt])), strict=False):
                if b >= 0:
                    m, q = -c0, b + t0
                    while len(hull) >= 2 and (q - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                        hull.pop()
                    hull.append((m, q, j - 1))
                    at = min(at, len(hull) - 1)
                if not hull:
                    cost.append(-1)
                    via.append(0)
                    continue
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                cost.append(x * c1 - t1 + hull[at][0] * x + hull[at][1])
                via.append(hull[at][2])
            after[nxt], come[nxt] = cost, via
        chosen.append(come)
        best = after
    out, j = [], d
    for come in reversed(chosen):
        out.append(int(lengths[j - 1]))
        j = int(come[j])
    return out[::-1]


def histogram(sizes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All distinct lengths of ``sizes(n_tokens)``, ascending, and their counts.

    They reach the driver as arrays of numbers. There are few: d different
    lengths take d * d / 2 tokens at least, so 10^10 tokens have at most
    141,421 and 10^12 at most 1,414,213.
    """
    rows = sizes.groupBy("n_tokens").count().toArrow()
    n, counts = (rows.column(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(n)
    return n[order], counts[order]


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): the words of the whole text, runs of anything but 20 and 09-0D, and an end; 1 for null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) + 1 if t else 1 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long")


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded, batch, slot) of every row.

    Buckets are numbered from 0 by length and ``padded`` is the boundary.
    Inside a bucket rows stand in the order of length and doc_id (null
    first); ``batch`` numbers the runs of ``max(1, budget // padded)`` of
    them, ``slot`` the places in a run. Ties are equal rows, for which either
    order is the same. A null or empty text has length 1. Repeated rows each
    have a place; an empty table gives none. Other columns are not read.

    Rows are dealt out by ranges of (length, doc_id), so that a bucket with
    most rows is spread over many tasks; each learns the places before its
    own from one small count per task and bucket.
    """
    spark = docs.sparkSession
    sizes = written(lengths(docs), "lengths")
    ends = boundaries(*histogram(sizes), buckets)
    if not ends:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, padded long, batch long, slot int")
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    ranged = sizes.repartitionByRange("n_tokens", "doc_id").sortWithinPartitions("n_tokens", "doc_id")
    dealt = written(ranged.withColumn("bucket", bucket).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "dealt")
    before: dict[tuple[int, int], tuple[int, int]] = {}
    total = [0] * len(ends)
    for r in sorted(dealt.groupBy("part", "bucket").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect(), key=lambda r: r["part"]):
        before[r["part"], r["bucket"]] = (total[r["bucket"]], r["first"])
        total[r["bucket"]] += r["n"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.array(ends, np.int64)
        for b in batches:
            ids, n, k, part, place = b.columns
            k, part, place = k.to_numpy(), part.to_numpy(), place.to_numpy()
            at = np.empty(len(k), np.int64)
            for p, q in {*zip(part.tolist(), k.tolist(), strict=True)}:
                own = (part == p) & (k == q)
                start, first = before[p, q]
                at[own] = start + place[own] - first
            room = np.maximum(1, budget // edge)[k]
            yield pa.RecordBatch.from_arrays([ids, n, pa.array(k.astype(np.int32)), pa.array(edge[k]), pa.array(at // room), pa.array((at % room).astype(np.int32))], names=["doc_id", "n_tokens", "bucket", "padded", "batch", "slot"])

    return dealt.select("doc_id", "n_tokens", "bucket", "part", "place").mapInArrow(number, "doc_id long, n_tokens long, bucket int, padded long, batch long, slot int")
