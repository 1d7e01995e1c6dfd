"""SimHash fingerprints and their links by multi-index hashing.

Fingerprints link at ``RADIUS`` = 2 or fewer differing bits. The 64 bits fall
into two segments of 32. Two linked fingerprints differ by at most one bit in
the high segment or agree in the low one, so every fingerprint probes the
high table with its ball of radius 1 and the low table with its own value;
complete distances decide. A pair whose high segments differ is found from
the side whose bit is unset, so a ball holds only the values with one more
bit set, and no pair comes up twice.

A bucket that more than ``HOT_BUCKET`` distinct fingerprints share is not
paired up. All fingerprints that are in such a bucket or probe it enumerate
the ball of radius 1 about the whole fingerprint instead: two fingerprints
are within 2 bits exactly if such balls meet. A meeting point has 65
members at most, which link to the least of them. That finds the same
components with 65 rows a fingerprint, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstrata.llm.common import dropped, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Distinct fingerprints in a bucket beyond which its pairs are not listed.
HOT_BUCKET = 64
#: Shingles whose bits are unpacked at a time.
AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the UTF-8 ``text`` as a signed 64-bit integer; zero without a word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space is 09-0D and 20
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-width].tolist()]
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        some = np.array(hashes[at : at + AT_ONCE], np.uint64)
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp) of every row, and the columns ``more`` of it; a null text has no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    return rows.mapInArrow(each, ", ".join(["doc_id long", "fp long", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])]))


def links(fps: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Distinct pairs (a, b), a < b, of distinct fingerprints ``fps(fp)`` that connect all that link."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    tables = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("at")), F.struct(F.lit(1).alias("seg"), low.alias("at")))).alias("k")).select("fp", "k.seg", "k.at")
    ball = F.expr("transform(filter(transform(sequence(0, 31), j -> shiftrightunsigned(fp, 32) | shiftleft(1L, j)), v -> v != shiftrightunsigned(fp, 32)), v -> struct(0 AS seg, v AS at))")
    own = F.array(F.struct(F.lit(0).alias("seg"), high.alias("at")), F.struct(F.lit(1).alias("seg"), low.alias("at")))
    probes = fps.select("fp", F.explode(F.concat(own, ball)).alias("k")).select(F.col("fp").alias("x"), F.col("k.seg").alias("seg"), F.col("k.at").alias("at"))
    crowded = written(tables.groupBy("seg", "at").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("seg", "at"), "crowded")
    some_hot = not crowded.isEmpty()
    cold = tables.join(crowded, ["seg", "at"], "left_anti") if some_hot else tables
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= RADIUS
    same_high = F.shiftrightunsigned("x", 32) == F.shiftrightunsigned("fp", 32)
    once = F.when(F.col("seg") == 1, (F.col("x") < F.col("fp")) & ~same_high).otherwise(~same_high | (F.col("x") < F.col("fp")))
    pairs = probes.join(cold, ["seg", "at"]).where((F.col("x") != F.col("fp")) & near & once)
    found = pairs.select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b"))
    if some_hot:
        flagged = probes.join(crowded, ["seg", "at"], "left_semi").select(F.col("x").alias("fp")).distinct()
        around = flagged.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))")).alias("at"))
        stars = around.groupBy("at").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
        met = stars.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a < b")
        found = found.unionByName(met)
    return found.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component of ``edges(a, b)``, for all nodes with an edge.

    Alternating large-star and small-star steps; each round is written to
    the shared folder, so that lineage stays short. All work is joins and
    minima by node; no list of neighbours is gathered.
    """
    now, before = written(edges.select("a", "b"), "edges"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m"), F.col("b")).where("m < b").distinct()
        # small star: each node's lower neighbours, and itself, to the least of them
        up = large.select(F.col("b").alias("u"), F.col("m").alias("v"))
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(low, "u").select("m", F.explode(F.array("u", "v")).alias("b")).where("m < b")
        after = written(small.select(F.col("m").alias("a"), "b").distinct(), "edges")
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now)
        now = after
        if tuple(told) == before:
            break
        before = tuple(told)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def rooted(nodes: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """``nodes``, one row per distinct ``fp``, with ``root``, the least fingerprint of its component."""
    roots = components(links(nodes.select("fp"), hot))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs(doc_id, text)``.

    component_id is the least doc_id that links reach. Texts that are null or
    hold no word share fingerprint zero and link like any other. Rows with a
    null id link too but name no component, unless all of its ids are null.
    Repeated rows each come back; an empty table gives none. Documents of one
    fingerprint are one node, so a group of copies of any size costs one row.
    """
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    named = rooted(nodes, hot)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: exactly one of each component.

    It is a row of the least doc_id; a component without any id keeps a row
    with a null id. Of rows that share this doc_id the one with the least
    digest of its text stays. Rows are told apart by a number of their own,
    not by doc_id: what an unrelated text with the same id, or with a null
    one, does in its component changes nothing here. Rows are written with
    their numbers first, so that a repeated task meets the same ones.
    """
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    fps = fingerprints(numbered, F.md5(F.col("text").cast("binary")).alias("digest"), F.col(row).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n"))
    nodes = written(fps.groupBy("fp").agg(first.alias("first")), "nodes")
    keep = rooted(nodes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias(row))
    return numbered.join(keep, row, "left_semi").select(*[numbered[f"`{c}`"] for c in docs.columns])
