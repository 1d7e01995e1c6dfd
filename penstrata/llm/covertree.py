"""Exact top-k inner products by dual-tree search over cover trees.

All vectors, queries among them, are parted by one tree. A cell of too many
vectors takes centres farthest first from a bounded sample of its own, and
each of its vectors goes to the nearest; so levels are added for as long as
cells are large, each a join of the rows with the centres of their cells. A
cell's vectors fall into blocks of bounded size, and every block holds a
cover tree down to leaves of ``LEAF`` vectors: the children of a node are
members picked farthest first, so that they lie at least as far apart as any
child's radius, each with the members nearest to it, the node's own centre
among them.

Queries and data descend together. Of a query node with centre a, radius r,
angle g about a and greatest norm m, and a data node with b, s, h and n, no
score exceeds the least of

    <a, b> + s |a| + r |b| + r s                          (balls)
    m n cos(max(0, angle(a, b) - g - h))                  (cones)
    (m m + n n - max(0, |a - b| - r - s)^2) / 2           (distances)

and a pair whose bound lies below the worst kth score among the node's
queries is pruned. The search has two passes. First every block of queries
meets the data block that lies nearest to it, which gives true scores; then
all pairs of blocks that the descent leaves are searched. Bounds are widened
by ``SLACK``, so that rounding never prunes a tie; scores themselves are
whole numbers and exact.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstrata.llm.common import written

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Expected vectors of a cell that its centres are chosen from, and its children at most. Every vector is indexed.
SAMPLE, CENTRES = 4096, 32
#: Expected vectors of a block of queries or of data at most; larger cells are parted.
QUERY_BLOCK, DATA_BLOCK = 512, 2048
#: Rows of a cell that one task deals to their centres.
DEAL = 16384
#: Levels of cells. Cells larger than a block below them, and those of one vector many times, have many blocks.
LEVELS = 12
#: Children of a node, and vectors of a leaf at most, in a block's tree.
FAN, LEAF = 8, 64
#: Blocks of one cell that are summed up together.
MERGED = 256
#: Pairs of blocks that a task searches, and query blocks that one copy of a data block meets (expected).
PAIRS, MEETS = 16, 256
#: Widening of a bound, relative to the greatest norms.
SLACK = 1e-6
#: Beyond this magnitude products would not be exact in doubles; such vectors are compared in Python's whole numbers.
EXACT = 1 << 21


def _unit_angle(dot: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Angles; a zero vector is at right angles to all, for its products are 0."""
    both = na * nb
    return np.arccos(np.clip(np.divide(dot, both, out=np.zeros_like(dot, float), where=both > 0), -1, 1))


class Nodes:
    """Centres with radius, angle, and greatest and least norm of what lies below each."""

    def __init__(self, at: np.ndarray, radius: np.ndarray, angle: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        self.at, self.radius, self.angle, self.high, self.low = at.astype(float), radius, angle, high, low
        self.norm = np.sqrt((self.at**2).sum(axis=1))

    def __getitem__(self, i) -> Nodes:
        return Nodes(self.at[i], self.radius[i], self.angle[i], self.high[i], self.low[i])


def bound(a: Nodes, b: Nodes) -> np.ndarray:
    """Upper bounds of the scores between the nodes of two lists, all with all."""
    dot = a.at @ b.at.T
    ball = dot + np.outer(a.norm, b.radius) + np.outer(a.radius, b.norm) + np.outer(a.radius, b.radius)
    open_ = _unit_angle(dot, a.norm[:, None], b.norm[None, :]) - a.angle[:, None] - b.angle[None, :]
    c = np.cos(np.clip(open_, 0, np.pi))
    most = np.outer(a.high, b.high)
    cone = np.where(c >= 0, most, np.outer(a.low, b.low)) * c
    apart = np.sqrt(np.maximum(0, (a.norm**2)[:, None] + (b.norm**2)[None, :] - 2 * dot)) - a.radius[:, None] - b.radius[None, :]
    norms = ((a.high**2)[:, None] + (b.high**2)[None, :] - np.maximum(0, apart) ** 2) / 2
    return np.minimum(np.minimum(ball, cone), norms) + SLACK * (1 + most + (a.high**2)[:, None] + (b.high**2)[None, :])


def farthest_first(x: np.ndarray, first: int, most: int) -> tuple[list[int], np.ndarray]:
    """At most ``most`` rows, each the farthest from those before it, and of every row the number of the nearest; fewer once all are reached."""
    near = ((x - x[first]) ** 2).sum(axis=1)
    to, chosen = np.zeros(len(x), np.int64), [first]
    while len(chosen) < most and near.max(initial=0) > 0:
        c = int(np.argmax(near))
        d = ((x - x[c]) ** 2).sum(axis=1)
        closer = d < near
        near[closer], to[closer] = d[closer], len(chosen)
        chosen.append(c)
    return chosen, to


class Tree:
    """A cover tree over the rows of ``x``, in arrays; node 0 is the root.

    ``order`` lists rows so that each node owns the run ``lo..hi``; ``kids``
    holds the run of a node's children (empty for a leaf). Nodes split until
    they hold ``leaf`` rows at most, or one vector many times.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        n = len(x)
        self.order = np.arange(n)
        f = x.astype(float)
        norm = np.sqrt((f**2).sum(axis=1))
        made: list[tuple[int, float, float, float, float]] = []
        lo, hi, kids = [], [], []

        def add(c: int, a: int, b: int) -> int:
            own = self.order[a:b]
            d = np.sqrt(((f[own] - f[c]) ** 2).sum(axis=1))
            made.append((c, float(d.max()), float(_unit_angle(f[own] @ f[c], norm[own], norm[c]).max()), float(norm[own].max()), float(norm[own].min())))
            lo.append(a)
            hi.append(b)
            kids.append((0, 0))
            return len(made) - 1

        todo = [add(int(np.argmin(((f - f.mean(axis=0)) ** 2).sum(axis=1))), 0, n)] if n else []
        while todo:
            at = todo.pop()
            a, b = lo[at], hi[at]
            if b - a <= leaf or made[at][1] == 0:
                continue
            own = self.order[a:b].copy()
            chosen, to = farthest_first(f[own], int(np.flatnonzero(own == made[at][0])[0]), fan)
            self.order[a:b] = own[np.argsort(to, kind="stable")]
            ends = a + np.searchsorted(np.sort(to), np.arange(len(chosen) + 1))
            first = len(made)
            for i, c in enumerate(chosen):
                todo.append(add(int(own[c]), int(ends[i]), int(ends[i + 1])))
            kids[at] = (first, len(made))
        self.lo, self.hi, self.kids = np.array(lo, np.int64), np.array(hi, np.int64), np.array(kids, np.int64).reshape(-1, 2)
        table = np.array(made, float).reshape(-1, 5)
        self.centre, self.told = table[:, 0].astype(np.int64), table[:, 1:]
        self.stand_on(x)

    def stand_on(self, x: np.ndarray) -> Tree:
        self.nodes = Nodes(x[self.centre], *self.told.T)
        return self

    def stored(self) -> bytes:
        """Without the coordinates, which its block holds."""
        return pickle.dumps({k: v for k, v in vars(self).items() if k != "nodes"})

    @staticmethod
    def loaded(stored: bytes, x: np.ndarray) -> Tree:
        tree = object.__new__(Tree)
        vars(tree).update(pickle.loads(stored))
        return tree.stand_on(x)

    @property
    def leaves(self) -> int:
        return int((self.kids[:, 0] == self.kids[:, 1]).sum())


class Best:
    """The k best so far of each query, by score and then by smaller id; ``row`` tells equal ids apart."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.row = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.known = np.full(n, -np.inf) if worst is None else worst

    def worst(self) -> np.ndarray:
        kth = self.score[:, -1].astype(float)
        kth[self.score[:, -1] == np.iinfo(np.int64).min] = -np.inf
        return np.maximum(kth, self.known)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray, real: np.ndarray) -> None:
        low, top = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        s = np.concatenate([self.score[rows], np.where(real, score, low)], axis=1)
        i = np.concatenate([self.id[rows], np.where(real, np.broadcast_to(ids, score.shape), top)], axis=1)
        r = np.concatenate([self.row[rows], np.where(real, np.broadcast_to(keys, score.shape), top)], axis=1)
        if s.shape[1] > 4 * self.k:  # of each row only what reaches its kth score matters
            kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            width = int((s >= kth[:, None]).sum(axis=1).max())
            if width < s.shape[1]:
                keep = np.argsort(s < kth[:, None], axis=1, kind="stable")[:, :width]
                s, i, r = (np.take_along_axis(t, keep, 1) for t in (s, i, r))
        by = np.lexsort((r, i, ~s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows], self.row[rows] = (np.take_along_axis(t, by, 1) for t in (s, i, r))


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, those beyond their range at its ends."""
    if max(np.abs(q).max(initial=0), np.abs(p).max(initial=0)) <= EXACT and q.shape[1] < 2048:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    top = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ p.astype(object).T, top.min + 1, top.max).astype(np.int64)


def search(q: np.ndarray, q_keys: np.ndarray, qt: Tree, p: np.ndarray, p_ids: np.ndarray, p_keys: np.ndarray, pt: Tree, best: Best) -> tuple[int, int]:
    """Offer to ``best`` all of ``p`` that may be among a query's k; the numbers of leaf pairs scored and of all.

    The descent is by levels: the bounds of all pairs of nodes at hand come at
    once, and both nodes of a pair that is left are replaced by their children.
    The data leaves left to a query leaf are scored in two goes, the one of
    greatest bound first, since its scores prune among the others.
    """
    if not len(q) or not len(p):
        return 0, 0
    below = lambda t, a: list(range(*t.kids[a])) if t.kids[a, 0] < t.kids[a, 1] else [a]
    left: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(1, np.int64), np.full(1, np.inf))}
    while True:
        deep = any(qt.kids[a, 0] < qt.kids[a, 1] for a in left) or any((pt.kids[b, 0] < pt.kids[b, 1]).any() for b, _ in left.values())
        if not deep:
            break
        after: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        worst = best.worst()
        for a, (bs, _) in left.items():
            kids = below(qt, a)
            to = np.array([x for b in bs.tolist() for x in below(pt, b)], np.int64)
            top = bound(qt.nodes[np.array(kids)], pt.nodes[to])
            for i, x in enumerate(kids):
                keep = top[i] >= worst[qt.order[qt.lo[x] : qt.hi[x]]].min()
                if keep.any():
                    after[x] = to[keep], top[i][keep]
        left = after
    scored = 0
    for a, (bs, tops) in left.items():
        rows = qt.order[qt.lo[a] : qt.hi[a]]
        by = np.argsort(-tops, kind="stable")
        for some in (by[:1], by[1:]):
            some = some[tops[some] >= best.worst()[rows].min()]
            if len(some):
                cols = np.concatenate([pt.order[pt.lo[b] : pt.hi[b]] for b in bs[some].tolist()])
                best.offer(rows, products(q[rows], p[cols]), p_ids[cols], p_keys[cols], q_keys[rows][:, None] != p_keys[cols][None, :])
                scored += len(some)
    return scored, qt.leaves * pt.leaves


def scaled(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): components times SCALE, rounded down, and a number that tells rows of one id apart.

    Null ids, null vectors and vectors that hold a null or a component that is
    not finite take no part. An empty vector does; its products are 0.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~bad)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda e: F.floor(e * float(SCALE)).cast("long")).alias("v"))


def _matrix(v: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of the width, else of the widest; shorter ones end in zeros, longer ones are cut."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    n = v.value_lengths().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0)) if width is None else width
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    for i, (a, b) in enumerate(zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True)):
        out[i, : min(width, b - a)] = flat[a : min(b, a + width)]
    return out


def _share(key: str, seed: int, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), parts).cast("int")


def parted(rows: DataFrame, size: int = DATA_BLOCK, sample: int = SAMPLE, fan: int = CENTRES) -> DataFrame:
    """``rows`` with ``cell``, the path of centres that lead to each; cells of more than ``size`` rows are parted further.

    A cell takes as many centres as leave its children half full, ``fan`` at most.
    A cell that is one vector many times ends in ``!`` and stays. Rows of a
    large cell are dealt to their centres by many tasks, which a salt parts.
    """
    now = rows.withColumn("cell", F.lit(""))
    for level in range(LEVELS):
        big = now.where(~F.col("cell").endswith("!")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > size)
        if big.isEmpty():
            break
        big = written(big, "big")
        held = now.join(big, "cell")
        some = held.where(F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(1 << 30)) < F.lit(float(sample) * (1 << 30)) / F.col("n"))

        def choose(t: pa.Table) -> pa.Table:
            t = t.sort_by("row")
            x = _matrix(t.column("v")).astype(float)
            n = t.column("n")[0].as_py()
            chosen, _ = farthest_first(x, int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))), min(fan, max(2, -(-2 * n // size))))
            v = t.column("v").combine_chunks().take(pa.array(chosen))
            return pa.table({"cell": [t.column("cell")[0].as_py()], "n": [n], "centres": pa.array([v.to_pylist()], pa.list_(pa.list_(pa.int64())))})

        centres = written(some.select("cell", "n", "row", "v").groupBy("cell").applyInArrow(choose, "cell string, n long, centres array<array<bigint>>"), "centres")
        parts = F.ceil(F.col("n") / DEAL).cast("long")
        left = held.select("cell", _share("row", 101 + level, parts).alias("salt"), "row", "vec_id", "v")
        right = centres.select("cell", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("salt"), "centres")

        def deal(t: pa.Table, c: pa.Table) -> pa.Table:
            if not len(t):
                return pa.table({"row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.int64())), "cell": pa.array([], pa.string())})
            cell = t.column("cell")[0].as_py()
            names = [f"{cell}!"] * len(t)
            if len(c) and len(c.column("centres")[0]) > 1:
                at = _matrix(pa.array(c.column("centres")[0].as_py(), pa.list_(pa.int64())))
                x = _matrix(t.column("v"))
                width = max(at.shape[1], x.shape[1])
                x, at = (np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(float) for m in (x, at))
                to = np.argmin((at**2).sum(axis=1)[None, :] - 2 * (x @ at.T), axis=1)
                names = [f"{cell}{i}/" for i in to.tolist()]
            return pa.table({"row": t.column("row"), "vec_id": t.column("vec_id"), "v": t.column("v"), "cell": pa.array(names, pa.string())})

        dealt = left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(deal, "row long, vec_id long, v array<bigint>, cell string")
        now = written(now.join(big, "cell", "left_anti").select("row", "vec_id", "v", "cell").unionByName(dealt), "cells")
    return now


_SUM = "centre array<double>, radius double, angle double, high double, low double"
_BLOCK = f"cell string, s int, ids binary, keys binary, x binary, n int, width int, bits int, tree binary, {_SUM}"


def _summary(t: Nodes) -> dict:
    return {"centre": pa.array([t.at[0].tolist()], pa.list_(pa.float64())), "radius": [float(t.radius[0])], "angle": [float(t.angle[0])], "high": [float(t.high[0])], "low": [float(t.low[0])]}


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block: ids, components in the narrowest integers, the tree, and its root's bounds. A cell with many vectors has many blocks."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    keyed = rows.join(counts, "cell").select("cell", _share("row", 5, F.col("parts")).alias("s"), "row", "vec_id", "v")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        x = _matrix(t.column("v"))
        bits = next(b for b in (16, 32, 64) if b == 64 or np.abs(x).max(initial=0) < 1 << (b - 1))
        tree = Tree(x)
        number = lambda c: t.column(c).to_numpy().astype(np.int64).tobytes()
        return pa.table({
            "cell": [t.column("cell")[0].as_py()], "s": pa.array([t.column("s")[0].as_py()], pa.int32()), "ids": [number("vec_id")], "keys": [number("row")], "x": [x.astype(f"i{bits // 8}").tobytes()],
            "n": pa.array([len(x)], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()), "bits": pa.array([bits], pa.int32()), "tree": [tree.stored()], **_summary(tree.nodes),
        })

    return keyed.groupBy("cell", "s").applyInArrow(pack, _BLOCK)


def _unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tree]:
    x = np.frombuffer(r["x"], f"i{r['bits'] // 8}").reshape(r["n"], r["width"]).astype(np.int64)
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.int64), x, Tree.loaded(r["tree"], x)


def _merged(nodes: DataFrame, *by: str) -> DataFrame:
    """One node over all of the same ``by``: it stands on one of their centres and reaches all that they reach."""

    def each(t: pa.Table) -> pa.Table:
        at = [np.array(c, float) for c in t.column("centre").to_pylist()]
        x = np.zeros((len(at), max(map(len, at))))
        for i, c in enumerate(at):
            x[i, : len(c)] = c
        n = Nodes(x, *(t.column(c).to_numpy() for c in ("radius", "angle", "high", "low")))
        mid = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        reach = (np.sqrt(((x - x[mid]) ** 2).sum(axis=1)) + n.radius).max()
        turn = min(np.pi, (_unit_angle(x @ x[mid], n.norm, n.norm[mid]) + n.angle).max())
        one = Nodes(x[mid : mid + 1], *(np.array([v]) for v in (reach, turn, n.high.max(), n.low.min())))
        return pa.table({**{k: pa.array([t.column(k)[0].as_py()], t.schema.field(k).type) for k in by}, **_summary(one)})

    types = ", ".join(f"{k} {dict(nodes.dtypes)[k]}" for k in by)
    return nodes.select(*by, "centre", "radius", "angle", "high", "low").groupBy(*by).applyInArrow(each, f"{types}, {_SUM}")


def _prefix(level: int) -> Column:
    """The node that stands for a cell at a level: the beginning of its path, or itself above its own level."""
    path = F.split("cell", "/")
    return F.when(F.size(path) - 1 <= level, F.col("cell")).otherwise(F.concat(F.array_join(F.slice(path, 1, level), "/"), F.lit("/" if level else "")))


def _upper(tops: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes of cells by level, from the root down: (cell, parent, …), the last the cells themselves."""
    some = _merged(tops.withColumn("m", (F.col("s") / MERGED).cast("int")), "cell", "m")
    out = [written(_merged(some, "cell"), "nodes")]
    for level in range(depth - 1, -1, -1):
        out.append(written(_merged(out[-1].withColumn("node", _prefix(level)), "node").withColumnRenamed("node", "cell"), "nodes"))
    return [n.withColumn("parent", _prefix(max(0, level - 1))) for level, n in enumerate(out[::-1])]


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)


def _bounded(pairs: DataFrame) -> DataFrame:
    """``pairs`` of nodes, fields of struct q and struct d, with ``dot`` and ``top``: ``bound`` as built-in expressions."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, e: t + e * e))
    rows = pairs.withColumns({"dot": _dot("q.centre", "d.centre"), "na": norm("q.centre"), "nb": norm("d.centre")})
    dot, na, nb = F.col("dot"), F.col("na"), F.col("nb")
    ball = dot + F.col("d.radius") * na + F.col("q.radius") * nb + F.col("q.radius") * F.col("d.radius")
    cos = F.when(na * nb > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (na * nb)))).otherwise(0.0)
    c = F.cos(F.greatest(F.lit(0.0), F.acos(cos) - F.col("q.angle") - F.col("d.angle")))
    most = F.col("q.high") * F.col("d.high")
    cone = F.when(c >= 0, most * c).otherwise(F.col("q.low") * F.col("d.low") * c)
    squares = F.col("q.high") * F.col("q.high") + F.col("d.high") * F.col("d.high")
    apart = F.greatest(F.lit(0.0), F.sqrt(F.greatest(F.lit(0.0), na * na + nb * nb - 2 * dot)) - F.col("q.radius") - F.col("d.radius"))
    return rows.withColumn("top", F.least(ball, cone, (squares - apart * apart) / 2) + SLACK * (1 + most + squares)).drop("na", "nb")


def descended(q: list[DataFrame], d: list[DataFrame], worst: DataFrame | None = None) -> DataFrame:
    """(qc, qs, pc, ps): pairs of blocks that are left of all; without ``worst`` for each block of queries the nearest one.

    ``q`` and ``d`` are the levels of ``_upper`` and the blocks behind them.
    ``worst(cell, s, least)`` holds the worst kth score of each block of
    queries, null if one has none.
    """
    least = worst.withColumn("least", F.coalesce("least", F.lit(float("-inf")))) if worst is not None else None
    numbers = ["centre", "radius", "angle", "high", "low"]
    left = q[0].select(F.col("cell").alias("qn")).crossJoin(d[0].select(F.col("cell").alias("dn")))  # one root each
    for level in range(1, len(q)):
        last = level == len(q) - 1
        key, up = (["cell", "s"], "cell") if last else (["cell"], "parent")
        a = q[level]
        if least is not None:
            a = a.join(least if last else least.groupBy(_prefix(level).alias("cell")).agg(F.min("least").alias("least")), key)
        a = a.select(F.col(up).alias("qn"), F.struct(*key).alias("qk"), F.struct(*numbers, *(["least"] if least is not None else [])).alias("q"))
        b = d[level].select(F.col(up).alias("dn"), F.struct(*key).alias("dk"), F.struct(*numbers).alias("d"))
        both = _bounded(left.join(a, "qn").join(b, "dn"))
        if least is not None:
            both = both.where(F.col("top") >= F.col("q.least")).select("qk", "dk")
        else:
            both = both.groupBy("qk").agg(F.max_by("dk", F.struct("dot", "dk")).alias("dk"))
        left = both if last else written(both.select(F.col("qk.cell").alias("qn"), F.col("dk.cell").alias("dn")), "pairs")
    return left.select(F.col("qk.cell").alias("qc"), F.col("qk.s").alias("qs"), F.col("dk.cell").alias("pc"), F.col("dk.s").alias("ps"))


def met(q: DataFrame, p: DataFrame, pairs: DataFrame, k: int, worst: DataFrame | None = None, told=None) -> DataFrame:
    """(query_row, query_id, row, vec_id, score): candidates of each query from all blocks that ``pairs(qc, qs, pc, ps)`` names.

    Blocks meet one pair at a time. ``worst(qc, qs, known)`` gives for each
    query of a block the kth score that is known already. A row here is a
    pair of blocks, some 100,000 scores, and rows are large: a plain function
    takes them a hundred at a time at most, where Arrow would gather 10,000.
    ``told`` is a pair of accumulators for leaf pairs, scored and all.
    """
    block = F.struct("ids", "keys", "x", "n", "width", "bits", "tree")
    left = q.select(F.col("cell").alias("qc"), F.col("s").alias("qs"), block.alias("q"))
    left = left.join(worst, ["qc", "qs"]) if worst is not None else left.withColumn("known", F.lit(None).cast("binary"))
    right = p.select(F.col("cell").alias("pc"), F.col("s").alias("ps"), block.alias("p"))

    @F.udf("array<struct<query_row: long, query_id: long, row: long, vec_id: long, score: long>>", useArrow=False)
    def meet(q, p, known):
        q_ids, q_keys, qx, qt = _unpacked(q)
        p_ids, p_keys, px, pt = _unpacked(p)
        width = max(qx.shape[1], px.shape[1])
        qx, px = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (qx, px))
        found = Best(len(qx), k, np.frombuffer(bytes(known), float).copy() if known is not None else None)
        n = search(qx, q_keys, qt.stand_on(qx), px, p_ids, p_keys, pt.stand_on(px), found)
        if told is not None:
            for counter, x in zip(told, n, strict=True):
                counter.add(x)
        at, col = np.nonzero(found.score != np.iinfo(np.int64).min)
        return list(zip(*(x.tolist() for x in (q_keys[at], q_ids[at], found.row[at, col], found.id[at, col], found.score[at, col])), strict=True))

    # tasks by the number of pairs, for the sizes of the tables tell nothing of the work; a data block that most queries meet goes to several
    tasks, salts = -(-max(1, pairs.count()) // PAIRS), -(-max(1, q.count()) // MEETS)
    salted = pairs.join(left, ["qc", "qs"]).withColumn("salt", F.pmod(F.xxhash64("qc", "qs"), F.lit(salts)).cast("int"))
    both = salted.repartition(tasks, "pc", "ps", "salt").join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(tasks, "pc", "ps", "salt"), ["pc", "ps", "salt"])
    return both.select(F.explode(meet("q", "p", "known")).alias("m")).select("m.*")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, told=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of every row whose id is divisible by ``every``.

    Candidates are all rows but the query's own; rows that share an id are
    rows of their own, as queries and as candidates. Ties go to the smaller
    id; where there are fewer than k candidates, all come back. What takes no
    part is as in ``scaled``; an empty table gives none. Vectors of different
    lengths compare as if the shorter ended in zeros. Other columns are not
    read. No candidate is left out: only pairs whose bound lies below a known
    kth score are. ``told``, two accumulators, counts the pairs of leaves
    scored and all that the blocks met hold.
    """
    spark = vectors.sparkSession
    rows = parted(written(scaled(vectors), "scaled"), DATA_BLOCK, SAMPLE, CENTRES)
    asked = rows.where(F.col("vec_id") % every == 0)
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    depth = rows.agg(F.max(F.size(F.split("cell", "/")) - 1)).first()[0]
    p = written(blocks(rows, DATA_BLOCK), "data")
    q = written(blocks(asked, QUERY_BLOCK), "queries")
    tops = lambda b: b.select("cell", "s", "centre", "radius", "angle", "high", "low")
    levels = [[*_upper(tops(b), depth), tops(b)] for b in (q, p)]
    first = written(descended(*levels), "first")
    some = written(ranked(met(q, p, first, k, told=told), k), "found")
    # the kth score of each query, or none yet
    kth = some.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("kth"))
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("parts"))
    placed = written(asked.join(parts, "cell").select("cell", _share("row", 5, F.col("parts")).alias("s"), "row").join(kth, "row", "left"), "placed")
    worst = placed.groupBy("cell", "s").agg(F.when(F.count("kth") == F.count("*"), F.min("kth")).alias("least"))

    def known(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        kth = np.array([-np.inf if x is None else x for x in t.column("kth").to_pylist()])
        return pa.table({"qc": [t.column("cell")[0].as_py()], "qs": pa.array([t.column("s")[0].as_py()], pa.int32()), "known": [kth.tobytes()]})

    at = placed.groupBy("cell", "s").applyInArrow(known, "qc string, qs int, known binary")
    rest = written(descended(*levels, worst).join(first, ["qc", "qs", "pc", "ps"], "left_anti"), "pairs")
    found = some.drop("rank").unionByName(met(q, p, rest, k, at, told))
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
