"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every document's statistics become a vector. For each (language, source) the
minimum-covariance-determinant estimate of location and scatter is found over
all of its documents; a vector whose squared Mahalanobis distance exceeds the
chi-square cut is rejected.

Vectors are put in units of their language: less the median, over the median
absolute deviation. Six starts, none of them random, give a first scatter:
independent components, correlations of squashed, clipped, signed and
unit-length vectors, and of the inner half. From each, concentration steps
follow, which never make the determinant greater: the ``KEPT_SHARE`` of
documents with the smallest distances gives the next mean and covariance.
After ``FIRST_STEPS`` the start of least determinant goes on alone. A scatter
whose condition is worse than ``CONDITION`` is mixed with the spread of its
language's components by just so much as mends it. At the end a group's
estimate is weighed with its language's as if that were ``BORROWED``
documents more, so that a small source has an estimate of its own as far as
it goes, and there is no size at which another way is taken.

A step is a quantile and a set of sums by group, both combined before they
are shuffled, so a source with a third of all rows is no larger a task than
any other. What is gathered by group is one row of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstrata.llm.common import written

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
#: The share of documents that an estimate rests on; up to the rest may be outliers.
KEPT_SHARE = 0.75
#: Concentration steps of every start, and further ones of the best.
FIRST_STEPS, STEPS = 2, 2
#: Parts of a group that meet its model apart.
SALTS = 32
#: Documents that the language's estimate counts for in that of a source.
BORROWED = 500
#: The greatest condition number of a scatter.
CONDITION = 50.0
#: The chance that a clean normal vector is rejected. Real ones have heavier tails.
REJECT_P = 1e-9
#: Words at which half of a rate's variance comes from the document's length alone; deviations count by the rest.
WHOLE = 1000.0
#: Words that stand together when repetition is counted.
BLOCK = 50
#: Components of the vector: length, and four rates.
FEATURES = ("log_words", "word_length", "log_others", "repetition", "line_length")
P = len(FEATURES)
#: Relative accuracy of the quantiles, 1 in this many rows of a group.
QUANTILE_ACCURACY = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = b" \t\n\x0b\x0c\r"
#: ASCII characters that are neither letters nor blanks.
_OTHERS = bytes(c for c in range(33, 127) if not chr(c).isalpha())


def counted(text: bytes | None) -> tuple[int, int, int, int, int, int, int, float]:
    """COUNTS of a text, then characters that are no letters, lines with a word, and repetition.

    Its words are the runs of anything but 20 and 09-0D; null has none.
    Repetition is the share of words that are not distinct inside blocks of
    BLOCK words, the last of which ends with the text, so that it does not
    grow with the length.
    """
    words = text.split() if text else ()
    if not words:
        return 0, 0, 0, 0, 0, 0, 0, 0.0
    bare = text.translate(None, _SPACE)
    chars = len(bare) if bare.isascii() else int(np.count_nonzero((np.frombuffer(bare, np.uint8) & 0xC0) != 0x80))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS.encode()))
    others = len(bare) - len(bare.translate(None, _OTHERS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    same_lines = len(lines) - len(set(lines))
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    m = len(number)
    if m == n:
        return n, chars, symbols, same_lines, 0, others, len(lines), 0.0
    size = min(n, BLOCK)
    blocks = ids[: n // size * size].reshape(-1, size)
    if n % size:
        blocks = np.vstack([blocks, ids[-size:]])
    distinct = len(blocks) + int((np.diff(np.sort(blocks, axis=1), axis=1) != 0).sum())
    repetition = 1 - distinct / blocks.size
    repeated = 0
    if n > WINDOW:
        pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1] if m > 2_000_000 else ids[:-1] * m + ids[1:]
        keys = pair[:-1] * m + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        again = np.zeros(n, bool)
        for at in (order[1:][same], order[:-1][same]):
            for k in range(WINDOW):
                again[at + k] = True
        repeated = int(again.sum())
    return n, chars, symbols, same_lines, repeated, others, len(lines), repetition


def _told_apart(docs: DataFrame) -> list[Column]:
    """doc_id, lang, source and digest of the text: rows that agree in these have one verdict."""
    return [docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["source"].cast("string"), F.md5(docs["text"].cast("binary"))]


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lang, source, COUNTS, what else the vector needs, base_failed of every row, and the columns ``more`` of it."""
    names = (*COUNTS, "n_others", "n_lines", "repetition")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*(counted(t) for t in b.column(3).to_pylist()), strict=True)) or [()] * len(names)
            made = [pa.array(x, pa.float64() if c == "repetition" else pa.int64()) for c, x in zip(names, got, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made, *b.columns[4:]], names=["doc_id", "lang", "source", *names, *b.schema.names[4:]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"), *more)
    types = [*(f"{c} {'double' if c == 'repetition' else 'long'}" for c in names), *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[4:])]
    out = rows.mapInArrow(each, ", ".join(["doc_id long, lang string, source string", *types]))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics, in the order of FEATURES."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return [F.log(n), F.col("word_chars") / n, F.log((F.col("n_others") + 0.5) / chars), F.col("repetition"), F.log(n / lines)]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 0
    while term > total * 1e-16:
        i += 1
        term *= z / (a + i)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What a covariance of the inner ``share`` of a normal cloud is multiplied by to be its covariance."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def sound(cov: np.ndarray) -> np.ndarray:
    """``cov`` mixed with the unit matrix by the least share that brings its condition to CONDITION."""
    low, *_, high = np.linalg.eigvalsh(cov).tolist()
    over = high - CONDITION * low
    share = over / (over + CONDITION - 1) if over > 0 else 0.0
    return (1 - share) * cov + share * np.eye(len(cov)) if high > 0 else np.eye(len(cov))


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MODEL = "g string, start int, n long, mu array<double>, cov array<double>, inv array<double>, size double"


def _row(g: str, start: int, n: int, mu: np.ndarray, cov: np.ndarray) -> tuple:
    cov = sound(cov)
    return g, start, n, mu.tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _sums(x: str = "z") -> list[Column]:
    """All that mean and covariance need; they add up over parts of a group."""
    return [F.expr(e) for e in ("count(*) AS n", *(f"sum({x}{i}) AS s{i}" for i in range(P)), *(f"sum({x}{i} * {x}{j}) AS q{i}_{j}" for i, j in _PAIRS))]


def _moments(r: dict) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
    return mean, cov


def _made(sums: DataFrame, make: Callable[[dict], tuple]) -> DataFrame:
    """A model for each row of sums."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([make(r) for r in f.to_dict("records")], columns=["g", "start", "n", "mu", "cov", "inv", "size"])

    return sums.mapInPandas(each, _MODEL)


#: The squared distance of z from a model, as one expression: hundreds of columns put together one by one take the driver seconds.
_DISTANCE = " + ".join(f"{1 if i == j else 2} * inv[{i * P + j}] * (z{i} - mu[{i}]) * (z{j} - mu[{j}])" for i, j in _PAIRS)


def _met(rows: DataFrame, small: DataFrame) -> DataFrame:
    """``rows`` with the rows of ``small`` that their group has.

    ``small`` comes once per salt. A join on the group alone would leave all
    rows of a large group in one task, since the sums by group that follow
    need no further exchange; this way they are combined part by part.
    """
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["g", "salt"]).drop("salt")


def _each(form: str) -> list[str]:
    """An expression for every component: ``#`` stands for its number."""
    return [form.replace("#", str(i)) for i in range(P)]


def _middle(x: str) -> str:
    return f"percentile_approx({x}, 0.5D, {QUANTILE_ACCURACY})"


def _blend(own: str, other: str) -> str:
    """``own`` from n documents and ``other`` as if from BORROWED."""
    return f"(n * {own} + {BORROWED} * {other}) / (n + {BORROWED})"


def in_units(rows: DataFrame) -> DataFrame:
    """``rows`` with z0…: the vector ``x0…`` less the median of its language ``l`` over the deviation there.

    Both are weighed with those of the whole table like any estimate. Where
    the median deviation is 0 the standard deviation stands in, then that of
    the whole table, then 1.
    """
    agg = lambda df, *forms: df.groupBy("g").agg(*[F.expr(e) for e in forms])
    every = lambda t: F.broadcast(t.where("g = '*'").select(*[F.col(c).alias(f"all_{c}") for c in t.columns if c != "g"]))  # noqa: E731  one row
    fit = rows.where("fit").selectExpr("explode(array(l, '*')) AS g", "salt", "w", *_each("x#"))
    middles = written(agg(fit, "count(*) AS n", *_each(f"{_middle('x#')} AS m#")), "middles")
    middles = middles.crossJoin(every(middles)).selectExpr("g", "n", *_each(f"{_blend('m#', 'all_m#')} AS m#"))
    off = ["x0 - m0", *_each("(x# - m#) * w")[1:]]
    spread = agg(_met(fit, middles).selectExpr("g", *[f"{o} AS o{i}" for i, o in enumerate(off)]), *_each(f"coalesce(nullif(pow({_middle('abs(o#)')} * 1.4826D, 2), 0), nullif(var_pop(o#), 0)) AS t#"))
    spread = written(middles.join(spread, "g"), "spread")
    units = spread.crossJoin(every(spread)).selectExpr("g AS l", *_each("m#"), *_each(f"sqrt({_blend('coalesce(t#, all_t#, 1)', 'coalesce(all_t#, 1)')}) AS t#")).where("l <> '*'")
    salted = units.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["l", "salt"], "left").selectExpr(*rows.columns, *[f"({o}) / t{i} AS z{i}" for i, o in enumerate(off)]).drop(*_each("x#"))


def _starts(fit: DataFrame) -> DataFrame:
    """The six first models of every group, about its medians."""
    agg = lambda df, *forms: df.groupBy("g").agg(*[F.expr(e) for e in forms])
    middles = agg(fit, "count(*) AS n", *_each(f"{_middle('z#')} AS m#"))
    middles = written(middles.selectExpr("g", "n", *_each(f"{_blend('m#', '0')} AS m#")), "middles")
    spread = agg(_met(fit, middles.drop("n")), *_each(f"{_middle('abs(z# - m#)')} AS d#"))
    spread = written(middles.join(spread, "g").selectExpr("g", "n", *_each("m#"), *_each(f"sqrt({_blend('pow(d# * 1.4826D, 2)', '1')}) AS d#")), "spread")
    rows = _met(fit, spread.drop("n")).selectExpr("g", *_each("(z# - m#) / d# AS u#"))
    rows = rows.withColumn("r", F.expr(f"sqrt({' + '.join(_each('u# * u#'))})"))
    forms = ["tanh(u#)", "greatest(-1.5D, least(1.5D, u#))", "signum(u#)", "if(r > 0, u# / r, 0D)", "u#"]
    made = [f"struct({k} AS start, {', '.join(_each(f'{form} AS y#'))})" for k, form in enumerate(forms, 1)]
    made[-1] = f"if(r * r <= {chi2_quantile(0.5, P)}D, {made[-1]}, null)"  # the inner half
    sums = rows.selectExpr("g", f"explode(array_compact(array({', '.join(made)}))) AS y").select("g", "y.*").groupBy("g", "start").agg(*_sums("y"))
    plain = spread.selectExpr("g", "0 AS start", "0L AS k", *[f"0D AS {c}" for c in sums.columns[3:]])
    told = sums.withColumnRenamed("n", "k").unionByName(plain).join(spread, "g")

    def make(r: dict) -> tuple:
        corr = np.eye(P)
        if r["k"]:
            _, cov = _moments({**r, "n": r["k"]})
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            both = np.outer(sd, sd)
            corr = np.divide(cov, both, out=np.zeros((P, P)), where=both > 0)
            np.fill_diagonal(corr, 1.0)
        d = np.array([r[f"d{i}"] for i in range(P)])
        return _row(r["g"], r["start"], r["n"], np.array([r[f"m{i}"] for i in range(P)]), corr * np.outer(d, d))

    return written(_made(told, make), "starts")


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    def make(r: dict) -> tuple:
        mean, cov = _moments(r)
        return _row(r["g"], r["start"], r["n"], mean, cov * factor)

    return written(_made(sums, make), "model")


def _concentrated(fit: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """The next model of every group and start, from the ``share`` of its documents nearest by this one."""
    shape = model.select("g", "start", "mu", "inv")
    held = _met(fit, shape).withColumn("d2", F.expr(_DISTANCE))
    cut = held.groupBy("g", "start").agg(F.percentile_approx("d2", F.lit(share), F.lit(QUANTILE_ACCURACY)).alias("cut"))
    near = _met(fit, shape.join(cut, ["g", "start"])).where(F.expr(_DISTANCE) <= F.col("cut"))
    return _estimates(near.groupBy("g", "start").agg(*_sums()), consistency(share))


def estimated(z: DataFrame, share: float = KEPT_SHARE, steps: int = STEPS) -> DataFrame:
    """(g, mu, inv): the estimate of every (language, source) of ``z(l, s, salt, fit, z0…)``, in units of its language."""
    both = F.array("l", F.concat_ws("\x1f", "l", "s"))
    fit = z.where("fit").select(F.explode(both).alias("g"), "salt", *[f"z{i}" for i in range(P)])
    model = _starts(fit)
    for _ in range(FIRST_STEPS):
        model = _concentrated(fit, model, share)
    model = model.groupBy("g").agg(F.min_by(F.struct("start", "mu", "inv"), F.struct("size", "start")).alias("m")).select("g", "m.*")
    for _ in range(steps):
        model = _concentrated(fit, model, share)
    inner = 0.975
    near = _met(fit, model.select("g", "start", "mu", "inv")).where(F.expr(_DISTANCE) <= chi2_quantile(inner, P))
    model = _estimates(near.groupBy("g", "start").agg(*_sums()), consistency(inner))
    names = z.select("l", F.concat_ws("\x1f", "l", "s").alias("g")).distinct()
    own, parent = (model.select(F.col("g").alias(k), *[F.col(c).alias(f"{p}{c}") for c in ("n", "mu", "cov")]) for k, p in (("g", ""), ("l", "l_")))
    told = names.join(own, "g", "left").join(parent, "l", "left")

    def make(r: dict) -> tuple:
        mu, cov = np.zeros(P), np.eye(P)
        for p in ("l_", ""):
            n = r[f"{p}n"]
            if n and n > 0:  # null, or what pandas makes of it, without a document
                mu = (n * np.array(r[f"{p}mu"]) + BORROWED * mu) / (n + BORROWED)
                cov = (n * np.array(r[f"{p}cov"]).reshape(P, P) + BORROWED * cov) / (n + BORROWED)
        return _row(r["g"], 0, 0, mu, cov)

    return written(_made(told.drop("l"), make), "model").select("g", "mu", "inv")


def judged(stats: DataFrame, share: float = KEPT_SHARE, steps: int = STEPS, p: float = REJECT_P) -> DataFrame:
    """``stats`` with d2, the squared robust distance, and kept. d2 is null in a language without a document that passes the base rules."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))  # noqa: E731  a null is a value of its own
    salt = F.pmod(F.xxhash64(F.lit(9), "doc_id", "n_words", "word_chars", "repetition"), F.lit(SALTS)).cast("int")
    weight = F.sqrt(F.col("n_words") / (F.col("n_words") + WHOLE))
    rows = stats.withColumns({"l": part("lang"), "s": part("source"), "fit": ~F.col("base_failed"), "salt": salt, "w": weight, **{f"x{i}": x for i, x in enumerate(vector())}})
    z = written(in_units(written(rows, "vectors")), "vectors")
    known = estimated(z, share, steps)
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = z.withColumn("g", F.concat_ws("\x1f", "l", "s")).join(salted, ["g", "salt"], "left").withColumn("d2", F.expr(_DISTANCE))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(1 - p, P)))


def quality(docs: DataFrame, **parameters) -> DataFrame:
    """Statistics and verdict of every row of ``docs(doc_id, text, lang, source)``.

    A null or empty text has no words and fails. A null language or source is
    a value of its own. Sources of any size have an estimate, weighed with
    their language's. Very long texts are read whole. Repeated rows each count
    and come back, and tied ones have one verdict; an empty table gives none.
    Other columns are not read, whatever their names.
    """
    stats = written(statistics(docs), "statistics")
    return judged(stats, **parameters).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def passed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, unchanged, that are kept, each by its own verdict.

    Verdicts come back by doc_id, language, source and a digest of the text,
    nulls among them; rows that agree in all of these have the same verdict.
    A rejected row goes, whatever becomes of others with its doc_id. Null and
    empty texts go; repeated rows stay or go together; an empty table stays
    empty; columns of any name come back as they were.
    """
    own = _told_apart(docs)
    keep = judged(written(statistics(docs, own[-1].alias("digest")), "statistics"), **parameters).where("kept").select("doc_id", "lang", "source", "digest").distinct().toDF("_id", "_lang", "_source", "_digest")
    same = [mine.eqNullSafe(keep[name]) for mine, name in zip(own, keep.columns, strict=True)]
    return docs.join(keep, reduce(and_, same), "left_semi")
