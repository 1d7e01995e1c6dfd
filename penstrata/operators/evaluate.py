"""Evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstrata.functions.text import PUNCTUATION, chars_in
from penstrata.operators.collect import below, ranked_percentiles
from penstrata.session import kept

#: Bands of length that tables and models are split by.
BANDS = ((300, "short"), (600, "mid"))


def auroc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by…, n_pos, n_neg, auroc): the rank sum with average ranks on ties, null where a side is empty.

    Ranks come from a histogram of scores, summed by bins of the score, so
    that no group is sorted in one task.
    """
    h = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score, F.col(label).cast("long").alias("_y")).agg(F.count("*").alias("n"))
    h = below(h, by, score, "n").withColumn("p", F.col("_y") * F.col("n"))
    g = h.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"), F.sum(F.col("p") * (2 * F.col("below") + F.col("tied") + 1)).alias("t"))
    value = (F.col("t") - F.col("n_pos") * (F.col("n_pos") + 1)) / (2 * F.col("n_pos") * F.col("n_neg"))
    return g.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), value).alias("auroc"))


def threshold_sweep(rows: DataFrame, score: str, label: str, limits: list[float]) -> DataFrame:
    """(threshold, tp, fp, recall, fpr, accuracy) for each of a short list of limits, in one pass."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in limits])).alias("threshold")
    # counts first: a row per score and label, then limits
    c = rows.groupBy(score, label).agg(F.count("*").alias("n")).select(score, label, "n", at)
    hit, pos = F.col(score) >= F.col("threshold"), F.col(label) == 1
    g = c.groupBy("threshold").agg(F.sum(F.when(hit & pos, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(hit & ~pos, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(pos, F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return g.select("threshold", "tp", "fp", (F.col("tp") / F.col("p")).alias("recall"), (F.col("fp") / neg).alias("fpr"), ((F.col("tp") + neg - F.col("fp")) / F.col("n")).alias("accuracy"))


def rule_discrimination(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule_id, share_1, share_0, difference): shares of documents of each class with the rule. ``labels(doc_id, label)``."""
    n = labels.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    d = hits.select("doc_id", "rule_id").distinct().join(labels, "doc_id").groupBy("rule_id").agg(F.sum("label").alias("k1"), F.sum(1 - F.col("label")).alias("k0"))
    one, none = F.col("k1") / F.col("n1"), F.col("k0") / F.col("n0")
    return d.crossJoin(F.broadcast(n)).select("rule_id", one.alias("share_1"), none.alias("share_0"), (one - none).alias("difference"))


def band(n_chars: Column) -> Column:
    """short, mid or long; 600 itself is long."""
    out = F.lit("long")
    for limit, name in reversed(BANDS):
        out = F.when(n_chars < limit, name).otherwise(out)
    return out


def length_tiers(rows: DataFrame, value: str, label: str) -> DataFrame:
    """(band, n, median, n_pos, n_neg, auroc) of one metric by length."""
    banded = kept(rows.select(band(F.col("n_chars")).alias("band"), value, label))  # read twice: for medians and for ranks
    n = ranked_percentiles(banded, ["band"], value, {"median": 0.5}).select("band", "n", "median")
    return n.join(auroc(banded, ["band"], value, label), "band", "left")


def stratified_folds(rows: DataFrame, by: list[str], key: str, folds: int) -> DataFrame:
    """``rows`` with fold: round robin inside each stratum, in the order of a hash of the key.

    Rows are numbered inside the 256 parts of a stratum that the hash begins
    with, and parts by their sizes, so that a stratum is never one task.
    """
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("_part", F.substring("_h", 1, 2))
    keys = [*by, "_part"]
    sizes = hashed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"_r_{k}") for k in keys], before.alias("_start"))
    own = hashed.withColumn("_own", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key)) - 1)
    placed = own.join(starts, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return placed.select(*rows.columns, ((F.col("_start") + F.col("_own")) % folds).cast("int").alias("fold"))


def half_split(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``rows`` with fold 0 (learn) or 1 (held out), half of each class either way, another half for each seed."""
    salted = rows.withColumn("_salted", F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return stratified_folds(salted, [label], "_salted", 2).drop("_salted")


def held_out_auroc(rows: DataFrame, features: list[str], label: str, key: str, seeds: int = 10) -> DataFrame:
    """(seed, n_pos, n_neg, auroc) of models fitted on one half and tried on the other."""
    rows, out = kept(rows.select(key, label, *features)), None
    for seed in range(seeds):
        parts = kept(half_split(rows, label, key, seed))
        held = apply_fit(parts.where("fold = 1"), *logistic_fit(parts.where("fold = 0"), features, label)).withColumn("seed", F.lit(seed))
        out = held if out is None else out.unionByName(held)
    return auroc(out, ["seed"], "fitted", label)


def ablation(rows: DataFrame, label: str, arms: dict[str, list[str]]) -> DataFrame:
    """(arm, n_pos, n_neg, auroc): of a single feature as it is, of several as a fitted model."""
    rows, out = kept(rows.select(label, *dict.fromkeys(f for features in arms.values() for f in features))), None
    for name, features in arms.items():
        score = rows.withColumn("_s", F.col(features[0]).cast("double")) if len(features) == 1 else apply_fit(rows, *logistic_fit(rows, features, label), "_s")
        part = score.select(F.lit(name).alias("arm"), "_s", label)
        out = part if out is None else out.unionByName(part)
    return auroc(out, ["arm"], "_s", label)


def tier_fits(rows: DataFrame, features: list[str], label: str, least: tuple[int, int] = (30, 10)) -> DataFrame:
    """(band, n_pos, n_neg, auroc, reliable): a model for each length band; reliable with at least so many of label 1 and of label 0. A band of one class has no model."""
    banded = kept(rows.select(label, *features, band(F.col("n_chars")).alias("band")))
    out = rows.sparkSession.createDataFrame([], "band string, n_pos long, n_neg long, auroc double, reliable boolean")
    for r in banded.groupBy("band").agg(F.sum(label).alias("p"), F.count("*").alias("n")).orderBy("band").collect():
        own = banded.where(F.col("band") == r["band"])
        if 0 < r["p"] < r["n"]:
            part = auroc(apply_fit(own, *logistic_fit(own, features, label)), ["band"], "fitted", label)
        else:
            part = own.groupBy("band").agg(F.sum(label).cast("long").alias("n_pos"), F.sum(1 - F.col(label)).cast("long").alias("n_neg")).withColumn("auroc", F.lit(None).cast("double"))
        out = out.unionByName(part.withColumn("reliable", (F.col("n_pos") >= least[0]) & (F.col("n_neg") >= least[1])))
    return out


def channels(rows: DataFrame, label: str, channel: str, least: int = 3) -> DataFrame:
    """(channel, n): the channels of label 0 with at least ``least`` rows, which can be left out one at a time."""
    return rows.where(F.col(label) == 0).groupBy(channel).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def leave_one_out(rows: DataFrame, features: list[str], label: str, channel: str, least: int = 3) -> DataFrame:
    """The rows of label 0 of each such channel scored by a model of all the others; those of label 1 by one of all rows."""
    rows = kept(rows)
    known = [r[channel] for r in channels(rows, label, channel, least).orderBy(channel).collect()]
    out = apply_fit(rows.where(F.col(label) == 1), *logistic_fit(rows, features, label))
    for c in known:
        mine = F.col(channel).eqNullSafe(F.lit(c)) & (F.col(label) == 0)
        out = out.unionByName(apply_fit(rows.where(mine), *logistic_fit(rows.where(~mine), features, label)))
    return out


def group_table(rows: DataFrame, by: str, score: str, limit: float = 80.0) -> DataFrame:
    """(by, n, median, p90, share_above, share_below): scores by model or channel; shares at ``limit`` or above, and below it, of those with a score."""
    some = kept(rows.select(by, score)).where(F.col(score).isNotNull())
    shares = some.groupBy(by).agg(F.count_if(F.col(score) >= limit).alias("above"))
    g = ranked_percentiles(some, [by], score, {"median": 0.5, "p90": 0.9}).join(shares, by)
    return g.select(by, "n", "median", "p90", (F.col("above") / F.col("n")).alias("share_above"), ((F.col("n") - F.col("above")) / F.col("n")).alias("share_below"))


def false_positives(rows: DataFrame) -> DataFrame:
    """(n, flagged, findings, rate): of analysed documents written by people, those with a formal finding."""
    found = F.size("rule_ids")
    return rows.agg(F.count("*").alias("n"), F.count_if(found > 0).alias("flagged"), F.sum(found).cast("long").alias("rules")).withColumn("rate", F.col("flagged") / F.col("n"))


def hash_sample(rows: DataFrame, text: str, most: int) -> DataFrame:
    """The first ``most`` rows in the order of a digest of their text: the same ones every time."""
    return rows.orderBy(F.sha2(F.col(text).cast("binary"), 256), *[c for c in rows.columns if c != text][:1]).limit(most)


def sample_per_source(rows: DataFrame, source: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each source, the same ones every time."""
    order = Window.partitionBy(source).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def logistic_fit(rows: DataFrame, features: list[str], label: str, balanced: bool = True):
    """A weighted logistic model (L2 1e-4, standardised); (intercept, {feature: coefficient}) in the features' own units."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = rows.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
    weight = F.when(F.col(label) == 0, F.lit(n["p"] / (n["n"] - n["p"]) if balanced and n["n"] > n["p"] else 1.0)).otherwise(1.0)
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double")))
    m = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-4, elasticNetParam=0.0, standardization=True, maxIter=200).fit(data)
    return m.intercept, dict(zip(features, m.coefficients.toArray().tolist(), strict=True))


def apply_fit(rows: DataFrame, intercept: float, coefs: dict[str, float], name: str = "fitted") -> DataFrame:
    z = F.lit(intercept)
    for f, c in coefs.items():
        z = z + F.lit(c) * F.coalesce(F.col(f), F.lit(0.0))
    return rows.withColumn(name, 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    """Each group's rows scored by a model of all others: k-fold with ``group`` a fold, leave-one-out with a channel. Groups are few."""
    rows, out = kept(rows), None
    for (g,) in rows.select(group).distinct().orderBy(group).collect():
        fit = logistic_fit(rows.where(F.col(group) != g), features, label)
        part = apply_fit(rows.where(F.col(group) == g), *fit)
        out = part if out is None else out.unionByName(part)
    return out


def verdict(frozen: Column, cv: Column, loco: Column, line: float = 0.884) -> Column:
    """keep the frozen model, take one of the genre, or suppress."""
    return F.when(frozen >= line, "keep").when((cv >= line) & (loco >= line), "genre model").otherwise("suppress")


def gate(baseline: Column, now: Column, most: float = 0.05) -> Column:
    return F.when(baseline - now < most, "PASS").otherwise("FAIL")


def unpivoted(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys…, feature, value): one row per feature."""
    arms = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    return rows.selectExpr(*keys, f"stack({len(features)}, {arms}) AS (feature, value)")


def domain_recon(rows: DataFrame, domain: str, label: str, features: list[str]) -> DataFrame:
    """(domain, feature, n_pos, n_neg, auroc) of every single feature in every domain."""
    return auroc(unpivoted(rows, [domain, label], features), [domain, "feature"], "value", label)


def pool_features(lines: DataFrame, pool: str, patterns: dict[str, str]) -> DataFrame:
    """(feature, pool, n, hits): lines of each pool that match, for named patterns."""
    hit = F.array(*[F.struct(F.lit(name).alias("feature"), F.col("text").rlike(p).alias("hit")) for name, p in patterns.items()])
    return lines.select(pool, F.explode(hit).alias("f")).groupBy("f.feature", pool).agg(F.count("*").alias("n"), F.count_if("f.hit").alias("hits"))


def corpus_profile(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, n_chars, p25, p50, p75, mixed, punctuation): texts, characters, quartiles of the length, share of texts with Latin letters and CJK alike, punctuation per thousand characters."""
    length = F.length("text").cast("long")
    mixed = F.col("text").rlike("[A-Za-z]") & F.col("text").rlike("[一-鿿]")
    x = rows.select(by, length.alias("len"), chars_in(F.col("text"), PUNCTUATION).alias("marks"), mixed.alias("mixed"))
    g = x.groupBy(by).agg(F.sum("len").alias("n_chars"), F.sum("marks").alias("marks"), F.count_if("mixed").alias("mixed"))
    p = ranked_percentiles(x, [by], "len", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return g.join(p, by).select(by, "n", "n_chars", "p25", "p50", "p75", (F.col("mixed") / F.col("n")).alias("mixed"), (F.col("marks") * 1000.0 / F.col("n_chars")).alias("punctuation"))
