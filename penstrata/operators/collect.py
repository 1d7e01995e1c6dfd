"""Calibration samples and their drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstrata.functions.text import mask_pii, sha_prefix
from penstrata.session import kept

KIND = "style-calibration-sample"
#: What counts as drift: percentiles in points, shares otherwise.
POINTS, SCORE_SHARE, RULE_SHARE = 15.0, 0.20, 0.10


def samples(docs: DataFrame | None, rows: DataFrame, profile: str, month: str, label: str = "hit") -> DataFrame:
    """(type, time, label, profile, text, text_sha256, score, findings, n_chars) of ``docs`` and their analysed ``rows``; the text is masked first. Rows that bring their ``texts`` need no ``docs``, which are then not read again."""
    of = ("index", "n_chars", "rule_ids")
    if "texts" in rows.columns:
        both = rows.select("doc_id", F.explode("texts").alias("t"), *of).select("doc_id", "t.text", *of)
    else:
        both = docs.select("doc_id", "text").join(rows.select("doc_id", *of), "doc_id")
    out = both.withColumn("text", mask_pii(F.col("text")))
    return out.select(
        "doc_id", F.lit(KIND).alias("type"), F.lit(month).alias("time"), F.lit(label).alias("label"), F.lit(profile).alias("profile"), "text", sha_prefix(F.col("text")).alias("text_sha256"),
        F.bround("index", 0).cast("int").alias("score"), F.col("rule_ids").alias("findings"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def bin_of(value: Column) -> Column:
    """A bin that rises with the value, some 40 for each doubling: the same whoever computes it."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 64).cast("long")


def below(h: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """``h`` with below and tied: the sums of ``n`` over the rows of the same ``by`` with a lesser ``value``, and with the same.

    Rows are summed inside bins of the value, bins by their totals, of which
    there are few: a group with most rows is parted by value and never sorted
    in one task. ``h`` should end in an aggregate of one sum: both branches
    then read one exchange.
    """
    binned = h.withColumn("_bin", bin_of(F.col(value).cast("double")))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_bin"]
    totals = binned.groupBy(*keys).agg(F.sum(n).alias("_total")).withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum(n).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum(n).over(inside.rangeBetween(Window.currentRow, Window.currentRow))
    right = totals.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    out = binned.withColumn("tied", tied).withColumn("_upto", upto).join(right, same)
    return out.select(*h.columns, (F.col("_start") + F.col("_upto") - F.col("tied")).alias("below"), "tied")


def ranked_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by…, n, known, percentiles): rows, rows with a value, and the value at position min(floor(known * p), known - 1) of the ascending ones, null where there are none.

    By ranks over a histogram, so that no group is gathered.
    """
    h = rows.groupBy(*by, value).agg(F.count("*").alias("c")).withColumn("k", F.when(F.col(value).isNotNull(), F.col("c")).otherwise(0))
    totals = h.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("k").alias("known"))
    right = totals.select(*[F.col(k).alias(f"_t_{k}") for k in by], "n", "known")
    both = below(h, by, value, "k").join(right, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in by])
    at = lambda p: F.least(F.floor(F.col("known") * F.lit(p)), F.col("known") - 1)
    picks = [F.min(F.when((F.col("below") <= at(p)) & (at(p) < F.col("below") + F.col("k")), F.col(value))).alias(name) for name, p in shares.items()]
    return both.groupBy(*by).agg(F.first("n").alias("n"), F.first("known").alias("known"), *picks)


def drift_groups(rows: DataFrame) -> DataFrame:
    """(profile, month, n, score_rate, p50, p90) by profile and by profile and month; month is ``*`` for a whole profile."""
    both = rows.select("profile", F.explode(F.array("month", F.lit("*"))).alias("month"), "score")
    g = ranked_percentiles(both, ["profile", "month"], "score", {"p50": 0.5, "p90": 0.9})
    return g.select("profile", "month", "n", (F.col("known") / F.col("n")).alias("score_rate"), "p50", "p90")


def _rates(rows: DataFrame) -> DataFrame:
    """Rates by rule; the row whose rule is null stands for all samples of its group, rate 1."""
    both = rows.select("profile", F.explode(F.array("month", F.lit("*"))).alias("month"), F.explode(F.array_append(F.array_distinct("findings"), F.lit(None).cast("string"))).alias("rule_id"))
    k = both.groupBy("profile", "month", "rule_id").agg(F.count("*").alias("k"))
    n = F.max(F.when(F.col("rule_id").isNull(), F.col("k"))).over(Window.partitionBy("profile", "month"))  # a row per rule
    return k.select("profile", "month", "rule_id", (F.col("k") / n).alias("rate"))


def drift_rules(rows: DataFrame) -> DataFrame:
    """(profile, month, rule_id, rate): the share of samples with the rule, of ``rows(profile, month, findings)``."""
    return _rates(rows).where("rule_id is not null")


def drift_signals(rows: DataFrame, old: str, new: str) -> DataFrame:
    """(profile, signal, before, after) of all that moved further than allowed between two months of samples ``rows(profile, month, score, findings)``.

    Profiles must have both months; a rule that the new month lacks is not
    reported.
    """
    some = kept(rows.where(F.col("month").isin(old, new)).select("profile", "month", "score", "findings"))  # read twice: by group and by rule
    at = lambda month, c: F.max(F.when(F.col("month") == month, F.col(c)))
    values = ("score_rate", "p50", "p90")
    g = drift_groups(some).groupBy("profile").agg(at(old, "n").alias("was"), at(new, "n").alias("now"), *[at(m, c).cast("double").alias(f"{p}_{c}") for c in values for m, p in ((old, "o"), (new, "n"))]).where("was > 0 and now > 0")
    most = {"score_rate": SCORE_SHARE, "p50": POINTS, "p90": POINTS}
    moved = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(f"o_{c}").alias("before"), F.col(f"n_{c}").alias("after"), F.lit(most[c]).alias("most")) for c in values]))
    of_groups = g.select("profile", moved.alias("m")).select("profile", "m.*").where("abs(after - before) >= most").drop("most")
    pairs = _rates(some).groupBy("profile", "rule_id").agg(at(old, "rate").alias("before"), at(new, "rate").alias("after"))
    whole = F.max(F.col("rule_id").isNull() & F.col("before").isNotNull() & F.col("after").isNotNull()).over(Window.partitionBy("profile"))
    of_rules = pairs.withColumn("whole", whole).where("whole and rule_id is not null and after is not null")
    of_rules = of_rules.select("profile", F.col("rule_id").alias("signal"), F.coalesce("before", F.lit(0.0)).alias("before"), "after").where(F.abs(F.col("after") - F.col("before")) >= RULE_SHARE)
    return of_groups.unionByName(of_rules)


def save_baseline(rows: DataFrame, path: str) -> None:
    """Statistics of samples, without any text, for a later comparison."""
    drift_groups(rows).write.mode("overwrite").parquet(f"{path}/groups")
    drift_rules(rows).write.mode("overwrite").parquet(f"{path}/rules")


def load_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The groups and the rates of rules that ``save_baseline`` wrote."""
    return spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/rules")
