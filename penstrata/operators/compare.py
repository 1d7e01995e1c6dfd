"""Before and after: rule counts, components, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order in which a diff lists its rows.
STATUS = ("new", "worse", "better", "gone")


def rule_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, rule_id, before, after, status) of rules whose number of findings differs; of two tables of findings."""
    count = lambda df, name: df.groupBy("doc_id", "rule_id").agg(F.count("*").alias(name))
    both = count(before, "before").join(count(after, "after"), ["doc_id", "rule_id"], "full_outer").na.fill(0, ["before", "after"])
    status = F.when(F.col("before") == 0, "new").when(F.col("after") == 0, "gone").when(F.col("after") > F.col("before"), "worse").otherwise("better")
    return both.where("before <> after").withColumn("status", status)


def sorted_diff(rows: DataFrame) -> DataFrame:
    """New rules first, then what got worse, better and went; larger changes first."""
    return rows.orderBy(F.array_position(F.array(*[F.lit(x) for x in STATUS]), F.col("status")), F.desc(F.abs(F.col("after") - F.col("before"))), "rule_id")


def component_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, feature, before, after, delta); a component on one side only counts 0 on the other."""
    a, b = (df.select("doc_id", "feature", F.col("contribution").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return a.join(b, ["doc_id", "feature"], "full_outer").na.fill(0.0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def sorted_batch(rows: DataFrame) -> DataFrame:
    """Highest index first, what has none last."""
    return rows.orderBy(F.col("index").desc_nulls_last(), F.desc("findings"), "doc_id")
