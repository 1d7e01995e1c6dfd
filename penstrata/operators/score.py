"""The index, its components and the notes on why there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstrata.operators.bydoc import COUNTS, FLAGS, SUMS
from penstrata.operators.domain import kinds
from penstrata.operators.facts import facts, gated_found
from penstrata.operators.rules import doc_rules
from penstrata.operators.segment import ZH, Config
from penstrata.operators.stats import stats_of
from penstrata.packs import Pack

LEAST_SENTENCES = 8
FEATURES = ("hit_density", "sentence_cv", "ttr", "ngram_repeat", "conn_density")


def coefficient(scoring: dict, name: str, n_chars: Column) -> Column:
    """Of the last tier whose least length is reached, else of the whole model; of the genre's own model where there is one."""
    out = F.lit(scoring.get(name))
    for t in scoring.get("tiers", []):
        out = F.when(n_chars >= t["min_chars"], F.lit(t.get(name))).otherwise(out)
    for kind, model in scoring.get("genres", {}).items():
        if not model.get("suppress"):
            out = F.when(F.col("genre") == kind, F.lit(model.get(name))).otherwise(out)
    return out.cast("double")


def genre_of(scoring: dict) -> Column:
    """The first kind that the model has a word on, or null."""
    return F.get(F.filter("kinds", lambda k: k.isin(list(scoring.get("genres", {})))), F.lit(0)) if scoring.get("genres") else F.lit(None).cast("string")


def scored(rows: DataFrame, pack: Pack) -> DataFrame:
    """``rows`` of statistics and hit weight with index and one ``c_`` column per feature, all null where nothing is scored."""
    s = pack.scoring
    if not s:
        none = F.lit(None).cast("double")
        return rows.withColumns({"index": none, **{f"c_{f}": none for f in FEATURES}})
    rows = rows.withColumn("hit_density", F.coalesce("weight", F.lit(0.0)) / F.col("n_sentences"))
    enough = F.col("n_sentences") >= LEAST_SENTENCES
    parts = {f"c_{f}": F.when(enough, coefficient(s, f, F.col("n_chars")) * F.col(f)) for f in FEATURES}
    rows = rows.withColumns(parts)
    z = coefficient(s, "intercept", F.col("n_chars"))
    for f in FEATURES:
        z = z + F.coalesce(F.col(f"c_{f}"), F.lit(0.0))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return rows.withColumn("index", F.when(enough, 100.0 / (1.0 + F.exp(-z))))


def analyzed(docs: DataFrame, pack: Pack, config: Config = ZH, texts: bool = False) -> DataFrame:
    """One row per document with a block: statistics, counts of findings, the rules behind them (``rule_ids``, document rules among them), index, components, domain kinds and a note; with ``texts`` also what it was made of."""
    carried = ["texts"] if texts else []
    s = pack.scoring or {}
    rows = facts(docs, pack, config=config, flags=True, need=(*COUNTS, *SUMS, *FLAGS, "raw", "found", *carried))
    rows = rows.withColumns(kinds(bool(s.get("genre_ood")), pack.name != "official")).withColumn("hits", gated_found(pack))
    count = lambda f: F.size(F.filter("hits", f)).cast("long")
    rows = rows.withColumn("weight", F.aggregate("hits", F.lit(0.0), lambda t, h: t + h["weight"]))
    formal = lambda severity: count(lambda h: (h["severity"] == severity) & ~h["is_hint"])
    rows = rows.withColumns({v: formal(v) for v in ("high", "medium", "low")}).withColumn("hints", count(lambda h: h["is_hint"]))
    local = F.transform(F.filter("hits", lambda h: ~h["is_hint"]), lambda h: h["rule_id"])
    rows = rows.withColumn("rule_ids", local)
    rows = stats_of(rows, pack.lexicon, "weight", "high", "medium", "low", "hints", "rule_ids", "kinds", "non_chinese", "has_content", *carried)
    rows = rows.withColumn("rule_ids", F.array_sort(F.array_union("rule_ids", F.transform(doc_rules(pack), lambda h: h["rule_id"]))))
    rows = scored(rows.withColumn("genre", genre_of(s)), pack)
    suppressed = F.coalesce(F.col("genre").isin([k for k, v in s.get("genres", {}).items() if v.get("suppress")]), F.lit(False))
    no_text = ~F.coalesce("has_content", F.lit(False))
    foreign = F.coalesce("non_chinese", F.lit(False))
    note = F.when(no_text, "no valid text").when(foreign, "not Chinese").when(suppressed, "genre not calibrated")
    if not pack.scoring:
        note = note.when(F.col("n_sentences") >= LEAST_SENTENCES, "profile not calibrated")
    rows = rows.withColumn("note", note)
    keep = F.col("note").isNull()
    return rows.withColumns({c: F.when(keep, F.col(c)) for c in ("index", *(f"c_{f}" for f in FEATURES))}).drop("weight", "non_chinese", "has_content")


def components(rows: DataFrame) -> DataFrame:
    """(doc_id, feature, contribution) of scored documents."""
    arms = ", ".join(f"'{f}', c_{f}" for f in FEATURES)
    return rows.where("index is not null").selectExpr("doc_id", f"stack({len(FEATURES)}, {arms}) AS (feature, contribution)").where("contribution is not null")


def batch_summary(rows: DataFrame) -> DataFrame:
    """A row per document as a batch prints it: the index rounded half to even, counts and sizes."""
    return rows.select("doc_id", F.bround("index", 0).cast("int").alias("index"), "high", "medium", "low", (F.col("high") + F.col("medium") + F.col("low")).alias("findings"), "n_sentences", "n_chars")


def above(rows: DataFrame, limit: float) -> DataFrame:
    """What a gate at ``limit`` stops."""
    return rows.where(F.col("index") > limit)

