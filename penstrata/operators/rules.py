"""Rules against sentences and documents, with the co-occurrence gate.

Patterns are compiled into literal expressions, so that the regex engine
prepares each once; a non-literal pattern column would be compiled per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstrata.operators.bydoc import COUNTS, SUMS
from penstrata.operators.facts import facts, gated_found, per_rule
from penstrata.operators.segment import ZH, Config
from penstrata.operators.stats import stats_of
from penstrata.packs import Pack, Rule

SEVERITY_RANK = {"high": 2, "medium": 1, "low": 0}


def hits_of(rows: DataFrame, pack: Pack) -> DataFrame:
    """(doc_id, para, unit, pos, rule_ord, rule_id, severity, weight, sentence, matches, is_hint) of rows of ``facts``.

    A row for each rule and sentence with content, and for each shape rule
    and paragraph of one short sentence.
    """
    return rows.select("doc_id", F.explode(gated_found(pack)).alias("h")).select("doc_id", "h.*")


def rule_hits(docs: DataFrame, pack: Pack, config: Config = ZH) -> DataFrame:
    """All hits of documents, findings and hints alike."""
    return hits_of(facts(docs, pack, config=config, need=("found",)), pack)


def threshold_of(rule: Rule, n_chars: Column) -> Column:
    """The first tier whose limit lies above the length, else the rule's own threshold."""
    out = F.lit(rule.threshold)
    for limit, value in reversed(rule.tiers):
        out = F.lit(value) if limit is None else F.when(n_chars < limit, F.lit(value)).otherwise(out)
    return out


_DOC = "array<struct<rule_ord: int, rule_id: string, severity: string, metric: string, value: double, threshold: double>>"


def doc_rules(pack: Pack) -> Column:
    """Document rules that hold for a row of statistics; comparison is strict."""
    made = []
    for i, r in enumerate(pack.rules):
        if r.scope == "doc":
            value, limit = F.col(r.metric), threshold_of(r, F.col("n_chars"))
            holds = (F.col("n_sentences") >= r.min_sentences) & (value > limit if r.compare == "above" else value < limit)
            made.append(F.when(holds, F.struct(F.lit(i).alias("rule_ord"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.metric).alias("metric"), value.alias("value"), limit.alias("threshold"))))
    return F.array_compact(F.array(*made)).cast(_DOC) if made else F.array().cast(_DOC)


def doc_findings(stats: DataFrame, pack: Pack) -> DataFrame:
    """(doc_id, rule_ord, rule_id, severity, metric, value, threshold) of document rules that hold."""
    return stats.select("doc_id", F.explode(doc_rules(pack)).alias("h")).select("doc_id", "h.*")


def findings(docs: DataFrame, pack: Pack, config: Config = ZH) -> DataFrame:
    """All findings and hints, document rules with para -1, and ``ord``, the order of a report: severity, place, first hit of the rule."""
    rows = stats_of(facts(docs, pack, config=config, need=(*COUNTS, *SUMS, "found")), pack.lexicon, "found").withColumn("whole", doc_rules(pack))
    rank = lambda s: F.when(s == "high", -2).when(s == "medium", -1).otherwise(0)
    fields = ("para", "unit", "pos", "rule_ord", "rule_id", "severity", "weight", "sentence", "matches", "is_hint")
    told = lambda h: F.array(F.concat(h["metric"], F.lit("="), F.format_string("%.3f", h["value"]), F.lit(" ("), h["threshold"].cast("string"), F.lit(")")))
    none = F.lit(-1)
    local = F.transform(gated_found(pack), lambda h: F.struct(rank(h["severity"]).alias("rank"), *[h[f].alias(f) for f in fields]))
    whole = F.transform("whole", lambda h: F.struct(rank(h["severity"]).alias("rank"), none.alias("para"), none.alias("unit"), none.alias("pos"), h["rule_ord"].alias("rule_ord"), h["rule_id"].alias("rule_id"), h["severity"].alias("severity"), F.lit(0.0).alias("weight"), F.lit("").alias("sentence"), told(h).alias("matches"), F.lit(False).alias("is_hint")))
    return rows.select("doc_id", F.posexplode(F.array_sort(F.concat(local, whole))).alias("ord", "h")).select("doc_id", *[f"h.{f}" for f in fields], (F.col("ord") + 1).alias("ord"))


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or a higher one; applied behind scoring, so that no index moves."""
    keep = [s for s, r in SEVERITY_RANK.items() if r >= SEVERITY_RANK[severity]]
    return found.where(F.col("severity").isin(keep))


def grouped(found: DataFrame) -> DataFrame:
    """(doc_id, para, sentence, ord, top, rule_ids, times, explained): formal findings by sentence, as a report shows them.

    A sentence that stands twice in a paragraph is one group. ``top`` is its
    highest severity, ``rule_ids`` are its rules in order, once each, ``times``
    counts all findings in it, and ``explained`` are the rules that the report
    meets here first, document rules and those of earlier groups apart.
    """
    formal = found.where("not is_hint")
    items = F.array_sort(F.collect_list(F.struct("ord", "rule_id")))
    rank = F.max(F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0))
    first = F.row_number().over(Window.partitionBy("doc_id", "rule_id").orderBy("at", "ord")) == 1
    at = F.min("ord").over(Window.partitionBy("doc_id", "para", "sentence"))
    marked = formal.where("para >= 0").withColumn("at", at).withColumn("new", first)
    g = marked.groupBy("doc_id", "para", "sentence").agg(F.min("ord").alias("ord"), rank.alias("rank"), items.alias("items"), F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("ord", "rule_id")))).alias("fresh"))
    ids = lambda c: F.array_distinct(F.transform(c, lambda x: x["rule_id"]))
    top = F.when(F.col("rank") == 2, "high").when(F.col("rank") == 1, "medium").otherwise("low")
    return g.select("doc_id", "para", "sentence", "ord", top.alias("top"), ids("items").alias("rule_ids"), F.size("items").alias("times"), ids("fresh").alias("explained"))


def first_hints(found: DataFrame, most: int = 12) -> DataFrame:
    """The first hints of each document, as many as a report lists."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    return found.where("is_hint").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def para_heat(rows: DataFrame, pack: Pack) -> DataFrame:
    """(doc_id, para, n_sents, density, level, excerpt) of paragraphs with a hit, of rows of ``facts``."""
    weights = per_rule(pack, "weight")
    weight = lambda q: F.aggregate(F.filter("found", lambda h: h["para"] == q["para"]), F.lit(0.0), lambda t, h: t + F.element_at(weights, h["rule_ord"] + 1))
    hot = F.transform("p", lambda q: F.struct(q["para"].alias("para"), q["n"].alias("n_sents"), weight(q).alias("w"), q["head"].alias("head")))
    rows = rows.select("doc_id", F.explode(F.filter(hot, lambda q: q["w"] > 0)).alias("q")).select("doc_id", "q.*")
    density = F.col("w") / F.col("n_sents")
    level = F.when(density >= 1.0, "high").when(density >= 0.5, "medium").otherwise("low")
    return rows.select("doc_id", "para", "n_sents", density.alias("density"), level.alias("level"), F.substring("head", 1, 16).alias("excerpt"))


def with_prose(found: DataFrame, pack: Pack) -> DataFrame:
    """``found`` with name, why and advice of each rule, looked up in a literal of the pack."""
    prose = F.create_map(*[x for r in pack.rules for x in (F.lit(r.id), F.struct(F.lit(r.name).alias("name"), F.lit(r.why).alias("why"), F.lit(r.advice).alias("advice")))])
    return found.withColumn("_prose", F.element_at(prose, F.col("rule_id"))).select(*found.columns, "_prose.name", "_prose.why", "_prose.advice")
