"""All that later steps need of a document, from one pass: segmented once, hit once, one row each.

A document is read whole, in one call (``bydoc``), dealt by its id. Statistics,
domain kinds, gate, findings and index are then expressions over a document's
own row, without a join or a window. ``by_rows`` makes the same of rows of
lines and sentences, for rules whose patterns only Spark's regex reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstrata.functions.text import count_of
from penstrata.operators import bydoc, domain
from penstrata.operators.segment import ZH, Config, has_content, sentences
from penstrata.packs import Pack, Rule

#: Characters of a one-sentence paragraph that the shape rule takes for a stamp.
SHAPE_CHARS = 40
_HITS = "array<struct<rule_ord: int, matches: array<string>>>"
_FOUND = "array<struct<para: int, unit: int, pos: int, sentence: string, rule_ord: int, matches: array<string>>>"


def matches(rule: Rule, text: Column) -> Column:
    """First matches of the rule's patterns, in order; patterns without one are left out."""
    one = [F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in rule.patterns]
    return F.filter(F.array(*one), lambda m: m.isNotNull())


def sentence_hits(pack: Pack, text: Column) -> Column:
    """(rule_ord, matches) of the rules that hit a sentence. Rules that do not are dropped by one search of all their patterns."""
    rules = [(i, r) for i, r in enumerate(pack.rules) if r.scope == "sentence" and r.patterns]
    if not rules:
        return F.array().cast(_HITS)
    # alternatives bind loosest, so only flags need a group, which costs at each place of a text
    any_of = lambda r: text.rlike("|".join(f"(?:{p})" if "(?" in p else p for p in r.patterns))
    made = [F.when(any_of(r), F.struct(F.lit(i).alias("rule_ord"), matches(r, text).alias("matches"))) for i, r in rules]
    return F.array_compact(F.array(*made)).cast(_HITS)


def facts(docs: DataFrame, pack: Pack | None = None, lexicon: list[str] | None = None, config: Config = ZH, flags: bool = False, need: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document with a block.

    doc_id, n_paragraphs, n_sentences, n_chars, sum_sq, para_sq, conn, dashes,
    sums over windows (``bydoc.SUMS``), raw, clean and p, its paragraphs; with
    ``pack`` also ``found``, its hits with their places, ungated; with
    ``flags`` what ``domain.kinds`` reads. ``lexicon`` defaults to the pack's,
    ``need`` names the columns wanted, if not all; ``texts``, the document's own
    texts as structs, comes only where it is named.
    """
    lexicon = list(lexicon if lexicon is not None else pack.lexicon if pack else ())
    carried = [c for c in ("texts",) if c in (need or ())]
    texts = docs.groupBy("doc_id").agg(F.collect_list(F.struct("text")).alias("texts"))  # in place where documents are dealt by doc_id
    if not bydoc.supports(pack, lexicon):
        rows = by_rows(docs, pack, lexicon, config, flags)
        return rows.join(texts, "doc_id") if carried else rows
    columns = [*bydoc.COUNTS, *bydoc.SUMS, "raw", "clean", "p", *(["found"] if pack else []), *(bydoc.FLAGS if flags else [])]
    columns = [c for c in columns if need is None or c in need]
    if not carried:
        texts = docs.groupBy("doc_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    read = F.transform("texts", lambda x: F.coalesce(x["text"], F.lit(""))) if carried else F.col("texts")
    made = bydoc.extractor(pack, lexicon, config, flags, SHAPE_CHARS, columns)(read)
    return texts.select("doc_id", made.alias("f"), *carried).where("f is not null").select("doc_id", "f.*", *carried)


def by_rows(docs: DataFrame, pack: Pack | None, lexicon: list[str], config: Config = ZH, flags: bool = False) -> DataFrame:
    """``facts`` from rows: sentences come together by paragraph and by document. The sums over windows are left to ``stats_of``."""
    s = sentences(docs, config, outer=True)
    text, n = F.col("text"), F.length("clean").cast("long")
    words = sum((count_of(text, w) for w in lexicon), F.lit(0)).cast("long")
    fields = ["unit", "pos", "text", "clean"]
    if pack:
        s = s.withColumn("hits", F.when(has_content(text), sentence_hits(pack, text)))
        fields.append("hits")
    if flags:
        s = domain.of_sentence(s)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    by_para = s.groupBy("doc_id", "para", "kind").agg(
        F.count("text").alias("n"), zero(F.sum(n)).alias("len"), zero(F.sum(n * n)).alias("sq"), zero(F.sum(words)).alias("words"),
        F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*fields)))).alias("s"), *(domain.of_para() if flags else []),
    )
    if flags:
        by_para = by_para.withColumn("kinds", domain.para_kinds())
    doc = by_para.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"), F.sum("n").alias("n_sentences"), F.sum("len").alias("n_chars"), F.sum("sq").alias("sum_sq"),
        F.sum(F.col("len") * F.col("len")).alias("para_sq"), F.sum("words").alias("conn"),
        F.array_sort(F.collect_list(F.struct("para", "kind", "s", *(["kinds"] if flags else [])))).alias("p"), *(domain.of_doc() if flags else []),
    )
    join = lambda field: F.array_join(F.flatten(F.transform("p", lambda q: F.transform(q["s"], lambda x: x[field]))), "")
    doc = doc.withColumn("raw", join("text")).withColumn("clean", join("clean"))
    double = count_of(F.col("raw"), "——")
    doc = doc.withColumn("dashes", double + (count_of(F.col("raw"), "—") - 2 * double))
    if pack:
        doc = doc.withColumn("found", _found(pack))
    if flags:
        doc = doc.withColumns(domain.of_facts())
    return doc.withColumn("p", F.transform("p", lambda q: F.struct(q["para"].alias("para"), q["kind"].alias("kind"), F.size(q["s"]).cast("long").alias("n"), F.get(q["s"], F.lit(0))["text"].alias("head"))))


def _found(pack: Pack) -> Column:
    def at(q: Column, x: Column, rule: Column, m: Column) -> Column:
        return F.struct(q["para"].alias("para"), x["unit"].alias("unit"), x["pos"].alias("pos"), x["text"].alias("sentence"), rule.alias("rule_ord"), m.alias("matches"))

    parts = [F.flatten(F.transform("p", lambda q: F.flatten(F.transform(q["s"], lambda x: F.transform(F.coalesce(x["hits"], F.array().cast(_HITS)), lambda h: at(q, x, h["rule_ord"], h["matches"]))))))]
    first = lambda q: F.get(q["s"], F.lit(0))
    short = F.filter("p", lambda q: (q["kind"] == "para") & (F.size(q["s"]) == 1) & (F.length(first(q)["text"]) <= SHAPE_CHARS) & has_content(first(q)["text"]))
    shaped = lambda i: F.transform(short, lambda q: at(q, first(q), F.lit(i), F.array(first(q)["text"])))
    parts += [shaped(i) for i, r in enumerate(pack.rules) if r.scope == "shape"]
    return F.concat(*[p.cast(_FOUND) for p in parts])


def per_rule(pack: Pack, field: str) -> Column:
    """``field`` of all rules of a pack as a literal array, to be looked up by rule_ord."""
    return F.array(*[F.lit(getattr(r, field)) for r in pack.rules])


def gated_found(pack: Pack) -> Column:
    """``found`` with rule_id, severity, weight and is_hint: a low rule that hits once in a document accuses nothing."""
    ids, severities, weights = (per_rule(pack, f) for f in ("id", "severity", "weight"))
    times = F.transform(F.sequence(F.lit(0), F.lit(len(pack.rules) - 1)), lambda i: F.size(F.filter("found", lambda h: h["rule_ord"] == i)))

    def one(h: Column, n: Column) -> Column:
        look = lambda a: F.element_at(a, h["rule_ord"] + 1)
        hint = (look(severities) == "low") & (F.element_at(n, h["rule_ord"] + 1) == 1)
        return F.struct(h["para"].alias("para"), h["unit"].alias("unit"), h["pos"].alias("pos"), h["rule_ord"].alias("rule_ord"), look(ids).alias("rule_id"), look(severities).alias("severity"), look(weights).alias("weight"), h["sentence"].alias("sentence"), h["matches"].alias("matches"), hint.alias("is_hint"))

    # the counts are bound once, as a list of one
    return F.flatten(F.transform(F.array(times), lambda n: F.transform("found", lambda h: one(h, n))))
