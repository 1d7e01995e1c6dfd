"""Documents outside the domain that the index is calibrated for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstrata.functions.text import PUNCTUATION, SPACE, chars_in

LEAST_CHARS = 80
#: Characters, phrases and bounds of the kinds.
STRONG, PARTICLES, LE = "乎哉兮矣焉欤俟汝尓乃遂皆曰", "的地得", "了"
DE_MAX, STRONG_MIN, LE_MAX = 0.010, 0.008, 0.006
VERSE_SENTENCES, VERSE_SHARE, CLAUSE = 4, 0.60, (5, 9)
COMMAS = "，、；"
CJK_MIN = 0.30
GENRES = {"issuance-notice": "印发给你们，请", "approval-reply": "批复如下"}
OFFICIAL = [
    "特此(?:通知|报告|函复|公告|批复)",
    "现将.{0,24}(?:通知如下|报告如下|情况如下|函复如下)",
    "现提出如下|现作如下|作如下决定|提出如下(?:意见|措施)|制定如下措施",
    "印发给你们",
    "批复如下",
    "请遵照执行|请认真贯彻执行",
    "(?:为深入|为认真|为贯彻|为落实).{0,10}(?:贯彻|落实|精神)",
    "结合.{0,16}实际，?制定",
    "经.{0,20}(?:同意|决定|审议通过)，",
]
OFFICIAL_HEADS = ["抄送", "主送"]


def _shape(clean: Column, n: Column, balanced: Column, sentences: Column, lengths: Column) -> Column:
    """classical and verse, of a document or of one paragraph."""
    rate = lambda chars: chars_in(clean, chars) / n
    classical = (rate(PARTICLES) < DE_MAX) & (rate(STRONG) >= STRONG_MIN) & (rate(LE) < LE_MAX)
    verse = (balanced >= VERSE_SENTENCES) & (balanced / sentences >= VERSE_SHARE) & (F.size(lengths) == 1)
    kinds = F.array(F.when(classical, F.lit("classical")), F.when(verse, F.lit("verse")))
    return F.when(n >= LEAST_CHARS, F.filter(kinds, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))


def of_sentence(rows: DataFrame) -> DataFrame:
    """``rows`` of sentences with even: two clauses of verse length, with their lengths in lens, and head."""
    other = "".join(c for c in PUNCTUATION + SPACE if c not in COMMAS)
    clauses = F.filter(F.transform(F.split(F.translate("text", other, ""), f"[{COMMAS}]"), F.length), lambda n: n > 0)
    none = F.array().cast("array<int>")
    rows = rows.withColumn("lens", F.when(F.col("text").rlike(f"[{COMMAS}]"), clauses).otherwise(none))
    even = (F.size("lens") == 2) & F.get("lens", F.lit(0)).between(*CLAUSE) & F.get("lens", F.lit(1)).between(*CLAUSE)
    rows = rows.withColumn("even", F.coalesce(even, F.lit(False)))
    head = F.coalesce(F.col("text").startswith(OFFICIAL_HEADS[0]) | F.col("text").startswith(OFFICIAL_HEADS[1]), F.lit(False))
    return rows.withColumn("lens", F.when(F.col("even"), F.col("lens")).otherwise(none)).withColumn("head", head)


def of_para() -> list[Column]:
    return [F.count_if("even").alias("b"), F.array_distinct(F.flatten(F.collect_list("lens"))).alias("lens"), F.bool_or("head").alias("head")]


def para_kinds() -> Column:
    """Kinds of a paragraph with its sentences in ``s`` and their length in ``len``, so that short ones are not put together."""
    clean = F.array_join(F.transform("s", lambda x: x["clean"]), "")
    return _shape(clean, F.col("len"), F.col("b"), F.col("n"), F.col("lens"))


def of_doc() -> list[Column]:
    return [F.sum("b").alias("b"), F.array_distinct(F.flatten(F.collect_list("lens"))).alias("lens"), F.bool_or("head").alias("head")]


def of_facts() -> dict[str, Column]:
    """shapes: classical and verse, of the document and then of its paragraphs; cjk: its Chinese characters."""
    whole = _shape(F.col("clean"), F.length("clean"), F.col("b"), F.col("n_sentences"), F.col("lens"))
    return {"shapes": F.concat(whole, F.flatten(F.transform("p", lambda x: x["kinds"]))), "cjk": F.length(F.regexp_replace("clean", "[^一-鿿]", "")).cast("long")}


def kinds(genre: bool = False, officialese: bool = True) -> dict[str, Column]:
    """kinds in order, each once, non_chinese and has_content of a row of ``facts``.

    Whole-document kinds come first, then those of single paragraphs, genre,
    officialese and non-chinese.
    """
    n = F.col("n_chars")
    long = n >= LEAST_CHARS
    official = long & (F.col("raw").rlike("|".join(OFFICIAL)) | F.col("head"))
    foreign = long & (F.col("cjk") / n < CJK_MIN)
    when = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    found = [F.col("shapes")]
    if genre:
        found += [when(long & F.col("raw").contains(phrase), k) for k, phrase in GENRES.items()]
    if officialese:
        found.append(when(official, "officialese"))
    found.append(when(foreign, "non-chinese"))
    return {"kinds": F.array_distinct(F.concat(*found)), "non_chinese": foreign, "has_content": F.col("raw").rlike("[0-9A-Za-z一-鿿]")}


def domain_flags(facts: DataFrame, genre: bool = False, officialese: bool = True) -> DataFrame:
    """(doc_id, kinds, non_chinese, has_content) of rows of ``facts`` with flags."""
    return facts.withColumns(kinds(genre, officialese)).select("doc_id", "kinds", "non_chinese", "has_content")
