"""Documents into blocks and sentences.

Lines are typed by built-in expressions, fences by a running sum and blocks
as islands of equal kinds, in windows over a document's lines; rows stay
dealt by doc_id from there on, so that what follows by document needs no
further shuffle. Sentences are cut by one regular expression; quoted
terminators are hidden first. All are built-in expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstrata.functions.text import CONTENT, LINE_BREAK, WS, bare, strip

#: Sentence ends, what is absorbed behind one, and quotes.
ENDS = "。！？；…!?;"
ABSORBED = "。！？；…!?;.””』」"
OPEN_QUOTES, CLOSE_QUOTES = "“『「", "”』」"
#: What most characters are: tried first, so that a regex need not compare them with each terminator or quote.
PLAIN = "一-鿿0-9A-Za-z"
#: Stand-ins for terminators inside quotes, from the private use area.
HIDDEN = 0xE100


@dataclass(frozen=True)
class Config:
    """``ends`` are the terminators; without ``markdown`` each line is a paragraph of plain text."""

    ends: str = ENDS
    markdown: bool = True


ZH = Config()
LATIN = Config(ends=ENDS + ".", markdown=False)

#: Line patterns, with white space and digits spelled out.
FENCE = rf"^{WS}*(?:```|~~~)"
HEADING = rf"^{WS}*#{{1,6}}(?:{WS}|$)"
RULE = rf"^{WS}*(?:-{WS}*){{2,}}-?{WS}*$|^{WS}*(?:\*{WS}*){{2,}}\*?{WS}*$|^{WS}*_{{3,}}{WS}*$|^{WS}*=+{WS}*$"
ITEM = rf"^{WS}*(?:[-*+]{WS}+|\p{{Nd}}+[.、)](?={WS}|\P{{Nd}}|$)){WS}*(.*)$"
CHECKBOX = rf"^{WS}*\[[ xX]\]{WS}*"
QUOTED = rf"^{WS}*>+{WS}?"
TABLE_RULE = rf"^{WS}*\|?{WS}*:?-{{2,}}:?{WS}*(?:\|{WS}*:?-{{2,}}:?{WS}*)+\|?{WS}*$"
CODE = "`([^`]*)`"
IMAGE = r"!\[([^\]]{0,300})\]\(([^)]{0,500})\)"
LINK = r"\[([^\]]{0,300})\]\(([^)]{0,500})\)"
URL = r"(?i)(?:https?://|www\.)[^" + WS[1:-1] + r"，。；！？、）)】」』]+"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9._-]{1,63})+"
EMPHASIS = rf"\*{{1,3}}(?!{WS})([^*]{{0,49}}?[一-鿿][^*]{{0,49}}?)(?<!{WS})\*{{1,3}}"


def inline_clean(c: Column) -> Column:
    """A line without inline marks, links and addresses."""
    for pattern, to in ((CODE, "$1"), (IMAGE, "$1"), (LINK, "$1"), (URL, ""), (EMAIL, ""), (EMPHASIS, "$1"), (r"[ \t]{2,}", " ")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, kind, text): kind is p, li, tr or b, a boundary without text."""
    raw = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_BREAK)).alias("line", "raw"))
    raw = raw.select("doc_id", "line", F.regexp_replace(strip(F.col("raw")), QUOTED, "").alias("s"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("s").rlike(FENCE)
    raw = raw.withColumn("coded", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1)
    s = F.col("s")
    item = strip(F.regexp_replace(F.regexp_extract(s, ITEM, 1), CHECKBOX, ""))
    row = F.regexp_replace(strip(s), r"^\|+|\|+$", "")
    cells = F.filter(F.transform(F.split(row, r"\|"), strip), lambda x: x != "")
    table = inline_clean(F.array_join(cells, "，"))
    none = F.struct(F.lit("b").alias("kind"), F.lit("").alias("text"))
    made = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    typed = (
        F.when(fence | F.col("coded") | (s == "") | s.rlike(HEADING) | s.rlike(RULE), none)
        .when(s.rlike(ITEM), F.when(item != "", made("li", inline_clean(item))).otherwise(none))
        .when(s.contains("|"), F.when(s.rlike(TABLE_RULE) | (table == ""), none).otherwise(made("tr", table)))
        .otherwise(made("p", inline_clean(s)))
    )
    return raw.select("doc_id", "line", typed.alias("t")).select("doc_id", "line", "t.*")


def units(docs: DataFrame, config: Config = ZH) -> DataFrame:
    """(doc_id, para, kind, unit, text): a paragraph is one unit, list items and table rows are one each. Blocks count from 0."""
    if not config.markdown:
        raw = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para", "text"))
        return raw.select("doc_id", "para", F.lit("para").alias("kind"), F.lit(0).alias("unit"), strip(F.col("text")).alias("text")).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("line")
    first = (F.col("kind") != "b") & ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    marked = lines(docs).withColumn("first", first.cast("int"))
    marked = marked.withColumn("para", (F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).where("kind <> 'b'")
    kind = F.when(F.col("kind") == "li", "list").when(F.col("kind") == "tr", "table").otherwise("para")
    unit = F.when(F.col("kind") == "p", 0).otherwise(F.col("line"))
    joined = marked.select("doc_id", "para", kind.alias("kind"), unit.alias("unit"), "line", "text").groupBy("doc_id", "para", "kind", "unit")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return joined.agg(text.alias("text"))


def blocks(docs: DataFrame, config: Config = ZH) -> DataFrame:
    """(doc_id, para, kind, text): a block's units on lines of their own."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda x: x["text"]), "\n")
    return units(docs, config).groupBy("doc_id", "para", "kind").agg(text.alias("text"))


def stripped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the document as plain text, blocks parted by a blank line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n\n")
    return blocks(docs).groupBy("doc_id").agg(text.alias("text"))


def hidden(text: Column, ends: str) -> Column:
    """``text`` with the terminators inside quotes replaced. Curly quotes nest, a straight one opens or closes all.

    The text falls into quotes and runs between them; the depth runs along
    these, which are few, and not along characters.
    """
    away = "".join(chr(HIDDEN + i) for i in range(len(ends)))
    runs = F.regexp_extract_all(text, F.lit(f'[{PLAIN}[^{OPEN_QUOTES}{CLOSE_QUOTES}"]]++|[{OPEN_QUOTES}{CLOSE_QUOTES}"]'), F.lit(0))

    def step(state: Column, run: Column) -> Column:
        d = state["d"]
        depth = F.when(run.isin(list(OPEN_QUOTES)), d + 1).when(run.isin(list(CLOSE_QUOTES)), F.greatest(d - 1, F.lit(0))).when(run == '"', F.when(d > 0, 0).otherwise(1)).otherwise(d)
        return F.struct(depth.alias("d"), F.array_append(state["out"], F.when(d > 0, F.translate(run, ends, away)).otherwise(run)).alias("out"))

    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(runs, start, step, lambda state: F.array_join(state["out"], ""))


def split_sentences(text: Column, config: Config = ZH) -> Column:
    """The sentences of a unit as an array; a terminator inside quotes ends none.

    Where no terminator is followed by something else that is absorbed, the
    cuts are the places behind a terminator and before none; a split there
    costs a fraction of the search for whole sentences.
    """
    away = "".join(chr(HIDDEN + i) for i in range(len(config.ends)))
    shown = F.when(text.rlike(f'[{OPEN_QUOTES}{CLOSE_QUOTES}"]'), hidden(text, config.ends)).otherwise(text)
    e, a = config.ends.replace("]", r"\]"), ABSORBED + config.ends
    plain = "" if re.search(f"[{PLAIN}]", config.ends) else PLAIN
    absorbed = "".join(c for c in ABSORBED if c not in config.ends)
    whole = F.lit(f"[{plain}[^{e}]]++(?:[{e}][{a}]*+)?+|[{e}][{a}]*+")
    cut = lambda s: F.when(s.rlike(f"[{e}][{absorbed}]"), F.regexp_extract_all(s, whole, F.lit(0))).otherwise(F.split(s, f"(?<=[{e}])(?![{a}])"))
    # the text is bound once, as a list of one
    return F.filter(F.transform(F.flatten(F.transform(F.array(shown), cut)), lambda x: strip(F.translate(x, away, config.ends))), lambda x: x != "")


def sentences(docs: DataFrame, config: Config = ZH, outer: bool = False) -> DataFrame:
    """(doc_id, para, kind, unit, pos, text, clean): every sentence in place; ``clean`` is without punctuation.

    With ``outer`` a unit without a sentence keeps a row without pos and text,
    for its block counts as a paragraph.
    """
    if not config.markdown:  # dealt by document before texts fall into rows; with Markdown the windows over lines do it
        docs = docs.repartition("doc_id")
    cut = (F.posexplode_outer if outer else F.posexplode)(split_sentences(F.col("text"), config)).alias("pos", "text")
    return units(docs, config).select("doc_id", "para", "kind", "unit", cut).withColumn("clean", bare(F.col("text")))


def has_content(c: Column) -> Column:
    return c.rlike(CONTENT)
