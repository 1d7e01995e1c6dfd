"""Line-based rewrite advice for the personal profile.

Each line keeps, changes or goes. Figures and conclusions keep a line,
whatever else it says. A candidate is made only where cutting a half sentence
is safe; all else is a direction. The decision is one CASE over the rules
that hit, in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstrata.functions.text import LINE_BREAK, WS, strip
from penstrata.operators import bydoc
from penstrata.packs import Pack

#: What a line is judged by.
IMPORTANT = "[0-9０-９]|%|％|[一二三四五六七八九十百千万]+(?:倍|万|亿|人天|分钟)|(?:结论|结果表明|数据显示|实测|验证|复现|报错|错误码|失败率|通过率|达标|未达标)"
NOUN = "DDL|deadline|组会|参考文献|文献|论文|paper|Paper|accept|数据|导师|大佬|咖啡|午饭|午休|书桌|台灯|日历|邮件|报错|日志|版本|分支|草稿|推文|稿子"
MEME = "牛马|摸鱼|摆烂|连滚带爬|火葬场|狠人|卷王|躺平"
COMFORT = "你已经(?:很|够|超|挺|那么|这么)|你值得|好好(?:爱|善待|心疼)?自己|照顾好?自己|爱惜自己|犒劳(?:好)?自己|不要给自己.{0,4}(?:压力|负担)|(?:会一直|一直|永远)陪(?:着|在)?你|一切都会(?:好|过去)"
EMPTY_HEAD = "^(?:无论|不管).{0,8}(?:如何|怎样|与否)$|^.{0,6}的日子里$"
SEVERAL = "[。！？；…!?;]"
SUMMING = "(?:综上所述|总而言之|总的来说|由此可见|不得不说)[，,]?"
MARKER = rf"^{WS}*(?:[-*+]{WS}+|\p{{Nd}}+[.、)](?={WS}|\P{{Nd}}|$)){WS}*"
YOU_WHO = rf"^[^，,]{{0,10}}的你[，,]{WS}*(.+)$"
KEEP, CHANGE, DROP = "keep", "rewrite", "delete"
#: Characters beyond which a line has substance enough to be rewritten.
SUBSTANCE = 14


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, raw, text): lines from 1 without list markers; blank ones are left out."""
    raw = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_BREAK)).alias("n", "raw"))
    out = raw.select("doc_id", (F.col("n") + 1).alias("line"), "raw", strip(F.regexp_replace("raw", MARKER, "")).alias("text"))
    return out.where("text <> ''")


def lines_of(texts: Column) -> Column:
    """(line, raw) of the lines that ``text_lines`` gives of a document's ``texts``, as an array."""
    def of(t: Column) -> Column:
        raw = F.transform(F.split(F.coalesce(t["text"], F.lit("")), LINE_BREAK), lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw")))
        return F.filter(raw, lambda x: strip(F.regexp_replace(x["raw"], MARKER, "")) != "")

    return F.flatten(F.transform(texts, of))


def _without_paren(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[（(][^）)]*[）)]{WS}*$", ""))


def rules_hit(pack: Pack, text: Column) -> Column:
    """Ids of the sentence rules that hit a text, in order; batches are searched together where Python's regex reads the patterns as Spark's does."""
    if bydoc.supports(pack, []):
        return bydoc.matcher(pack)(text)
    any_of = lambda r: F.exists(F.array(*[text.rlike(p) for p in r.patterns]), lambda x: x)
    return F.filter(F.array(*[F.when(any_of(r), F.lit(r.id)) for r in pack.of_scope("sentence") if r.patterns]), lambda x: x.isNotNull())


def advised(lines: DataFrame, pack: Pack) -> DataFrame:
    """``lines(…, text)`` with action, rules, taste, candidate (null if none) and direction."""
    t = F.col("text")
    rules = pack.of_scope("sentence")
    rows = lines.withColumn("rules", rules_hit(pack, t))
    tastes = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.taste)])
    rows = rows.withColumn("taste", F.filter(F.transform("rules", lambda i: F.element_at(tastes, i)), lambda x: x != ""))
    body = _without_paren(F.regexp_replace(t, "[。！？～]+$", ""))
    rows = rows.withColumn("body", body)
    rows = rows.withColumn("heads", F.filter(F.transform(F.split("body", "[，,]"), strip), lambda h: h != ""))
    b, has = F.col("body"), lambda i: F.array_contains("rules", i)
    two, several = F.size("heads") >= 2, b.rlike(SEVERAL)
    half = F.concat(F.get("heads", F.lit(0)), F.lit("。"))
    you = F.regexp_extract(b, YOU_WHO, 1)
    bare_of = F.regexp_replace(b, SUMMING + WS + "*", "")
    make = lambda c=None, d=None: F.struct((F.lit(None).cast("string") if c is None else c).alias("candidate"), F.lit(d or "").alias("direction"))
    plain = F.when(b.rlike(NOUN) | b.rlike(MEME), make(d="cut the mannered half, keep the fact")).otherwise(make(d="cut the mannered half, keep the fact; add a concrete noun"))
    plan = (
        F.when(F.exists("rules", lambda i: i.startswith("T-MANUAL")), make(d="delete: instructions are not kept"))
        .when(has("T-VOICE-05"), make(d="delete: say it in one sentence without reasons"))
        .when(has("T-VOICE-01") & b.rlike(COMFORT), make(d="delete: comfort without a fact"))
        .when(has("T-VOICE-01") & two & ~F.get("heads", F.lit(0)).rlike(EMPTY_HEAD) & ~several, make(half))
        .when(has("T-VOICE-01") & two & ~F.get("heads", F.lit(0)).rlike(EMPTY_HEAD), make(d="drop the comforting half after the comma"))
        .when(has("T-VOICE-01") & two, make(d="delete: the first half says nothing"))
        .when(has("T-VOICE-02") & two & ~several, make(half))
        .when(has("T-VOICE-02") & two, make(d="drop the uplifting half, keep the action"))
        .when(has("T-VOICE-07") & (you != "") & ~you.rlike(SEVERAL), make(F.concat(strip(you), F.lit("。"))))
        .when(has("T-VOICE-11") & (strip(bare_of) != ""), make(F.concat(bare_of, F.lit("。"))))
        .when(has("T-VOICE-11"), make(d="delete: nothing but summing up"))
        .when(has("T-VOICE-10") | has("T-VOICE-12") | has("T-VOICE-04"), make(d="delete: slogans inform nobody"))
        .otherwise(plain)
    )
    rows = rows.withColumn("p", plan)
    same = F.regexp_replace("p.candidate", f"[。！？～{WS[1:-1]}]", "") == F.regexp_replace(t, f"[。！？～{WS[1:-1]}]", "")
    none = F.col("p.candidate").isNotNull() & same
    rows = rows.withColumn("candidate", F.when(~none, F.col("p.candidate"))).withColumn("direction", F.when(none & (F.col("p.direction") == ""), "cut the mannered half, keep the fact").otherwise(F.col("p.direction")))
    manual = F.exists("rules", lambda i: i.startswith("T-MANUAL"))
    important, clean = t.rlike(IMPORTANT), F.size("rules") == 0
    action = (
        F.when(important | clean, KEEP)
        .when(manual | (F.col("candidate").isNull() & F.col("direction").startswith("delete")), DROP)
        .when(F.col("candidate").isNotNull() | (F.length(_without_paren(t)) > SUBSTANCE), CHANGE)
        .otherwise(DROP)
    )
    keep = important | clean
    direction = F.when(important, "").when(clean, F.when(t.rlike(NOUN) | t.rlike(MEME), "").otherwise("if this is copy, add a concrete noun")).otherwise(F.col("direction"))
    return rows.select(*lines.columns, action.alias("action"), "rules", "taste", F.when(~keep, F.col("candidate")).alias("candidate"), direction.alias("direction"))


def applied(docs: DataFrame, advice: DataFrame) -> DataFrame:
    """(doc_id, text): the drafts with lines deleted or swapped for their candidates; other lines stay as they were."""
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw")).withColumn("line", F.col("n") + 1)
    told = advice.select("doc_id", "line", "action", "candidate")
    kept = raw.join(told, ["doc_id", "line"], "left").where(f"action is null or action <> '{DROP}'")
    text = F.when((F.col("action") == CHANGE) & F.col("candidate").isNotNull(), F.col("candidate")).otherwise(F.col("raw"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


def attacked(docs: DataFrame, sents: DataFrame, pack: Pack) -> DataFrame:
    """(doc_id, text): drafts rewritten sentence by sentence, paragraph breaks kept, for scoring an index against its own advice.

    What goes is left out where sentences are gathered: a filter on the action
    would be pushed below it, with the whole decision, once for each mention.
    """
    lines = sents.select("doc_id", "para", "unit", "pos", "text")
    told = advised(lines, pack)
    s = F.when((F.col("action") == CHANGE) & F.col("candidate").isNotNull(), F.col("candidate")).otherwise(F.col("text"))
    paras = told.groupBy("doc_id", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") != DROP, F.struct("unit", "pos", s.alias("s"))))), lambda x: x["s"]), "").alias("s"), F.count_if(F.col("action") != DROP).alias("n")).where("n > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "s"))), lambda x: x["s"]), "\n\n")
    return docs.select("doc_id").join(paras.groupBy("doc_id").agg(text.alias("text")), "doc_id", "left").na.fill("", ["text"])
