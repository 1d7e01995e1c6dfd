"""Every query of the library by name, with its SQL for DuckDB where SQL can express it.

``general`` judges the synthetic documents unless a query says otherwise. All
queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstrata.functions.text import ENTITIES, mask_pii, page_links, page_text, scaled, sha_prefix
from penstrata.operators import collect, compare, domain, evaluate, mining, perplexity, rewrite, rules, score, segment, stats
from penstrata.operators.facts import facts
from penstrata.packs import PROFILES, Pack, load
from penstrata.plans import oracles as o
from penstrata.plans import report
from penstrata.session import kept, table
from penstrata.sources.synthetic import md_docs, zh_docs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROUNDED = ("sentence_cv", "para_len_cv", "ttr", "conn_density", "ngram_repeat", "dash_density")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return keep


def _rounded(df: DataFrame, columns=ROUNDED) -> DataFrame:
    return df.withColumns({c: scaled(F.col(c)) for c in columns})


def _sql_rounded(columns=ROUNDED) -> str:
    return ", ".join(f"{o.scaled(c)} AS {c}" for c in columns)


# -- documents: plain text in any language --------------------------------

_HIDDEN = "".join(chr(segment.HIDDEN + i) for i in range(len(segment.LATIN.ends)))


def _latin_sql() -> str:
    """Sentences of ``documents``: lines are paragraphs, terminators inside straight quotes are hidden."""
    e, a, ws = segment.LATIN.ends, segment.ABSORBED + segment.LATIN.ends, o.WS
    return f"""
line AS (
    SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS para, regexp_replace(unnest(x), {o.lit(f'^{ws}+|{ws}+$')}, '', 'g') AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), quoted AS (
    SELECT doc_id, para, array_to_string(list_transform(string_split(p, '"'), lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, {o.lit(e)}, '{_HIDDEN}') ELSE x END), '"') AS p FROM line WHERE p <> ''
), cut AS (
    SELECT doc_id, para, CAST(unnest(range(len(ss))) AS INTEGER) AS pos, translate(unnest(ss), '{_HIDDEN}', {o.lit(e)}) AS text FROM (
        SELECT doc_id, para, list_filter(list_transform(regexp_extract_all(p, {o.lit(f'[^{e}]*[{e}][{a}]*|[^{e}]+')}), lambda x: regexp_replace(x, {o.lit(f'^{ws}+|{ws}+$')}, '', 'g')), lambda x: x <> '') AS ss FROM quoted)
), sent AS (
    SELECT *, regexp_replace(text, {o.lit(o.BARE)}, '', 'g') AS clean FROM cut
), basic AS (
    SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(clean)) AS BIGINT) AS n_chars, sum(length(clean) * length(clean)) AS sum_sq, string_agg(clean, '' ORDER BY para, pos) AS clean FROM sent GROUP BY doc_id
), basic_stats AS (
    SELECT doc_id, n_sentences, n_chars, {o.cv("n_sentences", "n_chars", "sum_sq")} AS sentence_cv,
        CASE WHEN n_chars < 8 THEN 0.0 ELSE 1 - CAST(len(list_distinct(g)) AS DOUBLE) / len(g) END AS ngram_repeat
    FROM (SELECT *, list_transform(range(1, length(clean) - 2), lambda i: substr(clean, i, 4)) AS g FROM basic)
)"""


def basic_stats(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return stats.doc_stats(docs.select("doc_id", "text"), config=segment.LATIN).where("n_sentences > 0").select("doc_id", "n_sentences", "n_chars", "sentence_cv", "ngram_repeat")


@query(o.with_(_latin_sql(), select=f"SELECT doc_id, n_sentences, n_chars, {_sql_rounded(('sentence_cv', 'ngram_repeat'))} FROM basic_stats"))
def doc_stats_basic(spark, sf_dir):
    return _rounded(basic_stats(spark, sf_dir), ("sentence_cv", "ngram_repeat"))


@query(o.with_(_latin_sql(), select="SELECT doc_id, para, pos, text FROM sent"))
def document_sentences(spark, sf_dir):
    return segment.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), segment.LATIN).select("doc_id", "para", "pos", "text")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document."""
    return doc_stats_basic(spark, sf_dir)


# -- synthetic documents: rules, statistics, index -------------------------

GENERAL, ACADEMIC, OFFICIAL, PERSONAL = (load(p) for p in ("general", "academic", "official", "personal"))


@query(o.with_(o.zh(), select="SELECT doc_id, para, pos, text, clean FROM zh_sent"))
def zh_sentences(spark, sf_dir):
    return segment.sentences(zh_docs(spark, sf_dir)).select("doc_id", "para", "pos", "text", "clean")


@query(o.with_(o.zh(), o.stats(ACADEMIC.lexicon), select=f"SELECT doc_id, n_paragraphs, n_sentences, n_chars, {_sql_rounded((*ROUNDED, 'avg_sentence_len'))} FROM stats"))
def doc_stats_full(spark, sf_dir):
    return _rounded(stats.doc_stats(zh_docs(spark, sf_dir), ACADEMIC.lexicon), (*ROUNDED, "avg_sentence_len"))


def _hits(spark, sf_dir, pack=GENERAL, step=7):
    return rules.rule_hits(zh_docs(spark, sf_dir, step), pack)


@query(o.with_(o.zh(), o.hits(GENERAL), select="SELECT doc_id, para, pos, rule_id, array_to_string(matches, '|') AS matches FROM hit"))
def rule_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "para", "pos", "rule_id", F.array_join("matches", "|").alias("matches"))


@query(o.with_(o.zh(), o.hits(GENERAL), select="SELECT doc_id, rule_id, severity, count(*) AS n FROM hit WHERE NOT is_hint GROUP BY ALL"))
def findings_gated(spark, sf_dir):
    return _hits(spark, sf_dir).where("not is_hint").groupBy("doc_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(o.with_(o.zh(), o.hits(GENERAL), select="SELECT doc_id, rule_id, para, pos FROM hit WHERE is_hint"))
def hints(spark, sf_dir):
    return _hits(spark, sf_dir).where("is_hint").select("doc_id", "rule_id", "para", "pos")


@query(o.with_(o.zh(), o.hits(ACADEMIC), select="SELECT doc_id, para, sentence, is_hint FROM hit WHERE rule_id = 'S-CLOS-01'"))
def shape_hits(spark, sf_dir):
    return _hits(spark, sf_dir, ACADEMIC).where("rule_id = 'S-CLOS-01'").select("doc_id", "para", "sentence", "is_hint")


@query(o.with_(o.zh(), o.stats(ACADEMIC.lexicon), o.doc_rules(ACADEMIC), select=f"SELECT doc_id, rule_id, metric, {o.scaled('value')} AS value FROM whole"))
def doc_rules(spark, sf_dir):
    found = rules.doc_findings(stats.doc_stats(zh_docs(spark, sf_dir), ACADEMIC.lexicon), ACADEMIC)
    return found.select("doc_id", "rule_id", "metric", scaled(F.col("value")).alias("value"))


@query(o.with_(o.zh(), o.stats(ACADEMIC.lexicon), o.hits(ACADEMIC), o.doc_rules(ACADEMIC), select="""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, para, pos, rule_ord) AS INTEGER) AS ord, rule_id, para, is_hint FROM (
    SELECT doc_id, rule_id, para, pos, rule_ord, is_hint, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS rank FROM hit
    UNION ALL SELECT doc_id, rule_id, -1, -1, rule_ord, false, CASE rule_id WHEN 'D-UNIF-01' THEN 1 ELSE 0 END FROM whole)"""))
def findings_ordered(spark, sf_dir):
    return rules.findings(zh_docs(spark, sf_dir), ACADEMIC).select("doc_id", "ord", "rule_id", "para", "is_hint")


@query(o.with_(o.zh(), o.flags(), select="SELECT doc_id, array_to_string(kinds, ',') AS kinds FROM flag"))
def domain_flags(spark, sf_dir):
    found = domain.domain_flags(facts(zh_docs(spark, sf_dir), flags=True))
    return found.select("doc_id", F.array_join("kinds", ",").alias("kinds"))


@query(o.with_(o.zh(), o.flags(genre=True, officialese=False), select="SELECT doc_id, array_to_string(kinds, ',') AS kinds FROM flag"))
def domain_flags_official(spark, sf_dir):
    found = domain.domain_flags(facts(zh_docs(spark, sf_dir), flags=True), genre=True, officialese=False)
    return found.select("doc_id", F.array_join("kinds", ",").alias("kinds"))


@query(o.with_(o.zh(), *[o.hits(load(p), out=f"hit_{p}") for p in PROFILES], select=" UNION ALL ".join(f"SELECT '{p}' AS pack, rule_id, is_hint, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hit_{p} GROUP BY rule_id, is_hint" for p in PROFILES)))
def pack_hits(spark, sf_dir):
    """Every rule of every pack, all packs in one pass over the documents."""
    of_pack = [(p, r) for p in PROFILES for r in load(p).rules]
    both = Pack("all", tuple(r for _, r in of_pack))
    hits = rules.hits_of(facts(zh_docs(spark, sf_dir), both, lexicon=[], need=("found",)), both)
    by_doc = hits.groupBy("doc_id", "rule_ord", "rule_id", "is_hint").agg(F.count("*").alias("n"))  # in place: rows are dealt by document
    g = by_doc.groupBy("rule_ord", "rule_id", "is_hint").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))
    name = F.element_at(F.array(*[F.lit(p) for p, _ in of_pack]), F.col("rule_ord") + 1)
    return g.select(name.alias("pack"), "rule_id", "is_hint", "n", "n_docs")


def _index(spark, sf_dir, pack=GENERAL, step=7):
    return score.analyzed(zh_docs(spark, sf_dir, step), pack)


_SCORED = (o.zh(), o.stats([]), o.hits(GENERAL), o.flags(), o.score(GENERAL))


@query(o.with_(*_SCORED, select=f"SELECT doc_id, {o.scaled('index')} AS index, note FROM score"))
def style_index(spark, sf_dir):
    return _index(spark, sf_dir).select("doc_id", scaled(F.col("index")).alias("index"), "note")


@query(o.with_(o.zh(), o.stats(ACADEMIC.lexicon), o.hits(ACADEMIC), o.flags(), o.score(ACADEMIC), select=f"SELECT doc_id, {o.scaled('index')} AS index FROM score"))
def style_index_tiered(spark, sf_dir):
    return _index(spark, sf_dir, ACADEMIC).select("doc_id", scaled(F.col("index")).alias("index"))


#: The official profile with a model of its own for one genre, made up for the query.
GENRED = replace(OFFICIAL, scoring={**OFFICIAL.scoring, "genres": {"issuance-notice": {"suppress": True}, "approval-reply": {"intercept": 3.0, "hit_density": 1.5, "ttr": -4.0}}})


@query(o.with_(o.zh(), o.stats(OFFICIAL.lexicon), o.hits(OFFICIAL), o.flags(genre=True, officialese=False), o.score(GENRED), select=f"SELECT doc_id, {o.scaled('index')} AS index, note FROM score"))
def genre_scored(spark, sf_dir):
    return _index(spark, sf_dir, GENRED).select("doc_id", scaled(F.col("index")).alias("index"), "note")


@query(o.with_(o.zh(), o.stats([]), o.hits(PERSONAL), o.flags(), o.score(PERSONAL), select="SELECT doc_id, note FROM score"))
def notes_unscored(spark, sf_dir):
    return _index(spark, sf_dir, PERSONAL).select("doc_id", "note")


@query(o.with_(*_SCORED, select=f"SELECT doc_id, feature, {o.scaled('c')} AS contribution FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS feature, c_{f} AS c FROM score" for f in score.FEATURES) + ") WHERE c IS NOT NULL"))
def components(spark, sf_dir):
    return score.components(_index(spark, sf_dir)).select("doc_id", "feature", scaled(F.col("contribution")).alias("contribution"))


@query(o.with_(o.zh(), o.hits(GENERAL), select=f"""
SELECT doc_id, para, n_sents, {o.scaled('w / n_sents')} AS density, CASE WHEN w / n_sents >= 1 THEN 'high' WHEN w / n_sents >= 0.5 THEN 'medium' ELSE 'low' END AS level, excerpt FROM (
    SELECT doc_id, para, count(*) AS n_sents, substr(arg_min(text, pos), 1, 16) AS excerpt FROM zh_sent GROUP BY doc_id, para)
JOIN (SELECT doc_id, para, sum(weight) AS w FROM hit GROUP BY doc_id, para) USING (doc_id, para)"""))
def para_heat(spark, sf_dir):
    return rules.para_heat(facts(zh_docs(spark, sf_dir), GENERAL, need=("p", "found")), GENERAL).withColumn("density", scaled(F.col("density")))


_COUNTS = "sev AS (SELECT doc_id, count(*) FILTER (severity = 'high' AND NOT is_hint) AS high, count(*) FILTER (severity = 'medium' AND NOT is_hint) AS medium, count(*) FILTER (severity = 'low' AND NOT is_hint) AS low FROM hit GROUP BY doc_id)"


@query(o.with_(*_SCORED, _COUNTS, select="""
SELECT doc_id, CAST(round_even(index, 0) AS INTEGER) AS index, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(high + medium + low, 0) AS findings, n_sentences, n_chars FROM score LEFT JOIN sev USING (doc_id)"""))
def batch_summary(spark, sf_dir):
    return score.batch_summary(_index(spark, sf_dir))


@query(o.with_(*_SCORED, select=f"SELECT doc_id, {o.scaled('index')} AS index FROM score WHERE index > 60"))
def fail_above(spark, sf_dir):
    return score.above(_index(spark, sf_dir), 60).select("doc_id", scaled(F.col("index")).alias("index"))


@query(o.with_(o.zh(), o.hits(GENERAL), select="SELECT doc_id, para, pos, rule_id FROM hit WHERE NOT is_hint AND severity IN ('high', 'medium')"))
def min_severity(spark, sf_dir):
    return rules.at_least(_hits(spark, sf_dir).where("not is_hint"), "medium").select("doc_id", "para", "pos", "rule_id")


@query(o.with_(o.zh(), o.zh("later", 11), o.hits(GENERAL), o.hits(GENERAL, "later", "next"), select="""
SELECT doc_id, rule_id, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after,
    CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'gone' WHEN a.n > b.n THEN 'worse' ELSE 'better' END AS status
FROM (SELECT doc_id, rule_id, count(*) AS n FROM hit WHERE NOT is_hint GROUP BY ALL) b
FULL JOIN (SELECT doc_id, rule_id, count(*) AS n FROM next WHERE NOT is_hint GROUP BY ALL) a USING (doc_id, rule_id)
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""))
def rule_diff(spark, sf_dir):
    found = lambda step: _hits(spark, sf_dir, GENERAL, step).where("not is_hint")
    return compare.rule_diff(found(7), found(11))


def _sql_components(step: int) -> str:
    arms = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS feature, c_{f} AS c FROM score" for f in score.FEATURES)
    return o.with_(o.zh(step=step), o.stats([]), o.hits(GENERAL), o.flags(), o.score(GENERAL), select=f"SELECT * FROM ({arms}) WHERE c IS NOT NULL")


@query(f"""
SELECT doc_id, feature, {o.scaled('coalesce(a.c, 0.0)')} AS before, {o.scaled('coalesce(b.c, 0.0)')} AS after, {o.scaled('coalesce(b.c, 0.0) - coalesce(a.c, 0.0)')} AS delta
FROM ({_sql_components(7)}) a FULL JOIN ({_sql_components(11)}) b USING (doc_id, feature)""")
def component_diff(spark, sf_dir):
    return _rounded(compare.component_diff(score.components(_index(spark, sf_dir)), score.components(_index(spark, sf_dir, step=11))), ("before", "after", "delta"))


@query(o.with_(o.zh("ln", 7, "\n"), o.text_lines("ln"), o.advice("ln_line", PERSONAL, "doc_id, line"), select="SELECT doc_id, line, text, action, array_to_string(rules, ',') AS rules, array_to_string(taste, ',') AS taste, candidate, direction FROM advice"))
def rewrite_advice(spark, sf_dir):
    told = rewrite.advised(rewrite.text_lines(zh_docs(spark, sf_dir, between="\n")), PERSONAL)
    return told.drop("raw").withColumns({c: F.array_join(c, ",") for c in ("rules", "taste")})


@query(o.with_(o.zh("ln", 7, "\n"), o.text_lines("ln"), o.advice("ln_line", PERSONAL, "doc_id, line"), select="""
SELECT doc_id, string_agg(CASE WHEN action = 'rewrite' AND candidate IS NOT NULL THEN candidate ELSE raw END, chr(10) ORDER BY line) AS text
FROM ln_raw LEFT JOIN (SELECT doc_id, line, action, candidate FROM advice) USING (doc_id, line) WHERE action IS NULL OR action <> 'delete' GROUP BY doc_id"""))
def cleaned_draft(spark, sf_dir):
    docs = zh_docs(spark, sf_dir, between="\n")
    return rewrite.applied(docs, rewrite.advised(rewrite.text_lines(docs), PERSONAL))


_ORDERED = """
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, para, pos, rule_ord) AS ord FROM (
        SELECT doc_id, rule_id, severity, para, pos, rule_ord, sentence, is_hint, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS rank FROM hit
        UNION ALL SELECT doc_id, rule_id, NULL, -1, -1, rule_ord, '', false, CASE rule_id WHEN 'D-UNIF-01' THEN 1 ELSE 0 END FROM whole)
)"""


@query(o.with_(o.zh(), o.stats(ACADEMIC.lexicon), o.hits(ACADEMIC), o.doc_rules(ACADEMIC), _ORDERED, """
placed AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, para, sentence) AS place FROM ordered WHERE NOT is_hint AND para >= 0),
met AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY place, ord) = 1 AS new FROM placed),
once AS (SELECT doc_id, para, sentence, rule_id, min(ord) AS ord, bool_or(new) AS new, max(rank) AS rank, count(*) AS n, min(place) AS place FROM met GROUP BY ALL)""", select="""
SELECT doc_id, para, sentence, CAST(min(place) AS INTEGER) AS ord, CASE max(rank) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS top, string_agg(rule_id, '+' ORDER BY ord) AS rule_ids, CAST(sum(n) AS INTEGER) AS times,
    coalesce(string_agg(rule_id, '+' ORDER BY ord) FILTER (new), '') AS explained
FROM once GROUP BY doc_id, para, sentence"""))
def findings_grouped(spark, sf_dir):
    g = rules.grouped(rules.findings(zh_docs(spark, sf_dir), ACADEMIC))
    return g.withColumns({c: F.array_join(c, "+") for c in ("rule_ids", "explained")})


@query(o.with_(o.zh(), o.hits(GENERAL), "prose AS (SELECT * FROM (VALUES " + ", ".join(f"({o.lit(r.id)}, {o.lit(r.name)}, {o.lit(r.why)}, {o.lit(r.advice)})" for r in GENERAL.rules) + ") v(rule_id, name, why, advice))", select="SELECT doc_id, para, pos, rule_id, name, why, advice FROM hit JOIN prose USING (rule_id) WHERE NOT is_hint"))
def findings_explained(spark, sf_dir):
    return rules.with_prose(_hits(spark, sf_dir).where("not is_hint"), GENERAL).select("doc_id", "para", "pos", "rule_id", "name", "why", "advice")


@query(o.with_(o.zh(), o.stats([]), o.hits(PERSONAL), o.doc_rules(PERSONAL), _ORDERED, select="SELECT doc_id, rule_id, para, pos, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place FROM ordered WHERE is_hint) WHERE place <= 2"))
def first_hints(spark, sf_dir):
    return rules.first_hints(rules.findings(zh_docs(spark, sf_dir), PERSONAL), 2).select("doc_id", "rule_id", "para", "pos", "place")


# -- Markdown and pages ------------------------------------------------------


@query(o.with_(o.md(), select="SELECT doc_id, line, kind, text FROM md_line"))
def md_lines(spark, sf_dir):
    return segment.lines(md_docs(spark, sf_dir))


@query(o.with_(o.md(), select="""
SELECT doc_id, para, CASE kind WHEN 'p' THEN 'para' WHEN 'li' THEN 'list' ELSE 'table' END AS kind, string_agg(text, chr(10) ORDER BY line) AS text FROM (
    SELECT *, CAST(sum(CASE WHEN kind <> 'b' AND kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS para
    FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM md_line)) WHERE kind <> 'b' GROUP BY doc_id, para, kind"""))
def md_blocks(spark, sf_dir):
    return segment.blocks(md_docs(spark, sf_dir))


@query(o.with_(o.md(), """
md_block AS (
    SELECT doc_id, para, string_agg(text, chr(10) ORDER BY line) AS text FROM (
        SELECT *, sum(CASE WHEN kind <> 'b' AND kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS para
        FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM md_line)) WHERE kind <> 'b' GROUP BY doc_id, para)""", select="SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY para) AS text FROM md_block GROUP BY doc_id"))
def md_stripped(spark, sf_dir):
    return segment.stripped(md_docs(spark, sf_dir))


_PAGE = "html"
for _p, _to in ((r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " "), (r"(?i)</(p|div|h[1-6]|li|tr|article|section)>|<br\s*/?>", "\n"), ("<[^>]*>", " ")):
    _PAGE = f"regexp_replace({_PAGE}, {o.lit(_p)}, {o.lit(_to)}, 'g')"
for _name, _char in ENTITIES:
    _PAGE = f"replace({_PAGE}, {o.lit(_name)}, {o.lit(_char)})"


@query(r"""SELECT page_id, unnest(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"''#][^"'']*)["'']', 1), lambda x: NOT starts_with(lower(x), 'javascript:')))) AS link FROM pages""")
def pages_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(page_links(F.col("html"))).alias("link"))


_HTML = (("<div class=\"top\">网站地图 | 联系我们</div>", "</p><p>"), ("<div>主办单位：县水利站，承办单位：河道清淤办公室，请各位居民互相转告并留意通知栏里的变化</div><script>var a = 1;</script>", "<br/>"))


@query(o.with_(o.zh(), "block AS (SELECT doc_id, para, trim(regexp_replace(p, '[ \\t\\r\\n]+', ' ', 'g')) AS p FROM zh_para)", select="SELECT doc_id, coalesce(string_agg(p, chr(10) ORDER BY para) FILTER (length(regexp_replace(p, '[^一-鿿]', '', 'g')) >= 30), '') AS text FROM block GROUP BY doc_id"))
def page_blocks(spark, sf_dir):
    """Pages made of the synthetic documents: furniture and short blocks go."""
    docs = zh_docs(spark, sf_dir)
    head = F.when(F.col("doc_id") % 2 == 0, _HTML[0][0]).otherwise(_HTML[1][0])
    gap = F.when(F.col("doc_id") % 2 == 0, _HTML[0][1]).otherwise(_HTML[1][1])
    html = F.concat(head, F.lit("<p>"), F.replace(F.col("text"), F.lit("\n\n"), gap), F.lit("</p>"))
    return docs.select("doc_id", page_text(html, least_cjk=30, furniture=False).alias("text"))


@query(rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_PAGE}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages")
def pages_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))


# -- evaluation -------------------------------------------------------------

_LABELLED = "labelled AS (SELECT b.*, documents.lang, documents.source, labels.quality AS label FROM basic_stats b JOIN documents USING (doc_id) JOIN labels USING (doc_id))"


def labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    texts = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")  # what has no label is not segmented
    return basic_stats(spark, sf_dir, texts).join(docs, "doc_id").join(labels, "doc_id")


def _sql_auroc(source: str, by: str, value: str) -> str:
    return f"""SELECT {by}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n - p) AS BIGINT) AS n_neg,
    {o.scaled("CASE WHEN sum(p) > 0 AND sum(n - p) > 0 THEN CAST(sum(p * (2 * below + n + 1)) - sum(p) * (sum(p) + 1) AS DOUBLE) / CAST(2 * sum(p) * sum(n - p) AS DOUBLE) END")} AS auroc
FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT {by}, {value} AS v, sum(label) AS p, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL)) GROUP BY {by}"""


@query(o.with_(_latin_sql(), _LABELLED, select=_sql_auroc("labelled", "lang", "ngram_repeat")))
def auroc(spark, sf_dir):
    return evaluate.auroc(labelled(spark, sf_dir), ["lang"], "ngram_repeat", "label").withColumn("auroc", scaled(F.col("auroc")))


@query(o.with_(_latin_sql(), _LABELLED, select=f"""
SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (s >= t AND label = 1) AS tp, count(*) FILTER (s >= t AND label = 0) AS fp,
    {o.scaled("CAST(count(*) FILTER (s >= t AND label = 1) AS DOUBLE) / count(*) FILTER (label = 1)")} AS recall, {o.scaled("CAST(count(*) FILTER (s >= t AND label = 0) AS DOUBLE) / count(*) FILTER (label = 0)")} AS fpr,
    {o.scaled("CAST(count(*) FILTER ((s >= t) = (label = 1)) AS DOUBLE) / count(*)")} AS accuracy
FROM (SELECT floor(ngram_repeat * 100) AS s, label FROM labelled), (VALUES (5), (10), (20), (40), (60), (80)) v(t) GROUP BY t"""))
def threshold_sweep(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("s", F.floor(F.col("ngram_repeat") * 100))
    return _rounded(evaluate.threshold_sweep(rows, "s", "label", [5, 10, 20, 40, 60, 80]), ("recall", "fpr", "accuracy"))


@query(o.with_(_latin_sql(), _LABELLED, select=f"SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, {o.scaled('CAST(sum(n_chars) AS DOUBLE) / CAST(sum(n_sentences) AS DOUBLE)')} AS mean_len, {o.scaled('CAST(sum(CAST(floor(sentence_cv * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / 10000 / count(sentence_cv)')} AS mean_cv, {o.scaled('CAST(sum(CAST(floor(ngram_repeat * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / 10000 / count(ngram_repeat)')} AS mean_repeat, {o.scaled('CAST(sum(label) AS DOUBLE) / count(*)')} AS quality FROM labelled GROUP BY source"))
def means_by_source(spark, sf_dir):
    mean = lambda c: scaled(F.sum(scaled(F.col(c))).cast("double") / 10000 / F.count(c))  # noqa: E731  of four decimals, which add up alike everywhere
    g = labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.sum("n_sentences").alias("s"), F.sum("label").alias("y"), mean("sentence_cv").alias("mean_cv"), mean("ngram_repeat").alias("mean_repeat"))
    return g.select("source", "n", "n_chars", scaled(F.col("n_chars") / F.col("s")).alias("mean_len"), "mean_cv", "mean_repeat", scaled(F.col("y") / F.col("n")).alias("quality"))


@query(o.with_(_latin_sql(), _LABELLED, "banded AS (SELECT *, CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 600 THEN 'mid' ELSE 'long' END AS band FROM labelled)", select=f"""
SELECT * FROM (SELECT band, count(*) AS n, {o.scaled("list_sort(list(ngram_repeat))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS INTEGER) + 1]")} AS median FROM banded GROUP BY band) LEFT JOIN ({_sql_auroc('banded', 'band', 'ngram_repeat')}) USING (band)"""))
def length_tiers(spark, sf_dir):
    return _rounded(evaluate.length_tiers(labelled(spark, sf_dir), "ngram_repeat", "label"), ("auroc", "median"))


@query(o.with_("ranked AS (SELECT doc_id, quality, toxic, CAST((row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels)", select="SELECT * FROM ranked"))
def strat_folds(spark, sf_dir):
    return evaluate.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], "doc_id", 5)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 10")
def sample_per_source(spark, sf_dir):
    return evaluate.sample_per_source(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query(o.with_(o.zh(), o.hits(GENERAL), select=f"""
SELECT rule_id, {o.scaled("CAST(k1 AS DOUBLE) / n1")} AS share_1, {o.scaled("CAST(k0 AS DOUBLE) / n0")} AS share_0
FROM (SELECT rule_id, count(DISTINCT doc_id) FILTER (doc_id % 3 = 0) AS k1, count(DISTINCT doc_id) FILTER (doc_id % 3 <> 0) AS k0 FROM hit GROUP BY rule_id),
    (SELECT count(*) FILTER (doc_id % 3 = 0) AS n1, count(*) FILTER (doc_id % 3 <> 0) AS n0 FROM zh_doc)"""))
def rule_discrimination(spark, sf_dir):
    labels = zh_docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("label"))
    return _rounded(evaluate.rule_discrimination(_hits(spark, sf_dir), labels), ("share_1", "share_0")).drop("difference")


@query()
def calibrated(spark, sf_dir):
    rows = kept(labelled(spark, sf_dir).na.drop())
    return evaluate.apply_fit(rows, *evaluate.logistic_fit(rows, ["sentence_cv", "ngram_repeat"], "label")).select("doc_id", "label", "fitted")


@query()
def cross_validated(spark, sf_dir):
    rows = evaluate.stratified_folds(kept(labelled(spark, sf_dir).na.drop()), ["lang", "label"], "doc_id", 3)
    held = evaluate.out_of_fold(rows, ["sentence_cv", "ngram_repeat"], "label", "fold")
    return evaluate.auroc(held.withColumn("_", F.lit(0)), ["_"], "fitted", "label").drop("_")


_ARMS = "arm AS (SELECT doc_id % 3 = 0 AS label, coalesce(w, 0) / n_sentences AS ungated, coalesce(g, 0) / n_sentences AS gated FROM stats LEFT JOIN (SELECT doc_id, sum(weight) AS w, sum(weight) FILTER (NOT is_hint) AS g FROM hit GROUP BY doc_id) USING (doc_id))"


def _arms(spark, sf_dir):
    """Synthetic documents with both densities, statistics and a label made of their ids."""
    rows = stats.stats_of(facts(zh_docs(spark, sf_dir), GENERAL).withColumn("hits", rules.gated_found(GENERAL)), GENERAL.lexicon, "hits")
    weigh = lambda c: F.aggregate(c, F.lit(0.0), lambda t, h: t + h["weight"]) / F.col("n_sentences")
    return rows.where("n_sentences > 0").select("doc_id", "n_chars", (F.col("doc_id") % 3 == 0).cast("int").alias("label"), weigh("hits").alias("ungated"), weigh(F.filter("hits", lambda h: ~h["is_hint"])).alias("gated"), "sentence_cv", "ttr", "ngram_repeat")


@query(o.with_(o.zh(), o.stats([]), o.hits(GENERAL), _ARMS, "flat AS (SELECT 'ungated' AS arm, CAST(label AS INTEGER) AS label, ungated AS v FROM arm UNION ALL SELECT 'gated', CAST(label AS INTEGER), gated FROM arm)", select=_sql_auroc("flat", "arm", "v")))
def ablation_densities(spark, sf_dir):
    got = evaluate.ablation(_arms(spark, sf_dir), "label", {"ungated": ["ungated"], "gated": ["gated"]})
    return got.withColumn("auroc", scaled(F.col("auroc")))


_STATS = ["sentence_cv", "ttr", "ngram_repeat"]


@query()
def ablation_fits(spark, sf_dir):
    """The arms that are fitted: statistics alone, and with the density."""
    return evaluate.ablation(_arms(spark, sf_dir).na.drop(), "label", {"stats": _STATS, "full": ["ungated", *_STATS]})


@query()
def half_holdout(spark, sf_dir):
    return evaluate.held_out_auroc(labelled(spark, sf_dir).na.drop(), ["sentence_cv", "ngram_repeat"], "label", "doc_id", 3)


@query(o.with_(*[f"half_{k} AS (SELECT doc_id, quality, {k} AS seed, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('{k}:' || CAST(doc_id AS VARCHAR))) - 1) % 2 AS INTEGER) AS fold FROM labels)" for k in range(3)], select=" UNION ALL ".join(f"SELECT * FROM half_{k}" for k in range(3))))
def half_splits(spark, sf_dir):
    rows, out = table(spark, sf_dir, "labels").select("doc_id", "quality"), None
    for k in range(3):
        part = evaluate.half_split(rows, "quality", "doc_id", k).select("doc_id", "quality", F.lit(k).alias("seed"), "fold")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def tier_fits(spark, sf_dir):
    return evaluate.tier_fits(labelled(spark, sf_dir).na.drop(), ["sentence_cv", "ngram_repeat"], "label")


@query(o.with_(_latin_sql(), _LABELLED, select="SELECT source, count(*) AS n FROM labelled WHERE label = 0 AND sentence_cv IS NOT NULL GROUP BY source HAVING count(*) >= 3"))
def channels(spark, sf_dir):
    return evaluate.channels(labelled(spark, sf_dir).where("sentence_cv is not null"), "label", "source")


@query()
def channel_left_out(spark, sf_dir):
    """Four languages as channels."""
    held = evaluate.leave_one_out(labelled(spark, sf_dir).na.drop(), ["sentence_cv", "ngram_repeat"], "label", "lang")
    return evaluate.auroc(held.withColumn("_", F.lit(0)), ["_"], "fitted", "label").drop("_")


@query(o.with_(*_SCORED, "model AS (SELECT 'm' || CAST(doc_id % 5 AS VARCHAR) AS model, CAST(round_even(index, 0) AS INTEGER) AS s FROM score WHERE index IS NOT NULL)", select=f"""
SELECT model, count(*) AS n, list_sort(list(s))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS INTEGER) + 1] AS median, list_sort(list(s))[CAST(least(floor(count(*) * 0.9), count(*) - 1) AS INTEGER) + 1] AS p90,
    {o.scaled('CAST(count(*) FILTER (s >= 80) AS DOUBLE) / count(*)')} AS share_above, {o.scaled('CAST(count(*) FILTER (s < 80) AS DOUBLE) / count(*)')} AS share_below FROM model GROUP BY model"""))
def model_table(spark, sf_dir):
    rows = _index(spark, sf_dir).select(F.concat(F.lit("m"), F.col("doc_id") % 5).alias("model"), F.bround("index", 0).cast("int").alias("s"))
    return _rounded(evaluate.group_table(rows, "model", "s"), ("share_above", "share_below"))


@query(o.with_(o.zh(), o.stats(OFFICIAL.lexicon), o.hits(OFFICIAL), o.doc_rules(OFFICIAL), "rule AS (SELECT doc_id, count(DISTINCT rule_id) AS k FROM (SELECT doc_id, rule_id FROM hit WHERE NOT is_hint UNION ALL SELECT doc_id, rule_id FROM whole) GROUP BY doc_id)", select=f"SELECT count(*) AS n, count(k) AS flagged, CAST(sum(k) AS BIGINT) AS rules, {o.scaled('CAST(count(k) AS DOUBLE) / count(*)')} AS rate FROM zh_doc LEFT JOIN rule USING (doc_id)"))
def false_positives(spark, sf_dir):
    return _rounded(evaluate.false_positives(_index(spark, sf_dir, OFFICIAL)), ("rate",))


@query("SELECT doc_id, source FROM documents ORDER BY sha256(coalesce(text, '')), doc_id LIMIT 50")
def hash_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return evaluate.hash_sample(docs, "text", 50).select("doc_id", "source")


_RECON = ("sentence_cv", "ngram_repeat", "n_sentences")


@query(o.with_(_latin_sql(), _LABELLED, "flat AS (" + " UNION ALL ".join(f"SELECT lang, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM labelled" for f in _RECON) + ")", select=_sql_auroc("flat", "lang, feature", "value")))
def domain_recon(spark, sf_dir):
    return evaluate.domain_recon(labelled(spark, sf_dir), "lang", "label", list(_RECON)).withColumn("auroc", scaled(F.col("auroc")))


_POOL = {"question": "[?？]", "digit": "[0-9]", "marks": "[%$&*#]{3}"}


@query(o.with_(_latin_sql(), select=" UNION ALL ".join(f"SELECT '{n}' AS feature, lang, count(*) AS n, count(*) FILTER (regexp_matches(sent.text, {o.lit(p)})) AS hits FROM sent JOIN documents USING (doc_id) GROUP BY lang" for n, p in _POOL.items())))
def pool_features(spark, sf_dir):
    lines = document_sentences(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.pool_features(lines, "lang", _POOL)


_RANK = "list_sort(list(length(text)) FILTER (text IS NOT NULL))[CAST(least(floor(count(text) * {p}), count(text) - 1) AS INTEGER) + 1]"


@query(f"""
SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, {_RANK.format(p=0.25)} AS p25, {_RANK.format(p=0.5)} AS p50, {_RANK.format(p=0.75)} AS p75,
    {o.scaled("CAST(count(*) FILTER (regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[一-鿿]')) AS DOUBLE) / count(*)")} AS mixed,
    {o.scaled("sum(length(text) - length(translate(text, " + o.lit(o.PUNCTUATION) + ", ''))) * 1000.0 / sum(length(text))")} AS punctuation
FROM (SELECT source, text FROM documents UNION ALL SELECT 'customers', c_name || '：第' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN '号客户，已核对。' ELSE '!' END FROM customer) GROUP BY source""")
def corpus_profile(spark, sf_dir):
    made = F.concat("c_name", F.lit("：第"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "号客户，已核对。").otherwise("!"))
    rows = table(spark, sf_dir, "documents").select("source", "text").unionByName(table(spark, sf_dir, "customer").select(F.lit("customers").alias("source"), made.alias("text")))
    return _rounded(evaluate.corpus_profile(rows, "source"), ("mixed", "punctuation"))


def _attacked_sql() -> str:
    after = o.with_(
        o.zh("src"), "line AS (SELECT doc_id, para, pos, text FROM src_sent)", o.advice("line", PERSONAL, "doc_id, para, pos"), """
part AS (SELECT doc_id, para, string_agg(CASE WHEN action = 'rewrite' AND candidate IS NOT NULL THEN candidate ELSE text END, '' ORDER BY pos) AS s FROM advice WHERE action <> 'delete' GROUP BY doc_id, para),
zh_doc AS (SELECT doc_id, coalesce(text, '') AS text FROM src_doc d LEFT JOIN (SELECT doc_id, string_agg(s, chr(10) || chr(10) ORDER BY para) AS text FROM part GROUP BY doc_id) USING (doc_id)) """.replace("src_doc d", "(SELECT doc_id FROM src_doc)"),
        o.segments("zh"), o.stats([]), o.hits(GENERAL), o.flags(), o.score(GENERAL).replace("part AS (", "parted AS (").replace("FROM part)", "FROM parted)"), select="SELECT doc_id, index AS after, n_formal FROM score LEFT JOIN (SELECT doc_id, count(*) AS n_formal FROM hit WHERE NOT is_hint GROUP BY doc_id) USING (doc_id)")
    before = o.with_(*_SCORED, select="SELECT doc_id, index AS before, n_formal FROM score LEFT JOIN (SELECT doc_id, count(*) AS n_formal FROM hit WHERE NOT is_hint GROUP BY doc_id) USING (doc_id)")
    return f"SELECT doc_id, {o.scaled('before')} AS before, {o.scaled('after')} AS after, coalesce(b.n_formal, 0) AS hits_before, coalesce(a.n_formal, 0) AS hits_after FROM ({before}) b LEFT JOIN ({after}) a USING (doc_id)"


@query(_attacked_sql())
def attacked(spark, sf_dir):
    """The index and the hits before and after the advice is taken."""
    docs = zh_docs(spark, sf_dir)
    told = lambda d, name: score.analyzed(d, GENERAL).select("doc_id", scaled(F.col("index")).alias(name), (F.col("high") + F.col("medium") + F.col("low")).alias(f"hits_{name}"))
    after = told(rewrite.attacked(docs, segment.sentences(docs), PERSONAL), "after")
    return told(docs, "before").join(after, "doc_id", "left").na.fill(0, ["hits_after"])


# -- collection, drift, mining ------------------------------------------------

_MONTH = "CASE WHEN doc_id % 94 < 47 THEN '2026-08' ELSE '2026-09' END"
#: Small groups, so that some drift.
_PROFILE = "concat('p', doc_id % 47)"
_SAMPLE_SQL = f"""
found AS (SELECT doc_id, rule_id FROM hit WHERE NOT is_hint UNION SELECT doc_id, rule_id FROM whole),
sample AS (
    SELECT doc_id, {_PROFILE} AS profile, {_MONTH} AS month, CAST(round_even(index, 0) AS INTEGER) AS score, coalesce(f, CAST([] AS VARCHAR[])) AS findings
    FROM score LEFT JOIN (SELECT doc_id, list_sort(list_distinct(list(rule_id))) AS f FROM found GROUP BY doc_id) USING (doc_id)
), twice AS (SELECT profile, unnest([month, '*']) AS month, score, findings FROM sample)"""


def _samples(spark, sf_dir):
    """Scored documents with a profile and a month made of their ids."""
    rows = _index(spark, sf_dir).select("doc_id", F.bround("index", 0).cast("int").alias("score"), F.col("rule_ids").alias("findings"))
    return rows.select("doc_id", F.expr(_PROFILE).alias("profile"), F.expr(_MONTH).alias("month"), "score", "findings")


@query(o.with_(*_SCORED, o.doc_rules(GENERAL), _SAMPLE_SQL, select=f"""
SELECT profile, month, count(*) AS n, {o.scaled('CAST(count(score) AS DOUBLE) / count(*)')} AS score_rate,
    list_sort(list(score) FILTER (score IS NOT NULL))[CAST(least(floor(count(score) * 0.5), count(score) - 1) AS INTEGER) + 1] AS p50,
    list_sort(list(score) FILTER (score IS NOT NULL))[CAST(least(floor(count(score) * 0.9), count(score) - 1) AS INTEGER) + 1] AS p90
FROM twice GROUP BY profile, month"""))
def drift_groups(spark, sf_dir):
    return collect.drift_groups(_samples(spark, sf_dir)).withColumn("score_rate", scaled(F.col("score_rate")))


@query(o.with_(*_SCORED, o.doc_rules(GENERAL), _SAMPLE_SQL, select=f"""
SELECT profile, month, rule_id, {o.scaled('CAST(k AS DOUBLE) / n')} AS rate FROM (SELECT profile, month, rule_id, count(*) AS k FROM (SELECT profile, month, unnest(findings) AS rule_id FROM twice) GROUP BY ALL) JOIN (SELECT profile, month, count(*) AS n FROM twice GROUP BY ALL) USING (profile, month)"""))
def drift_rules(spark, sf_dir):
    return collect.drift_rules(_samples(spark, sf_dir)).withColumn("rate", scaled(F.col("rate")))


def _sql_side(month: str, name: str) -> str:
    g = "list_sort(list(score) FILTER (score IS NOT NULL))[CAST(least(floor(count(score) * {p}), count(score) - 1) AS INTEGER) + 1]"
    return f"""{name} AS (SELECT profile, CAST(count(score) AS DOUBLE) / count(*) AS score_rate, {g.format(p=0.5)} AS p50, {g.format(p=0.9)} AS p90, count(*) AS n FROM sample WHERE month = '{month}' GROUP BY profile),
{name}_rule AS (SELECT profile, rule_id, CAST(count(*) AS DOUBLE) / any_value(n) AS rate FROM (SELECT profile, unnest(findings) AS rule_id FROM sample WHERE month = '{month}') JOIN {name} USING (profile) GROUP BY profile, rule_id)"""


@query(o.with_(*_SCORED, o.doc_rules(GENERAL), _SAMPLE_SQL, _sql_side("2026-08", "a"), _sql_side("2026-09", "b"), select=f"""
SELECT profile, signal, {o.scaled('before')} AS before, {o.scaled('after')} AS after FROM (
    SELECT profile, 'p50' AS signal, CAST(a.p50 AS DOUBLE) AS before, CAST(b.p50 AS DOUBLE) AS after FROM a JOIN b USING (profile) WHERE abs(b.p50 - a.p50) >= 15
    UNION ALL SELECT profile, 'p90', a.p90, b.p90 FROM a JOIN b USING (profile) WHERE abs(b.p90 - a.p90) >= 15
    UNION ALL SELECT profile, 'score_rate', a.score_rate, b.score_rate FROM a JOIN b USING (profile) WHERE abs(b.score_rate - a.score_rate) >= 0.2
    UNION ALL SELECT profile, rule_id, coalesce(a_rule.rate, 0.0), b_rule.rate FROM b_rule JOIN a USING (profile) LEFT JOIN a_rule USING (profile, rule_id) WHERE abs(b_rule.rate - coalesce(a_rule.rate, 0.0)) >= 0.1)"""))
def drift_signals(spark, sf_dir):
    return _rounded(collect.drift_signals(_samples(spark, sf_dir), "2026-08", "2026-09"), ("before", "after"))


@query(o.with_(*_SCORED, o.doc_rules(GENERAL), _SAMPLE_SQL, select="""
SELECT doc_id, text, substr(sha256(text), 1, 16) AS text_sha256, CAST(round_even(index, 0) AS INTEGER) AS score, array_to_string(findings, ',') AS findings, n_chars
FROM (SELECT doc_id, replace(text, '13800138000', '【手机号】') AS text FROM zh_doc) JOIN score USING (doc_id) JOIN (SELECT doc_id, findings FROM sample) USING (doc_id)"""))
def samples(spark, sf_dir):
    out = collect.samples(None, score.analyzed(zh_docs(spark, sf_dir), GENERAL, texts=True), "general", "2026-09")
    return out.select("doc_id", "text", "text_sha256", "score", F.array_join("findings", ",").alias("findings"), "n_chars")


@query("""
SELECT o_orderkey, CASE WHEN m = 0 THEN '证件【身份证号】。' WHEN m = 1 THEN '电话【手机号】，邮箱【邮箱】。' WHEN m = 2 THEN '卡【卡号】号。' ELSE '单号' || CAST(o_orderkey AS VARCHAR) || '。' END AS text
FROM (SELECT o_orderkey, o_orderkey % 4 AS m FROM orders)""")
def pii_masked(spark, sf_dir):
    k = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    m = F.col("o_orderkey") % 4
    text = (
        F.when(m == 0, F.concat(F.lit("证件11010119"), k, F.lit("X。"))).when(m == 1, F.concat(F.lit("电话13"), k, F.lit("，邮箱u."), k, F.lit("@mail.example.com。")))
        .when(m == 2, F.concat(F.lit("卡62220000"), k, k, F.lit("号。"))).otherwise(F.concat(F.lit("单号"), F.col("o_orderkey").cast("string"), F.lit("。")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", mask_pii(text).alias("text"))


_GRAMS = """
gram_of AS (
    SELECT doc_id, unnest(list_distinct(list_concat(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)), list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6))))) AS gram
    FROM (SELECT doc_id, regexp_replace(text, """ + o.lit(o.BARE) + """, '', 'g') AS t FROM zh_doc)
), df AS (SELECT gram, count(*) FILTER (doc_id % 3 = 0) AS df_1, count(*) FILTER (doc_id % 3 <> 0) AS df_0 FROM gram_of GROUP BY gram HAVING count(*) >= 2)"""


def _phrases(spark, sf_dir):
    return mining.phrase_df(zh_docs(spark, sf_dir).withColumn("label", (F.col("doc_id") % 3 == 0).cast("int")), [4, 6])


@query(o.with_(o.zh(), _GRAMS, select="SELECT gram, df_1, df_0 FROM df"))
def phrase_df(spark, sf_dir):
    return _phrases(spark, sf_dir)


SIZES = [3, 4, 5, 6, 7, 8]


@query(o.with_(o.zh(), "gram_of AS (SELECT doc_id, unnest(list_distinct(flatten([" + ", ".join(f"list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i, {n}))" for n in SIZES) + "]))) AS gram FROM (SELECT doc_id, regexp_replace(text, " + o.lit(o.BARE) + ", '', 'g') AS t FROM zh_doc))", """
df AS (SELECT gram, count(*) FILTER (doc_id % 3 = 0) AS df_1, count(*) FILTER (doc_id % 3 <> 0) AS df_0 FROM gram_of GROUP BY gram HAVING count(*) >= 2),
size AS (SELECT count(*) FILTER (doc_id % 3 = 0) AS n1, count(*) FILTER (doc_id % 3 <> 0) AS n0 FROM zh_doc),
candidate AS (SELECT gram, df_1 FROM df, size WHERE df_1 >= 5 AND (CAST(df_1 AS DOUBLE) / n1) / greatest(CAST(df_0 AS DOUBLE) / n0, CAST(0.5 AS DOUBLE) / n0) >= 1.05)""", o.collapsed(SIZES), select="SELECT gram, df_1 FROM kept ORDER BY df_1 DESC, gram LIMIT 40"))
def phrase_report(spark, sf_dir):
    """The forty most telling phrases, a report of the top."""
    docs = zh_docs(spark, sf_dir).withColumn("label", (F.col("doc_id") % 3 == 0).cast("int"))
    n = docs.select(F.sum("label"), F.count("*")).first()
    best = mining.phrase_ratio(mining.phrase_df(docs, SIZES), n[0], n[1] - n[0]).where("df_1 >= 5 and ratio >= 1.05")
    return mining.collapse(best, SIZES).orderBy(F.desc("df_1"), "gram").limit(40)


@query(o.with_(o.zh(), select=f"""
SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6))) AS gram FROM (SELECT doc_id, regexp_replace(text, {o.lit(o.BARE)}, '', 'g') AS t FROM zh_doc WHERE doc_id % 5 <> 0))
WHERE gram IN (SELECT unnest(list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6))) FROM (SELECT regexp_replace(text, {o.lit(o.BARE)}, '', 'g') AS t FROM zh_doc WHERE doc_id % 100 = 95))"""))
def leaks(spark, sf_dir):
    """Fragments of the private documents of a few customers in the public ones of others."""
    docs = zh_docs(spark, sf_dir)
    return mining.leaks(docs.where("doc_id % 100 = 95"), docs.where("doc_id % 5 <> 0"))


_AUDITED = ["赋能", "不得不说", "总之", "众所周知", "(形成|构建|打造).{0,4}闭环", "据悉", "值得(进一步|深入)"]


@query(o.with_(o.zh(), "pattern AS (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, {o.lit(p)} AS pattern FROM zh_sent WHERE regexp_matches(text, {o.lit(p)})" for p in _AUDITED) + ")", select=f"""
SELECT pattern, k1, k0, {o.scaled('ratio')} AS ratio, CASE WHEN k1 + k0 < 5 THEN 'undecided' WHEN ratio >= 5 THEN 'strong' WHEN ratio >= 2 THEN 'fair' WHEN ratio >= 1 THEN 'weak' ELSE 'reversed' END AS status
FROM (SELECT pattern, k1, k0, (CAST(k1 AS DOUBLE) / n1) / greatest(CAST(k0 AS DOUBLE) / n0, 0.5 / n0) AS ratio
    FROM (SELECT pattern, count(*) FILTER (doc_id % 3 = 0) AS k1, count(*) FILTER (doc_id % 3 <> 0) AS k0 FROM pattern GROUP BY pattern),
        (SELECT count(*) FILTER (doc_id % 3 = 0) AS n1, count(*) FILTER (doc_id % 3 <> 0) AS n0 FROM zh_doc))"""))
def pattern_audit(spark, sf_dir):
    docs = zh_docs(spark, sf_dir)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("label"))
    return mining.pattern_audit(segment.sentences(docs), labels, _AUDITED).withColumn("ratio", scaled(F.col("ratio")))


@query("""
SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND a.ts <= b.ts AND b.ts <= a.ts + INTERVAL 240 MINUTE""")
def prompt_outputs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", "event_type")
    return mining.interval_join(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", 240).select("user_id", "first_id", "then_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume(spark, sf_dir):
    """What is still to do: an anti join with what is done."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query(f"""
SELECT l_orderkey AS doc_id, {o.scaled('s / 1000.0 / n')} AS avg_nll, {o.scaled('exp(least(s / 1000.0 / n, 50.0))')} AS ppl, n AS n_tokens
FROM (SELECT l_orderkey, CAST(sum(CAST(l_partkey % 7000 AS BIGINT)) AS DOUBLE) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def ppl_stats(spark, sf_dir):
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 7000).alias("nll"))
    g = perplexity.ppl_stats(tokens, ["doc_id"])
    mean = F.col("avg_nll") * F.col("n_tokens") / 1000.0 / F.col("n_tokens")
    return g.select("doc_id", scaled(mean).alias("avg_nll"), scaled(F.exp(F.least(mean, F.lit(50.0)))).alias("ppl"), "n_tokens")


_MINED = ["赋能", "标志着", "昔有", "的灯", "[，、].{1,4}[，、]", "你们", "。。", "(上|下)一段", "老周(说|喊)"]


@query(o.with_(o.zh(), "size AS (SELECT count(*) FILTER (doc_id % 3 = 0) AS n1, count(*) FILTER (doc_id % 3 <> 0) AS n0 FROM zh_doc)", "found AS (" + " UNION ALL ".join(f"SELECT {o.lit(p)} AS pattern, doc_id FROM zh_doc WHERE regexp_matches(text, {o.lit(p)})" for p in _MINED) + ")", select=f"""
SELECT pattern, k1, k0, {o.scaled('d')} AS difference FROM (
    SELECT pattern, k1, k0, CAST(k1 AS DOUBLE) / n1 - CAST(k0 AS DOUBLE) / n0 AS d FROM (SELECT pattern, count(*) FILTER (doc_id % 3 = 0) AS k1, count(*) FILTER (doc_id % 3 <> 0) AS k0 FROM found GROUP BY pattern), size) WHERE abs(d) >= 0.01"""))
def pattern_mining(spark, sf_dir):
    docs = zh_docs(spark, sf_dir).withColumn("label", (F.col("doc_id") % 3 == 0).cast("int"))
    return _rounded(mining.pattern_mining(docs, _MINED), ("difference",))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY month")
def months(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


# -- renderers -----------------------------------------------------------------


@query(o.with_(o.zh(), o.hits(GENERAL), select=r"""
SELECT doc_id, CAST(para AS INTEGER) AS para, rule_id, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
    sha1(rule_id || chr(31) || CAST(para AS VARCHAR) || chr(31) || sentence) AS fingerprint FROM hit WHERE NOT is_hint"""))
def sarif_rows(spark, sf_dir):
    return report.sarif_results(_hits(spark, sf_dir).where("not is_hint")).select("doc_id", "para", "rule_id", "level", "fingerprint")


@query(o.with_(o.zh(between="\n"), o.text_lines("zh"), o.hits(GENERAL), r"""
needle AS (SELECT DISTINCT doc_id, sentence, substr(regexp_replace(sentence, '[^\p{L}\p{N}]', '', 'g'), 1, 16) AS k FROM hit WHERE NOT is_hint),
plain AS (SELECT doc_id, line, regexp_replace(raw, '[^\p{L}\p{N}]', '', 'g') AS t FROM zh_line),
start AS (SELECT doc_id, sentence, min(line) AS start_line FROM needle JOIN plain USING (doc_id) WHERE length(k) >= 4 AND contains(t, k) GROUP BY doc_id, sentence)""", select="SELECT doc_id, para, pos, rule_id, start_line FROM hit LEFT JOIN start USING (doc_id, sentence) WHERE NOT is_hint"))
def sarif_start_lines(spark, sf_dir):
    return report.placed(zh_docs(spark, sf_dir, between="\n"), GENERAL).select("doc_id", "para", "pos", "rule_id", "start_line")


@query(o.with_(*_SCORED, o.doc_rules(GENERAL), _ORDERED, select="""
SELECT doc_id, score.n_sentences AS n_sentences, note, coalesce(n_findings, 0) AS n_findings, coalesce(n_hints, 0) AS n_hints, first_rule, first_sentence FROM score LEFT JOIN (
    SELECT doc_id, CAST(count(*) FILTER (NOT is_hint) AS INTEGER) AS n_findings, CAST(count(*) FILTER (is_hint) AS INTEGER) AS n_hints, arg_min(rule_id, ord) FILTER (NOT is_hint) AS first_rule, arg_min(sentence, ord) FILTER (NOT is_hint) AS first_sentence FROM ordered GROUP BY doc_id) USING (doc_id)"""))
def json_reports(spark, sf_dir):
    """What the JSON of each report says when read back."""
    docs = zh_docs(spark, sf_dir)
    made = report.json_reports(score.analyzed(docs, GENERAL), rules.findings(docs, GENERAL))
    item = "array<struct<rule_id: string, sentence: string>>"
    read = made.select("doc_id", F.from_json("report", f"n_sentences long, note string, findings {item}, hints {item}").alias("r")).select("doc_id", "r.*")
    first = F.get("findings", F.lit(0))
    return read.select("doc_id", "n_sentences", "note", F.size("findings").alias("n_findings"), F.size("hints").alias("n_hints"), first["rule_id"].alias("first_rule"), first["sentence"].alias("first_sentence"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents WHERE text IS NOT NULL")
def digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", sha_prefix(F.col("text")).alias("digest"))
