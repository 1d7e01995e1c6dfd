"""A document's facts in one call, against the same from rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from penstrata.functions import windows
from penstrata.functions.text import LINE_BREAK, SPACE
from penstrata.operators import bydoc, collect, evaluate, rewrite, rules, score
from penstrata.operators.facts import by_rows, facts
from penstrata.operators.segment import LATIN, ZH
from penstrata.packs import PROFILES, load, pack
from penstrata.plans import report
from penstrata.sources.synthetic import BANK, SPECIAL

ODD = list("一二。！？；…!?;.””』」“『「\"\"，、：—— —\n\n\n\r\x85 \t  　-*+#>|=`~_[]()0123ａwx@.:/1、)抄送主送的地得乎哉😀")
MARKS = ["http://a.b/c ", "www.x.y", "- ", "1. ", "* [x] ", "| a | b |", "|---|---|", "```\n", "![a](b)", "[a](b)", "**中文**", "a@b.co", "首先，", "wwW.q", "ſ://", "٣. "]


def odd(n: int) -> list:
    r = random.Random(7)
    return [None, "", *SPECIAL, *["".join(r.choice(ODD + MARKS + BANK[:12]) for _ in range(r.randint(0, 60))) for _ in range(n)]]


@pytest.mark.parametrize("profile,config", [("general", ZH), ("personal", ZH), ("academic", LATIN)])
def test_one_call_gives_what_rows_give(spark, profile, config):
    docs = spark.createDataFrame(list(enumerate(odd(400))), "doc_id long, text string")
    p = load(profile)
    a, b = facts(docs, p, config=config, flags=True), by_rows(docs, p, p.lexicon, config, flags=True)
    columns = [c for c in a.columns if c not in bydoc.SUMS]
    rows = lambda df: {r.doc_id: r for r in df.select(columns).collect()}
    assert rows(a) == rows(b)


def test_analysis_makes_no_row_of_a_line_or_sentence(spark):
    docs = spark.createDataFrame([(1, "总之赋能。" * 9)], "doc_id long, text string")
    plan = score.analyzed(docs, load("general"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("ArrowEvalPython") == 1


def test_rules_of_all_packs_are_read_and_others_left_to_spark(spark):
    assert all(bydoc.supports(load(p), load(p).lexicon) for p in PROFILES)
    assert bydoc.translated(r"a\s.[.\s]") == f"a[{bydoc._SPACES}]{bydoc._ANY}[.{bydoc._SPACES}]"
    assert [bydoc.translated(p) for p in (r"\p{L}", "(?i)x", r"\bx", "[a&&b]", "[a[b]]", "(", "(?<=x)y")] == [None] * 7
    own = pack("own", [{"id": "X-1", "name": "x", "scope": "sentence", "severity": "high", "patterns": [r"(?i)\p{Lu}B"]}])
    docs = spark.createDataFrame([(1, "ab。平常话。")], "doc_id long, text string")
    assert [h["matches"] for h in facts(docs, own).first().found] == [["ab"]]


def test_many_sentences_are_searched_as_few_are():
    texts = odd(2 * bydoc.FEW)[2:]
    for profile in PROFILES:
        one, all_ = bydoc.Judge(load(profile), [], True), bydoc.Judge(load(profile), [], True)
        for t in texts:
            one.learn([t])
        all_.learn(texts)
        assert one.known == all_.known


def test_advice_searches_rules_once_for_a_batch(spark):
    texts = [*odd(200), *BANK]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line long, text string")
    p = load("personal")
    any_of = {r.id: sum((F.col("text").rlike(x).cast("int") for x in r.patterns), F.lit(0)) > 0 for r in p.of_scope("sentence")}
    plain = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in any_of.items()]))
    got = rows.select(rewrite.rules_hit(p, F.col("text")).alias("a"), plain.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(map(len, (r.a for r in got))) > 50
    plan = rewrite.advised(rows, p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and not any(f", {x})" in plan for r in p.of_scope("sentence") for x in r.patterns)


def test_texts_are_put_together_for_their_sums(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("ab一二三😀\U0010ffff"[: r.randint(1, 7)]) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 100, 101, 102, 400]))) for _ in range(300)]
    want, alone, one = [windows.window_sums(t) for t in texts], [], windows.window_sums
    monkeypatch.setattr(windows, "window_sums", lambda t: alone.append(t) or one(t))
    assert windows.sums_of(texts) == want and max(map(len, alone)) < 2
    monkeypatch.setattr(windows, "TOGETHER", 300)
    assert windows.sums_of(texts) == want and windows.sums_of([]) == []


def test_python_cuts_lines_and_white_space_as_listed():
    every = [chr(c) for c in range(0x110000)]
    assert {c for c in every if c.isspace()} == {c for c in every if not c.strip()} == set(SPACE)
    assert {c for c in every if len(f"a{c}a".splitlines()) > 1} == {c for c in every if re.search(LINE_BREAK, c)} and "a\r\na".splitlines() == ["a", "a"]
    assert {c for c in every if re.match(r"\d", c)} == {c for c in every if c.isdecimal()}


@pytest.mark.parametrize("config", [ZH, LATIN])
def test_plain_lines_are_taken_without_a_test_of_their_marks(spark, monkeypatch, config):
    r = random.Random(11)
    some = [*"一二。！？；.””』」“『「\"，— \n\n\n\r\x85\u3000\x1f-+#>=_~03٣ａ、)的乎哉抄送\ue100\ue101\ue106\ue107", *BANK[:12], "- ", "1. ", "\n> ", "> - ", "\n~~~\n", "——", "===\n"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 50))) for _ in range(400)]
    docs, p = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), load("academic")
    a, b = facts(docs, p, config=config, flags=True), by_rows(docs, p, p.lexicon, config, flags=True)
    rows = lambda df: {x.doc_id: x for x in df.select([c for c in a.columns if c not in bydoc.SUMS]).collect()}
    assert rows(a) == rows(b)
    tested, typed = [], bydoc.typed
    monkeypatch.setattr(bydoc, "typed", lambda s, coded: tested.append(s) or typed(s, coded))
    assert bydoc.units("平常话。\n又一句。\n\n- 一项。", ZH) == [(0, "para", [(0, "平常话。\n又一句。")]), (1, "list", [(3, "一项。")])] and tested == ["- 一项。"]


@pytest.mark.parametrize("profile", ["general", "academic"])
def test_hits_alone_are_found_without_the_other_facts(spark, profile):
    docs = spark.createDataFrame(list(enumerate(odd(300))), "doc_id long, text string")
    p = load(profile)
    rows = lambda df: {r.doc_id: r.found for r in df.collect()}
    assert rows(facts(docs, p, need=("found",))) == rows(facts(docs, p).select("doc_id", "found"))
    judge, cut = bydoc.Judge(p, [], False), [(0, "para", [(0, 0, "首先，核对单据。")])]
    judge.learn(["首先，核对单据。"])
    for shapes in ([], [3]):
        assert bydoc.found_of(cut, judge.known, shapes, 40)["found"] == bydoc.fact(cut, judge.known, shapes, 40, False, ["found"])["found"]


def counted(spark, rows, schema, column):
    """A table of which ``column`` counts how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda x: (seen.add(1), x)[1], dict(x.split() for x in schema.split(", "))[column]).asNondeterministic()
    return spark.createDataFrame(rows, schema).withColumn(column, touch(column)), seen


def test_drift_signals_compute_their_samples_once(spark):
    rows = [("p", m, s, ["A"] * (s > 50)) for m, s in (("1", 10), ("1", 20), ("2", 60), ("2", 80))]
    df, seen = counted(spark, rows, "profile string, month string, score int, findings array<string>", "score")
    assert {r.signal for r in collect.drift_signals(df, "1", "2").collect()} == {"p50", "p90", "A"} and seen.value == len(rows)


def test_length_tiers_compute_their_rows_once(spark):
    rows = [(n, v, y) for n, v, y in ((10, 0.1, 0), (20, 0.3, 1), (400, 0.2, 0), (900, 0.5, 1))]
    df, seen = counted(spark, rows, "n_chars long, v double, y int", "v")
    got = {r.band: (r.n, r["median"], r.auroc) for r in evaluate.length_tiers(df, "v", "y").collect()}
    assert got == {"short": (2, 0.3, 1.0), "mid": (1, 0.2, None), "long": (1, 0.5, None)} and seen.value == len(rows)


def test_samples_and_start_lines_read_documents_once(spark):
    docs = spark.createDataFrame([*enumerate(odd(300)), (3, "又一份。"), (3, None), (4, "- 1. 首先，核对单据。\r\n首先，核对单据。")], "doc_id long, text string")
    p = load("general")
    rows = lambda df: sorted(map(str, df.collect()))
    one = collect.samples(None, score.analyzed(docs, p, texts=True), "general", "m")
    assert rows(one) == rows(collect.samples(docs, score.analyzed(docs, p), "general", "m"))
    placed = report.placed(docs, p)
    want = report.start_lines(rules.rule_hits(docs, p).where("not is_hint"), rewrite.text_lines(docs))
    assert rows(placed) == rows(want.select(placed.columns)) and want.where("start_line > 1").count()
    for df in (one, placed):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("LogicalRDD") == 1
