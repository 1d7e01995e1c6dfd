"""Rules, gate, domain, index and advice on exemplars."""

import math
from dataclasses import replace

import pytest

from penstrata.operators import compare, domain, rewrite, rules, score, segment
from penstrata.operators.facts import facts
from penstrata.packs import PROFILES, load, pack


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_packs_load():
    assert {p: len(load(p).rules) for p in PROFILES} == {"academic": 18, "essay": 7, "general": 8, "news": 7, "official": 6, "personal": 16, "review": 3}
    assert load("essay").lexicon == [] and "扎实推进" in load("official").lexicon
    with pytest.raises(ValueError):
        pack("x", [{"id": "A", "name": "a", "scope": "nowhere"}])
    with pytest.raises(ValueError):
        load("nothing")


def test_gate_and_order(spark):
    text = "不得不说很好。总之赋能。以上就是全部。众所周知。" + "平常话。" * 6
    found = rules.findings(docs(spark, [text, "总之很好。" + "平常话。" * 8]), load("general")).orderBy("doc_id", "ord").collect()
    first = [(r.rule_id, r.is_hint) for r in found if r.doc_id == 0 and r.para >= 0]
    assert first == [("G-INTERACT-01", False), ("G-HYPE-01", False), ("G-SAFE-01", False), ("G-SAFE-01", False), ("G-SAFE-01", False)]
    assert [(r.rule_id, r.is_hint) for r in found if r.doc_id == 1 and r.para >= 0] == [("G-SAFE-01", True)]
    assert [r.rule_id for r in rules.at_least(rules.findings(docs(spark, [text]), load("general")), "high").collect()] == ["G-INTERACT-01"]


def test_first_match_per_pattern_and_no_match_without_content(spark):
    hits = rules.rule_hits(docs(spark, ["赋能赋能底层逻辑。", "！！！"]), load("general")).collect()
    assert [(r.rule_id, r.matches) for r in hits] == [("G-HYPE-01", ["赋能", "底层逻辑"])]
    assert rules.rule_hits(docs(spark, ["！！！"]), load("official")).count() == 0


def test_tiers_of_thresholds_and_models(spark):
    r = next(r for r in load("academic").rules if r.id == "D-UNIF-01")
    df = spark.createDataFrame([(299,), (300,), (599,), (600,)], "n_chars int")
    assert [x.t for x in df.select(rules.threshold_of(r, df.n_chars).alias("t")).collect()] == [0.30, 0.33, 0.33, 0.37]
    got = [x.t for x in df.select(score.coefficient(load("academic").scoring, "ttr", df.n_chars).alias("t")).collect()]
    assert got == [83.377, 83.377, 83.377, 89.2265]


def test_domain_kinds(spark):
    classical = "夫君子者乎，皆万物之逆旅矣。" * 8
    verse = "白日依山尽，黄河入海流。" * 8
    english = "This is an English text without any Chinese in it at all, and it goes on and on. " * 2
    official = "现将有关情况通知如下。" * 9
    got = {r.doc_id: r for r in domain.domain_flags(facts(docs(spark, [classical, verse, english, official, "短。"]), flags=True)).collect()}
    assert got[0].kinds == ["classical"] and got[1].kinds == ["verse"]
    assert got[2].kinds == ["non-chinese"] and got[3].kinds == ["officialese"] and got[4].kinds == []


def test_index_by_hand_and_notes(spark):
    p = load("general")
    text = "".join(f"第{i}句话说得不长不短" + "很" * (i % 5) + "。" for i in range(12)) + "总之赋能。"
    rows = score.analyzed(docs(spark, [text, "短。", "！！！", "English words only in here, nothing else to see. " * 12]), p).collect()
    by = {r.doc_id: r for r in rows}
    r, s = by[0], p.scoring
    z = s["intercept"] + s["hit_density"] * (3.0 / r.n_sentences) + s["sentence_cv"] * r.sentence_cv + s["ttr"] * r.ttr + s["ngram_repeat"] * r.ngram_repeat
    assert r["index"] == pytest.approx(100 / (1 + math.exp(-max(-30, min(30, z))))) and r.note is None
    assert by[1]["index"] is None and by[2].note == "no valid text" and by[3].note == "not Chinese"
    unscored = score.analyzed(docs(spark, [text]), load("review")).first()
    assert unscored["index"] is None and unscored.note == "profile not calibrated"
    official = score.analyzed(docs(spark, ["现将方案印发给你们，请认真执行到位。" * 10]), load("official")).first()
    assert official.note == "genre not calibrated" and official.kinds == ["issuance-notice"]


def test_documents_are_scanned_once(spark, tmp_path):
    """Segmentation, hits, kinds, statistics and index come from one scan without a join."""
    docs(spark, ["总之赋能。" * 9]).write.parquet(str(tmp_path / "d"))
    rows = score.analyzed(spark.read.parquet(str(tmp_path / "d")), load("academic"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("hashpartitioning") == 1


def test_a_genre_may_have_a_model_of_its_own(spark):
    text = "现将方案印发给你们，请认真执行到位。" + "渡船一天开两班，价钱不变。" * 9
    p = replace(load("official"), scoring={**load("official").scoring, "genres": {"issuance-notice": {"intercept": 1.0, "ttr": 2.0}}})
    r = score.analyzed(docs(spark, [text]), p).first()
    assert r.note is None and r["index"] == pytest.approx(100 / (1 + math.exp(-(1 + 2 * r.ttr)))) and r.c_hit_density is None


def test_findings_by_sentence_and_prose(spark):
    text = "总之赋能，赋能。欢迎在评论区说总之。" + "平常话不长。" * 7 + "总之赋能，赋能。"
    pack = load("general")
    found = rules.findings(docs(spark, [text]), pack)
    got = [(r.sentence, r.top, r.rule_ids, r.times, r.explained) for r in rules.grouped(found).orderBy("ord").collect()]
    assert got == [
        ("欢迎在评论区说总之。", "high", ["G-INTERACT-01", "G-SAFE-01"], 2, ["G-INTERACT-01", "G-SAFE-01"]),
        ("总之赋能，赋能。", "medium", ["G-HYPE-01", "G-SAFE-01"], 4, ["G-HYPE-01"]),
    ]
    told = rules.with_prose(found, pack).where("rule_id = 'G-HYPE-01'").first()
    assert told.name == "hot words" and told.why and told.advice
    single = rules.findings(docs(spark, ["总之很好。" + "平常话。" * 8]), pack)
    assert [r.place for r in rules.first_hints(single).collect()] == [1]
    assert all(r.why and r.advice for p in PROFILES for r in load(p).rules)


def test_pack_heat(spark):
    rows = rules.para_heat(facts(docs(spark, ["总之赋能。平常话。\n\n平常话。\n\n以上就是全部。"]), load("general")), load("general")).orderBy("para").collect()
    assert [(r.para, r.n_sents, r.density, r.level, r.excerpt) for r in rows] == [(0, 2, 1.5, "high", "总之赋能。"), (2, 1, 3.0, "high", "以上就是全部。")]


def test_sorted_batch_and_diff(spark):
    rows = spark.createDataFrame([(1, 10, 0), (2, None, 9), (3, 10, 4), (4, 90, 1)], "doc_id long, index int, findings long")
    assert [r.doc_id for r in compare.sorted_batch(rows).collect()] == [4, 3, 1, 2]
    diff = spark.createDataFrame([("A", 1, 0, "gone"), ("B", 0, 1, "new"), ("C", 1, 4, "worse"), ("D", 1, 2, "worse")], "rule_id string, before int, after int, status string")
    assert [r.rule_id for r in compare.sorted_diff(diff).collect()] == ["B", "C", "D", "A"]


def test_the_advice_against_the_index(spark):
    """Lines that the advice drops or shortens leave fewer hits; paragraphs stay."""
    text = "深夜的你，把书桌收拾了。点击按钮选择文件。\n\n总之赋能。" + "平常话说得不多。" * 9
    d = docs(spark, [text, "平常话。"])
    after = {r.doc_id: r.text for r in rewrite.attacked(d, segment.sentences(d), load("personal")).collect()}
    assert after[0].startswith("把书桌收拾了。\n\n总之赋能。") and after[1] == "平常话。"


def test_diff(spark):
    rows = lambda xs: spark.createDataFrame([(0, x) for x in xs], "doc_id long, rule_id string")
    got = {r.rule_id: (r.before, r.after, r.status) for r in compare.rule_diff(rows(["A", "B", "B", "C", "D"]), rows(["B", "C", "C", "D", "E"])).collect()}
    assert got == {"A": (1, 0, "gone"), "B": (2, 1, "better"), "C": (1, 2, "worse"), "E": (0, 1, "new")}


ADVICE = {
    "DDL是明天，你已经很棒了！": ("delete", None),
    "实测失败率降到3%，别急，慢慢来，总会好的": ("keep", None),
    "论文写完了，就是最好的礼物": ("rewrite", "论文写完了。"),
    "深夜的你，把书桌收拾了": ("rewrite", "把书桌收拾了。"),
    "综上所述，路还长": ("rewrite", "路还长。"),
    "点击按钮选择文件": ("delete", None),
    "今天买了咖啡": ("keep", None),
    "这波稳": ("delete", None),
}


def test_rewrite_advice(spark):
    d = docs(spark, ["\n".join(f"- {t}" if i % 2 else t for i, t in enumerate(ADVICE))])
    advice = rewrite.advised(rewrite.text_lines(d), load("personal"))
    got = {r.text: (r.action, r.candidate) for r in advice.collect()}
    assert got == ADVICE
    draft = rewrite.applied(d, advice).first().text.split("\n")
    assert draft == ["- 实测失败率降到3%，别急，慢慢来，总会好的", "论文写完了。", "把书桌收拾了。", "路还长。", "今天买了咖啡"]


def test_all_packs_meet_the_documents_in_one_pass(spark):
    from penstrata.plans.registry import QUERIES

    plan = QUERIES["pack_hits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("lineitem.parquet") == 1


def test_the_decision_on_a_line_is_no_filter(spark):
    """A filter on the action is pushed below the decision, which it then makes again for each mention of it."""
    d = docs(spark, ["深夜的你，把书桌收拾了。", "点击按钮选择文件。"])
    rows = rewrite.attacked(d, segment.sentences(d), load("personal"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "RLIKE" in x]
    assert {r.doc_id for r in rows.where("text <> ''").collect()} == {0}


def test_flags_of_a_pattern_stay_with_it(spark):
    own = pack("own", [{"id": "A", "name": "a", "scope": "sentence", "severity": "high", "patterns": ["(?i)abc", "XYZ", "q|r"]}])
    got = rules.rule_hits(docs(spark, ["xyz。ABC。XYZ。r。"]), own).orderBy("pos").collect()
    assert [(r.pos, r.matches) for r in got] == [(1, ["ABC"]), (2, ["XYZ"]), (3, ["r"])]
