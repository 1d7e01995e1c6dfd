"""Collection, drift, mining, evaluation, sources, renderers and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from penstrata import cli
from penstrata.functions.text import mask_pii, page_links, page_text
from penstrata.operators import collect, evaluate, mining, perplexity
from penstrata.packs import load
from penstrata.plans import report
from penstrata.sources import readers
from penstrata.streaming import drift


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_masking(spark):
    assert one(spark, mask_pii, "号11010119900307123X电13812345678邮a.b@c.example卡6222000012345678901完") == "号【身份证号】电【手机号】邮【邮箱】卡【卡号】完"
    assert one(spark, mask_pii, "１１０１０１１９９００３０７１２３４ 99138123456780") == "【身份证号】 99138123456780"


def test_page_text(spark):
    assert one(spark, page_text, "<p>甲 &amp; 乙</p><script>x<y</script><div>丙<br>丁</div><!-- 戊 -->") == "甲 & 乙\n丙\n丁"


def test_drift(spark, tmp_path):
    rows = [("p", "1", 10 * i, ["A"] if i < 2 else []) for i in range(5)] + [("p", "2", 60 + i if i > 1 else None, ["A", "B"]) for i in range(5)]
    df = spark.createDataFrame(rows, "profile string, month string, score int, findings array<string>")
    g = {r.month: r for r in collect.drift_groups(df).collect()}
    assert (g["1"].n, g["1"].p50, g["1"].p90, g["2"].score_rate, g["2"].p50) == (5, 20, 40, 0.6, 63)
    assert g["*"].n == 10
    got = {r.signal: (r.before, r.after) for r in collect.drift_signals(df, "1", "2").collect()}
    assert got == {"p50": (20.0, 63.0), "p90": (40.0, 64.0), "score_rate": (1.0, 0.6), "A": (0.4, 1.0), "B": (0.0, 1.0)}
    # a rule that the new month lacks is not told, nor a profile without both months
    assert {r.signal for r in collect.drift_signals(df, "2", "1").collect()} == {"p50", "p90", "score_rate", "A"}
    assert collect.drift_signals(df.where("month = '2'"), "1", "2").count() == 0
    path = str(tmp_path / "baseline")
    collect.save_baseline(df, path)
    groups, rates = collect.load_baseline(spark, path)
    assert {tuple(r) for r in groups.collect()} == {tuple(r) for r in collect.drift_groups(df).collect()} and rates.count() == 5


def test_percentiles_and_ranks_by_bins(spark):
    """As sorting all of a group gives them, with nulls, ties, negative values, an empty and a null group."""
    import random

    rng = random.Random(1)
    rows = [(g, rng.choice([None, round(rng.gauss(0, 50), 1), 7.0])) for g in ("a", "b", None) for _ in range(200)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in collect.ranked_percentiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g in ("a", "b", None, "none"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        at = lambda p: own[min(int(len(own) * p), len(own) - 1)] if own else None  # noqa: E731, B023
        assert (got[g].n, got[g].known, got[g].p10, got[g].p50, got[g].p99) == (sum(k == g for k, _ in rows), len(own), at(0.1), at(0.5), at(0.99))
    labelled = [(v, rng.randrange(2)) for _, v in rows if v is not None]
    pairs = [(p > n) + (p == n) / 2 for p, a in labelled for n, b in labelled if a == 1 and b == 0]
    r = evaluate.auroc(spark.createDataFrame(labelled, "s double, y int").withColumn("g", F.lit(1)), ["g"], "s", "y").first()
    assert r.auroc == pytest.approx(sum(pairs) / len(pairs))


def test_folds_and_halves_go_round_in_the_order_of_the_digest(spark):
    import hashlib

    df = spark.range(300).withColumn("y", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2))
    got = {r.id: r.fold for r in evaluate.stratified_folds(df, ["y"], "id", 4).collect()}
    assert len(got) == 300
    for y in (None, 0, 1):
        own = sorted((i for i in range(300) if (None if i % 7 == 0 else i % 2) == y), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [got[i] for i in own] == [k % 4 for k in range(len(own))]
    halves = evaluate.half_split(df, "y", "id", 3).groupBy("y").agg(F.count_if(F.col("fold") == 0).alias("a"), F.count_if(F.col("fold") == 1).alias("b")).collect()
    assert all(0 <= r.a - r.b <= 1 for r in halves)


def test_calibration_tools(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 5).cast("string").alias("c"), (F.col("id") % 11 + 6.0 * (F.col("id") % 2)).alias("x"), F.rand(1).alias("z"), (F.col("id") * 2).alias("n_chars")).cache()
    held = evaluate.held_out_auroc(df, ["x", "z"], "y", "id", 2).collect()
    assert [r.seed for r in sorted(held)] == [0, 1] and all(r.auroc > 0.7 and r.n_pos == 100 for r in held)
    arms = {r.arm: r.auroc for r in evaluate.ablation(df, "y", {"x": ["x"], "both": ["x", "z"]}).collect()}
    assert arms["x"] > 0.7 and abs(arms["both"] - arms["x"]) < 0.1
    tiers = {r.band: r for r in evaluate.tier_fits(df, ["x"], "y").collect()}
    assert set(tiers) == {"short", "mid", "long"} and all(r.reliable and r.auroc > 0.7 for r in tiers.values())
    one_class = evaluate.tier_fits(df.where("y = 1"), ["x"], "y").collect()
    assert all(r.auroc is None and not r.reliable for r in one_class)
    few = df.where("c <> '4' or id < 20")
    assert {r.c: r.n for r in evaluate.channels(few, "y", "c").collect()} == {"0": 40, "1": 40, "2": 40, "3": 40}
    left = evaluate.leave_one_out(few, ["x"], "y", "c")
    assert left.where("y = 0").count() == 160 and left.where("y = 1 and fitted is null").count() == 0
    assert spark.range(1).select(evaluate.gate(F.lit(0.93), F.lit(0.89)), evaluate.gate(F.lit(0.93), F.lit(0.88))).first()[:] == ("PASS", "FAIL")


def test_tables_and_samples(spark):
    df = spark.createDataFrame([("m", 90), ("m", 80), ("m", 79), ("m", None), ("k", 10)], "model string, s int")
    got = {r.model: (r.n, r.median, r.p90, r.share_above) for r in evaluate.group_table(df, "model", "s").collect()}
    assert got == {"m": (3, 80, 90, pytest.approx(2 / 3)), "k": (1, 10, 10, 0.0)}
    fp = evaluate.false_positives(spark.createDataFrame([(["A", "B"],), ([],), (["A"],)], "rule_ids array<string>")).first()
    assert (fp.n, fp.flagged, fp.rules, fp.rate) == (3, 2, 3, pytest.approx(2 / 3))
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "doc_id long, text string")
    one, two = ([r.doc_id for r in evaluate.hash_sample(texts.repartition(n), "text", 5).collect()] for n in (1, 4))
    assert one == two and len(one) == 5
    docs = spark.createDataFrame([(0, "甲x", 1), (1, "甲", 1), (2, "乙", 0), (3, "乙甲", 0)], "doc_id long, text string, label int")
    assert [tuple(r) for r in mining.pattern_mining(docs, ["甲", "x", "乙|甲"]).orderBy("pattern").collect()] == [("x", 1, 0, 0.5), ("甲", 2, 1, 0.5)]


def test_corpus_profile_recon_pools_and_leaks(spark):
    rows = [("a", "甲乙，丙x"), ("a", "甲"), ("a", "abcd"), ("b", None), ("b", "，，")]
    got = {r.s: tuple(r)[1:] for r in evaluate.corpus_profile(spark.createDataFrame(rows, "s string, text string"), "s").collect()}
    assert got["a"] == (3, 10, 1, 4, 5, pytest.approx(1 / 3), 100.0) and got["b"][:5] == (2, 2, 2, 2, 2)
    lines = spark.createDataFrame([("p", "有1"), ("p", "无"), ("q", "2?")], "pool string, text string")
    assert {(r.feature, r.pool): (r.n, r.hits) for r in evaluate.pool_features(lines, "pool", {"digit": "[0-9]", "ask": "[?]"}).collect()} == {("digit", "p"): (2, 1), ("digit", "q"): (1, 1), ("ask", "p"): (2, 0), ("ask", "q"): (1, 1)}
    recon = spark.createDataFrame([("d", 1, 3.0, 0.0), ("d", 0, 1.0, 0.0), ("d", 0, 2.0, None)], "lang string, label int, x double, y double")
    assert {r.feature: r.auroc for r in evaluate.domain_recon(recon, "lang", "label", ["x", "y"]).collect()} == {"x": 1.0, "y": 0.5}
    private, public = ([(0, "甲乙丙丁戊己庚")], [(1, "说：甲乙，丙丁戊己！"), (2, "甲乙丙丁戊"), (3, None)])
    found = mining.leaks(*(spark.createDataFrame(x, "doc_id long, text string") for x in (private, public))).collect()
    assert [(r.doc_id, r.gram) for r in found] == [(1, "甲乙丙丁戊己")]


def test_perplexity_of_documents(spark):
    rows = [(1, i, float(p)) for i, p in enumerate([9, 3, 8, 1, 7, 2, 6, 5, 4, 10])] + [(2, 0, 1.0), (1, 99, None)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, ppl double")
    assert [tuple(r) for r in perplexity.ppl_features(df).collect()] == [(1, 10, 6.0, 2.0)]
    assert sorted((r.doc_id, r.pos) for r in perplexity.smoothest(df).collect()) == [(1, 3), (2, 0)]


def test_lines_mostly_of_cjk(spark):
    long = "这一行几乎全是汉字没有别的东西在里面凑够二十个字"
    df = spark.createDataFrame([(0, f"{long}\nshort\n{long} and a lot of English words follow it so that most is not\n短")], "doc_id long, text string")
    assert [r.text for r in readers.cjk_lines(df).collect()] == [long]


def test_page_blocks_and_links(spark):
    long = "这一段写得足够长，有三十个以上的汉字，因此会留在页面正文里，而导航和页脚的短句都不会留下来。"
    html = f"<div>首页</div><p>{long}</p><div>主办单位：{long}</div><a href='/a'>甲</a><a class=x href=\"/b\">乙</a><a href='/a'>丙</a><a href='#top'>丁</a><a href='javascript:go()'>戊</a>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(page_text(F.col("h"), least_cjk=30, furniture=False)).first()[0] == long
    assert df.select(page_links(F.col("h"))).first()[0] == ["/a", "/b"]


def test_auroc_with_ties(spark):
    rows = [(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1), (None, 1)]
    r = evaluate.auroc(spark.createDataFrame(rows, "s double, y int").withColumn("g", F.lit(1)), ["g"], "s", "y").first()
    assert (r.n_pos, r.n_neg, r.auroc) == (2, 2, 0.875)
    assert evaluate.auroc(spark.createDataFrame([(1.0, 1)], "s double, y int").withColumn("g", F.lit(1)), ["g"], "s", "y").first().auroc is None


def test_folds_are_balanced_and_fits_rank(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 2).cast("int")).withColumn("x", F.col("id") % 7 + 3.0 * F.col("y"))
    folds = evaluate.stratified_folds(df, ["y"], "id", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds} == {10}
    b, w = evaluate.logistic_fit(df, ["x"], "y")
    assert w["x"] > 0
    fitted = evaluate.apply_fit(df, b, w).withColumn("g", F.lit(1))
    assert evaluate.auroc(fitted, ["g"], "fitted", "y").first().auroc == pytest.approx(evaluate.auroc(fitted, ["g"], "x", "y").first().auroc)
    assert spark.range(1).select(evaluate.verdict(F.lit(0.5), F.lit(0.9), F.lit(0.9))).first()[0] == "genre model"


def test_phrases(spark):
    df = spark.createDataFrame([(0, "甲乙丙丁。甲乙丙丁", 1), (1, "甲乙丙丁", 1), (2, "甲乙丙戊", 0)], "doc_id long, text string, label int")
    got = {r.gram: (r.df_1, r.df_0) for r in mining.phrase_df(df, [3]).collect()}
    assert got == {"甲乙丙": (2, 1), "乙丙丁": (2, 0)}
    kept = mining.collapse(spark.createDataFrame([("甲乙丙丁", 10), ("乙丙", 12), ("丙丁", 30)], "gram string, df_1 long"), [2, 4]).collect()
    assert {r.gram for r in kept} == {"甲乙丙丁", "丙丁"}


def test_collapse_takes_any_number_of_candidates(spark):
    """As the greedy choice one by one, on more candidates than a thousand, where dropped ones drop none."""
    import random

    rng = random.Random(4)
    found = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(3, 8))): rng.randint(1, 40) for _ in range(6000)}
    assert len(found) > 2000
    kept = []
    for g in sorted(found, key=lambda g: -len(g)):
        if not any(g in k and found[g] <= 2 * found[k] for k in kept):
            kept.append(g)
    got = mining.collapse(spark.createDataFrame(list(found.items()), "gram string, df_1 long"), range(3, 9)).collect()
    assert {r.gram for r in got} == set(kept)


def test_interval_join_at_its_bounds(spark):
    a = spark.createDataFrame([("u", 1, "2024-01-01 00:04:59")], "k string, id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    b = spark.createDataFrame([("u", i, t) for i, t in enumerate(["2024-01-01 00:04:58", "2024-01-01 00:04:59", "2024-01-01 00:09:59", "2024-01-01 00:10:00"])], "k string, id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.then_id for r in mining.interval_join(a, b, "k", 5).collect()) == [1, 2]


def test_perplexity(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 99.0), (2, None)], "doc_id long, nll double")
    got = {r.doc_id: (round(r.ppl, 3), r.n_tokens) for r in perplexity.ppl_stats(df, ["doc_id"]).collect()}
    assert got[0] == (7.389, 2) and got[1][0] == pytest.approx(5.18e21, rel=0.01) and 2 not in got
    tokens = perplexity.token_nll(spark.createDataFrame([(0, 0, "ab"), (0, 1, "")], "doc_id long, pos int, text string"), lambda: lambda texts: [[1.0] * len(t) for t in texts])
    assert tokens.count() == 2


def _zip(name, xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, xml)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
T = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0"'


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿甲。".encode())
    (tmp_path / "b.md").write_bytes("乙。".encode("gb18030"))
    (tmp_path / "c.docx").write_bytes(_zip("word/document.xml", f"<w:document {W}><w:body><w:p><w:r><w:t>一</w:t><w:tab/><w:t>二</w:t><w:br/></w:r><w:del><w:r><w:t>删</w:t></w:r></w:del></w:p><w:p><w:r><w:t>三</w:t></w:r></w:p></w:body></w:document>"))
    (tmp_path / "d.odt").write_bytes(_zip("content.xml", f'<office:x {T}><text:h>题</text:h><text:p>四<text:s text:c="2"/>五<text:line-break/>六</text:p></office:x>'))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / ".hidden.txt").write_bytes(b"no")
    (tmp_path / "f.png").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.md", "c.docx", "d.odt", "e.docx"}
    assert (got["a.txt"][0], got["b.md"][0], got["c.docx"][0], got["d.odt"][0]) == ("甲。", "乙。", "一\t二\n\n三", "题\n四  五\n六")
    assert got["e.docx"][0] is None and "Zip" in got["e.docx"][1]
    assert readers.documents(readers.files(spark, str(tmp_path))).count() == 4


def test_line_formats(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).write_text("\n".join(rows))
        return str(tmp_path / name)

    s = {"type": collect.KIND, "time": "2026-01", "profile": "p", "text": "x", "score": 3, "findings": ["A"]}
    assert readers.samples(spark, put("s.jsonl", [json.dumps(s), "{bad", json.dumps(s | {"type": "other"}), ""]), collect.KIND).count() == 1
    assert readers.corpus_csv(spark, put("news_x.csv", ["text,other", '"' + "长" * 130 + '\n""引""",1', "短,2"])).collect()[0].name == "news_x"
    pairs = readers.answer_pairs(spark, put("h.jsonl", [json.dumps({"human_answers": ["a" * 90, "b"], "chatgpt_answers": ["c" * 80]})]))
    assert sorted(r.label for r in pairs.collect()) == [0, 1]
    assert readers.channel(spark, put("c.json", [json.dumps({"meta": {"channel": "k"}, "items": [{"title": "t", "text": "x"}, {"title": "u", "text": "y"}]})])).count() == 2
    log = [{"id": str(i), "session": "s", "ts": f"2024-01-01T00:00:0{9 - i}Z", "hook": "h", "payload": {"tool_name": "w", "tool_input": {"new_string": "n"}}} for i in range(3)]
    ev = readers.event_log(spark, put("e.jsonl", list(map(json.dumps, log)))).orderBy("ord").collect()
    assert [r.id for r in ev] == ["2", "1", "0"] and ev[0].content == "n"
    spam = spark.createDataFrame([("好文。" * 100,), ("扫码关注" + "好文。" * 100,)], "text string")
    assert readers.without_spam(spam).count() == 1


def test_sarif_and_tables(spark):
    pack = load("general")
    found = spark.createDataFrame([(0, 0, "G-HYPE-01", "medium", "赋能一切。")], "doc_id long, para int, rule_id string, severity string, sentence string")
    lines = spark.createDataFrame([(0, 1, "前言"), (0, 2, "- 赋能，一切。")], "doc_id long, line int, raw string")
    row = report.start_lines(report.sarif_results(found), lines).first().asDict()
    assert row["start_line"] == 2 and len(row["fingerprint"]) == 40
    log = json.loads(report.sarif([row], pack))
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["level"] == "warning" and log["runs"][0]["results"][0]["ruleIndex"] == 2
    rows = [{"doc_id": "a|b", "index": None, "high": 1, "medium": 0, "low": 0, "findings": 1, "n_sentences": 9, "n_chars": 99}]
    assert "a\\|b" in report.batch_markdown(rows) and report.batch_csv(rows).splitlines()[1] == "a|b,,1,0,0,1,9,99"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.txt").write_text("总之赋能。以上就是全部。" + "平常话说得不多。" * 9)
    assert cli.main(["check", str(tmp_path / "x.txt")], spark) == 0
    assert "G-INTERACT-01" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "x.txt"), "--format", "sarif", "--fail-above", "-1"], spark) == 1
    capsys.readouterr()
    assert cli.main(["profiles"]) == 0 and "academic" in capsys.readouterr().out
    assert cli.main(["explain", "NONE"]) == 1


def test_stream_counts_by_window(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i}:00:00", "总之赋能。\n底层逻辑。") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, ts timestamp, text string").parquet(str(tmp_path / "in"))
    hits = drift.live_hits(stream, load("general"))
    drift.run_into(hits, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("rule_id").count().orderBy("rule_id").collect() == [("G-HYPE-01", 6), ("G-SAFE-01", 3)]


def counted(spark, df):
    """``df`` and a count of its rows as they are computed."""
    n = spark.sparkContext.accumulator(0)

    def one_more(row):
        n.add(1)
        return row

    return spark.createDataFrame(df.rdd.map(one_more), df.schema), n


@pytest.mark.parametrize("step", ["group_table", "tier_fits", "ablation", "leave_one_out", "out_of_fold", "held_out_auroc", "collapse"])
def test_rows_are_computed_once(spark, step):
    """Whatever reads its rows many times computes them once, however many models or lengths there are."""
    df = spark.range(0, 240, 1, 2).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 11 + 6.0 * (F.col("id") % 2)).alias("x"), F.rand(1).alias("z"), (F.col("id") * 4).alias("n_chars"))
    if step == "collapse":
        df = spark.createDataFrame([("甲乙丙丁" + c, 9) for c in "一二三四五六"] + [(a + b, 7) for a in "甲乙" for b in "丙丁"], "gram string, df_1 long")
    rows, n = counted(spark, df)
    {
        "group_table": lambda: evaluate.group_table(rows, "g", "x", 9.0), "tier_fits": lambda: evaluate.tier_fits(rows, ["x"], "y"), "ablation": lambda: evaluate.ablation(rows, "y", {"x": ["x"], "both": ["x", "z"]}),
        "leave_one_out": lambda: evaluate.leave_one_out(rows, ["x"], "y", "g"), "out_of_fold": lambda: evaluate.out_of_fold(rows, ["x"], "y", "g"), "held_out_auroc": lambda: evaluate.held_out_auroc(rows, ["x", "z"], "y", "id", 2),
        "collapse": lambda: mining.collapse(rows, [2, 3, 4, 5]),
    }[step]().collect()
    assert n.value == df.count()
