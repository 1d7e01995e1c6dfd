"""Command line: check, diff, stats, rewrite, profiles, collect, ppl, explain."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstrata.operators import collect, compare, perplexity, rewrite, rules, score, segment
from penstrata.packs import PROFILES, load
from penstrata.plans import report
from penstrata.sources import readers


def _docs(spark: SparkSession, target: str) -> DataFrame:
    """Documents of a path, a glob, a folder or, for ``-``, standard input; all files bad is an error."""
    if target == "-":
        return spark.createDataFrame([(0, "-", sys.stdin.read())], "doc_id long, path string, text string")
    found = readers.files(spark, target).cache()
    bad = found.where("error is not null").select("path", "error").take(20)
    for b in bad:
        print(f"skipped {b.path}: {b.error}", file=sys.stderr)
    docs = readers.documents(found)
    if docs.isEmpty():
        raise SystemExit("no readable file")
    return docs


def _check(spark, a) -> int:
    pack = load(a.profile)
    docs = _docs(spark, a.target).cache()
    rows = score.analyzed(docs, pack).cache()
    found = rules.at_least(rules.findings(docs, pack), a.min_severity)
    named = docs.select("doc_id", "path")
    one = docs.limit(2).count() == 1

    def rendered(df: DataFrame) -> Iterator[dict]:
        """Rows as they come, a partition at a time, under the names of their files."""
        for r in df.join(named, "doc_id").toLocalIterator():
            d = r.asDict(True)
            yield {**d, "doc_id": d.pop("path")}

    if a.format == "json":
        for r in report.json_reports(rows, found).toLocalIterator():
            print(r.report)
    elif a.format == "sarif":
        hits = report.start_lines(report.sarif_results(found.where("not is_hint")), rewrite.text_lines(docs))
        print(report.sarif(rendered(hits), pack))
    elif a.format in ("csv", "table") or not one:
        out = list(rendered(compare.sorted_batch(score.batch_summary(rows))))  # a table of one short row a document
        out.sort(key=lambda r: (r["index"] is None, -(r["index"] or 0), -r["findings"], r["doc_id"]))
        print(report.batch_csv(out) if a.format == "csv" else report.batch_markdown(out))
    else:
        items = found.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "doc_id"])).alias("items"))
        texts = docs.select("doc_id", "text")
        for r in rendered(rows.join(items, "doc_id", "left").join(texts, "doc_id")):
            of = r["items"] or []
            if a.format == "appeal":
                print(report.appeal_markdown(r, of, pack, r["text"], datetime.date.today().isoformat()))
            else:
                print((report.check_html if a.format == "html" else report.check_markdown)(r, of, pack))
    if a.fail_above is None or a.target == "-":
        return 0
    # a single file is held to its raw index, a batch to the rounded one
    rows = rows if one else rows.withColumn("index", F.bround("index", 0))
    return int(not score.above(rows, a.fail_above).isEmpty())


def _diff(spark, a) -> int:
    pack = load(a.profile)
    side = lambda t: rules.findings(_docs(spark, t).withColumn("doc_id", F.lit(0).cast("long")), pack).where("not is_hint")
    out = [r.asDict() for r in compare.sorted_diff(compare.rule_diff(side(a.before), side(a.after))).collect()]  # a row a rule
    if a.format == "text":
        for r in out:
            print("\t".join(str(r[k]) for k in ("status", "rule_id", "before", "after")))
    else:
        print((report.diff_json if a.format == "json" else report.diff_markdown)(out, a.before, a.after))
    return 0


def _stats(spark, a) -> int:
    for r in score.analyzed(_docs(spark, a.target), load(a.profile)).toLocalIterator():
        print(json.dumps(r.asDict(True), ensure_ascii=False))
    return 0


def _rewrite(spark, a) -> int:
    docs = _docs(spark, a.target)
    advice = rewrite.advised(rewrite.text_lines(docs), load("personal"))
    if a.apply:
        print("\n".join(r.text for r in rewrite.applied(docs, advice).toLocalIterator()))
    else:
        for r in advice.orderBy("doc_id", "line").toLocalIterator():
            print(f"{r.line}\t{r.action}\t{r.text}\t{r.candidate or r.direction}")
    return 0


def _collect(spark, a) -> int:
    pack, docs = load(a.profile), _docs(spark, a.target)
    rows = collect.samples(docs, score.analyzed(docs, pack), a.profile, a.month, a.label).drop("doc_id")
    rows.write.mode("append").json(a.out)
    return 0


def _ppl(spark, a) -> int:
    tokens = spark.read.schema("doc_id long, pos int, nll double").json(a.target)
    for r in perplexity.ppl_stats(tokens, ["doc_id", "pos"]).orderBy("ppl").toLocalIterator():
        print(f"{r.doc_id}\t{r.pos}\t{r.ppl:.2f}\t{r.n_tokens}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="penstrata", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("check", "stats", "collect"):
        s = sub.add_parser(verb)
        s.add_argument("target")
        s.add_argument("--profile", choices=PROFILES, default="general")
        if verb == "check":
            s.add_argument("--format", choices=("text", "table", "csv", "json", "sarif", "html", "appeal"), default="text")
            s.add_argument("--min-severity", choices=("low", "medium", "high"), default="low")
            s.add_argument("--fail-above", type=float)
        if verb == "collect":
            s.add_argument("--month", required=True)
            s.add_argument("--label", choices=("miss", "fp", "hit"), default="hit")
            s.add_argument("--out", required=True)
    s = sub.add_parser("diff")
    s.add_argument("before")
    s.add_argument("after")
    s.add_argument("--profile", choices=PROFILES, default="general")
    s.add_argument("--format", choices=("text", "markdown", "json"), default="text")
    s = sub.add_parser("rewrite")
    s.add_argument("target")
    s.add_argument("--apply", action="store_true")
    s = sub.add_parser("ppl")
    s.add_argument("target", help="JSON lines of doc_id, pos, nll")
    sub.add_parser("profiles")
    s = sub.add_parser("explain")
    s.add_argument("rule")
    a = p.parse_args(argv)
    if a.verb == "profiles":
        for name in PROFILES:
            k = load(name)
            print(f"{name}\t{len(k.rules)} rules\t{'scored' if k.scoring else 'not scored'}")
        return 0
    if a.verb == "explain":
        known = [(n, r) for n in PROFILES for r in load(n).rules if r.id == a.rule]
        for n, r in known:
            print(f"{n}: {r.id} ({r.name}), {r.scope}, {r.severity}" + "".join(f"\n  {x}" for x in (r.why, r.advice, *([f"{r.example} → {r.better}"] if r.example else []), *r.patterns)))
        return int(not known)
    spark = spark or SparkSession.builder.appName("penstrata").getOrCreate()
    return {"check": _check, "diff": _diff, "stats": _stats, "rewrite": _rewrite, "collect": _collect, "ppl": _ppl}[a.verb](spark, a)


__all__ = ["main", "segment"]

if __name__ == "__main__":
    sys.exit(main())
