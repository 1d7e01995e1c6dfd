"""Renderers: results as JSON, SARIF, tables and Markdown."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstrata.operators.facts import facts, gated_found
from penstrata.operators.rewrite import lines_of
from penstrata.operators.segment import ZH, Config
from penstrata.packs import Pack

#: Levels of SARIF.
LEVELS = {"high": "error", "medium": "warning", "low": "note"}


def sarif_results(found: DataFrame) -> DataFrame:
    """``found`` with its level and a fingerprint that survives edits elsewhere."""
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    mark = F.sha1(F.concat_ws("\x1f", "rule_id", F.col("para").cast("string"), "sentence").cast("binary"))
    return found.withColumn("level", level).withColumn("fingerprint", mark)


def start_lines(found: DataFrame, lines: DataFrame, needle: int = 16, least: int = 4) -> DataFrame:
    """``found`` with start_line, the first line that holds the beginning of the sentence; null where none does.

    Lines and findings meet inside their document, gathered once per document.
    """
    by = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", _plain(F.col("raw")).alias("t")))).alias("lines"))
    return _started(found.withColumn("_key", F.substring(_plain(F.col("sentence")), 1, needle)).join(by, "doc_id", "left"), least)


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def _started(found: DataFrame, least: int) -> DataFrame:
    at = F.get(F.filter("lines", lambda x: F.contains(x["t"], F.col("_key"))), F.lit(0))["line"]
    return found.withColumn("start_line", F.when(F.length("_key") >= least, at)).drop("_key", "lines")


def placed(docs: DataFrame, pack: Pack, config: Config = ZH, needle: int = 16, least: int = 4) -> DataFrame:
    """The findings of ``docs``, hints apart, with what ``start_lines`` says of them: hits and lines come from one reading of a document, without a join."""
    rows = facts(docs, pack, config=config, need=("found", "texts"))
    lines = F.array_sort(F.transform(lines_of(F.col("texts")), lambda x: F.struct(x["line"].alias("line"), _plain(x["raw"]).alias("t"))))
    formal = F.filter(gated_found(pack), lambda h: ~h["is_hint"])
    found = rows.select("doc_id", lines.alias("lines"), formal.alias("hits")).select("doc_id", "lines", F.explode("hits").alias("h")).select("doc_id", "h.*", "lines")
    return _started(found.withColumn("_key", F.substring(_plain(F.col("sentence")), 1, needle)), least)


def json_reports(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, report): one JSON document each, nothing cut off."""
    items = F.array_sort(F.collect_list(F.struct("ord", "rule_id", "severity", "para", "sentence", "matches", "is_hint")))
    by = found.groupBy("doc_id").agg(items.alias("items"))
    all_ = rows.join(by, "doc_id", "left").withColumn("items", F.coalesce("items", F.array()))
    keep = [c for c in rows.columns if c != "doc_id"]
    return all_.select("doc_id", F.to_json(F.struct(*keep, F.filter("items", lambda x: ~x["is_hint"]).alias("findings"), F.filter("items", lambda x: x["is_hint"]).alias("hints"))).alias("report"))


def sarif(results: Iterable[dict], pack: Pack, tool: str = "penstrata") -> str:
    """A SARIF 2.1.0 log of rows with doc_id, rule_id, level, fingerprint, sentence and, if known, start_line."""
    index = {r.id: i for i, r in enumerate(pack.rules)}
    out = []
    for r in results:
        place = {"artifactLocation": {"uri": str(r["doc_id"])}}
        if r.get("start_line"):
            place["region"] = {"startLine": r["start_line"]}
        out.append({"ruleId": r["rule_id"], "ruleIndex": index[r["rule_id"]], "level": r["level"], "message": {"text": r.get("sentence", "")}, "locations": [{"physicalLocation": place}], "partialFingerprints": {"style/v1": r["fingerprint"]}})
    rules = [{"id": r.id, "shortDescription": {"text": r.name}, "defaultConfiguration": {"level": LEVELS[r.severity]}} for r in pack.rules]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": out}]}, ensure_ascii=False, indent=2)


COLUMNS = ("doc_id", "index", "high", "medium", "low", "findings", "n_sentences", "n_chars")


def batch_csv(rows: Iterable[dict]) -> str:
    out = io.StringIO()
    w = csv.DictWriter(out, COLUMNS, extrasaction="ignore", lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def batch_markdown(rows: Iterable[dict]) -> str:
    lines = ["| " + " | ".join(COLUMNS) + " |", "|" + "---|" * len(COLUMNS)]
    return "\n".join([*lines, *("| " + " | ".join("–" if r[c] is None else str(r[c]).replace("|", "\\|") for c in COLUMNS) + " |" for r in rows)])


#: Kinds by what they put in doubt, with what a report says of each.
DOMAIN_NAMES = {"classical": "classical prose", "verse": "verse of even clauses", "non-chinese": "text that is not Chinese", "issuance-notice": "issuing notice", "approval-reply": "approval reply"}
STYLE, GENRE = ("classical", "verse", "non-chinese"), ("issuance-notice", "approval-reply")
#: Hints that a report lists.
MOST_HINTS = 12


def domain_lines(kinds: list[str]) -> list[str]:
    """What a report says of a document outside the calibrated domain: styles, genres, then officialese."""
    out = []
    for group, note in ((STYLE, "the index is only a pointer"), (GENRE, "this genre is not calibrated")):
        names = [DOMAIN_NAMES[k] for k in kinds if k in group]
        if names:
            out.append(f"Outside the calibrated domain ({', '.join(names)}): {note}.")
    return out + (["Reads like an official document: the official profile fits better."] if "officialese" in kinds else [])


def sentence_groups(found: list[dict]) -> tuple[list[list[dict]], list[dict]]:
    """Formal findings in report order by (paragraph, sentence), and those of the whole document."""
    groups: dict[tuple, list[dict]] = {}
    whole = []
    for f in sorted((f for f in found if not f["is_hint"]), key=lambda f: f["ord"]):
        if f["para"] < 0:
            whole.append(f)
        else:
            groups.setdefault((f["para"], f["sentence"]), []).append(f)
    return list(groups.values()), whole


def check_markdown(row: dict, found: list[dict], pack: Pack) -> str:
    """One document's report: index, note, domain, findings by sentence; a rule is explained where it first appears."""
    out = [f"# {row['doc_id']}", ""]
    out.append(f"Index {row['index']:.0f} of 100" if row["index"] is not None else f"No index: {row['note'] or 'too short'}")
    out += domain_lines(row.get("kinds") or [])
    by_id, told = {r.id: r for r in pack.rules}, set()

    def explained(ids: list[str]) -> list[str]:
        fresh = [i for i in ids if i not in told]
        told.update(fresh)
        return [f"  - {i}: {by_id[i].why} {by_id[i].advice}" for i in fresh if by_id[i].why]

    groups, whole = sentence_groups(found)
    for f in whole:
        out += [f"- [{f['severity']}] {f['rule_id']} {by_id[f['rule_id']].name}: {f['matches'][0]}", *explained([f["rule_id"]])]
    for g in groups:
        ids = list(dict.fromkeys(f["rule_id"] for f in g))
        times = f" x{len(g)}" if len(g) > len(ids) else ""
        matched = list(dict.fromkeys(m for f in g for m in f["matches"]))
        out += [f"- [{g[0]['severity']}] {' + '.join(ids)}{times} {' + '.join(by_id[i].name for i in ids)}, paragraph {g[0]['para'] + 1}: {g[0]['sentence']} « {'、'.join(matched)} »", *explained(ids)]
    tips = sorted((f for f in found if f["is_hint"]), key=lambda f: f["ord"])
    if tips:
        out.append(f"{len(tips)} hints, each a rule that hits once: " + "; ".join(f"{f['rule_id']} « {'、'.join(f['matches'])} »" for f in tips[:MOST_HINTS]) + (f"; {len(tips) - MOST_HINTS} more" if len(tips) > MOST_HINTS else ""))
    return "\n".join(out)


def appeal_markdown(row: dict, found: list[dict], pack: Pack, text: str, on: str) -> str:
    """A statement for a writer whose text was flagged: what was measured, what it cannot say, and a digest that binds it to the text."""
    groups, whole = sentence_groups(found)
    s = pack.scoring or {}
    index = "none" if row["index"] is None else f"{row['index']:.0f} of 100"
    lines = [
        f"# Statement on {row['doc_id']}", "", f"Date: {on}. Profile: {pack.name}. Digest of the text (SHA-256): {hashlib.sha256(text.encode()).hexdigest()}", "",
        "## What was measured", "", f"Index: {index}" + (f" ({row['note']})" if row.get("note") else "") + (f"; half of the texts by people that the profile was fitted on lie below {s['p50']}, nine in ten below {s['p90']}." if s else "."),
        f"{row['n_sentences']} sentences, {row['n_chars']} characters, {len(groups)} sentences with findings, {len(whole)} findings on the whole text.",
        *domain_lines(row.get("kinds") or []), "", "## What this cannot say", "",
        "The index counts patterns of style. It does not tell who wrote a text, and people write such sentences too. It must not be the only ground of a decision.", "", "## Findings", "",
    ]
    return "\n".join([*lines, *(f"- {f['rule_id']}: {f['sentence'] or f['matches'][0]}" for g in [*groups, whole] for f in g)]) + "\n"


def diff_json(rows: Iterable[dict], before: str, after: str) -> str:
    """Two versions' rule counts as JSON, in the order of the diff."""
    keep = ("rule_id", "before", "after", "status")
    return json.dumps({"before": before, "after": after, "rules": [{k: r[k] for k in keep} for r in rows]}, ensure_ascii=False, indent=2)


def diff_markdown(rows: Iterable[dict], before: str, after: str) -> str:
    rows = list(rows)
    lines = [f"# {before} → {after}", ""]
    if not rows:
        return "\n".join([*lines, "No rule differs."])
    return "\n".join([*lines, "| rule | before | after | status |", "|---|---|---|---|", *(f"| {r['rule_id']} | {r['before']} | {r['after']} | {r['status']} |" for r in rows)])


def check_html(row: dict, found: list[dict], pack: Pack) -> str:
    """The same as one page of HTML."""
    body = html.escape(check_markdown(row, found, pack)).split("\n")
    return "<!DOCTYPE html><html><head><meta charset=\"utf-8\"></head><body>" + "".join(f"<p>{x}</p>" for x in body if x) + "</body></html>"
