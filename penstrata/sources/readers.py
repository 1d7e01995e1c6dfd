"""Sources: text, Markdown and office files, line formats of corpora, event logs.

Files come through ``binaryFile``, so that any store that Spark reads will
do; a file that cannot be read gives an error beside a null text, and other
files go on.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of a directory listing.
EXTENSIONS = ("txt", "md", "markdown", "docx", "odt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Bytes of XML in one file, against archives that unpack without end.
MOST_XML = 256 << 20


def decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else GB18030 with replacements."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


def _xml(data: bytes, name: str) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo(name).file_size > MOST_XML:
            raise ValueError(f"{name} is too large")
        return ElementTree.fromstring(z.read(name))


def docx_text(data: bytes) -> str:
    """Paragraphs in order, each once; deleted text and field codes are skipped."""
    body, out = _xml(data, "word/document.xml"), []
    inner = {id(p) for q in body.iter(f"{_W}p") for p in q.iter(f"{_W}p") if p is not q}

    def own(node, parts):
        for x in node:
            if x.tag == f"{_W}t":
                parts.append(x.text or "")
            elif x.tag == f"{_W}tab":
                parts.append("\t")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
            elif x.tag not in (f"{_W}del", f"{_W}instrText", f"{_W}delText"):
                own(x, parts)
        return parts

    for p in body.iter(f"{_W}p"):
        if id(p) not in inner:
            out.append("".join(own(p, [])))
    return "\n".join(out)


def odt_text(data: bytes) -> str:
    """Paragraphs and headings in order; repeated blanks, tabs and breaks as they stand."""

    def own(node) -> str:
        parts = [node.text or ""]
        for x in node:
            if x.tag == f"{_T}s":
                parts.append(" " * int(x.get(f"{_T}c", "1")))
            elif x.tag == f"{_T}tab":
                parts.append("\t")
            elif x.tag == f"{_T}line-break":
                parts.append("\n")
            else:
                parts.append(own(x))
            parts.append(x.tail or "")
        return "".join(parts)

    return "\n".join(own(p) for p in _xml(data, "content.xml").iter() if p.tag in (f"{_T}p", f"{_T}h"))


def parsed(path: str, data: bytes) -> str:
    name = path.lower()
    return docx_text(data) if name.endswith(".docx") else odt_text(data) if name.endswith(".odt") else decoded(data)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of a file, a glob or a directory's own files with a known extension; hidden files are skipped."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((p, parsed(p, bytes(data)), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    read = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "content")
    named = F.regexp_extract("path", r"([^/]*)$", 1)
    kept = read.where(F.lower(named).rlike(rf"\.({'|'.join(EXTENSIONS)})$") & ~named.startswith("."))
    return kept.mapInPandas(each, "path string, text string, error string")


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, path, text) of the files that could be read; ids follow a hash of the path."""
    return files.where("error is null").select(F.xxhash64("path").alias("doc_id"), "path", "text")


SAMPLE = "type string, version string, time string, label string, profile string, text string, text_sha256 string, score int, findings array<string>, n_chars long, _bad string"


def samples(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Calibration samples from JSON lines; bad lines and other types are skipped."""
    rows = spark.read.schema(SAMPLE).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where((F.col("type") == kind) & F.col("_bad").isNull()).drop("_bad")


def corpus_csv(spark: SparkSession, path: str, least: int = 120) -> DataFrame:
    """(name, text) of the texts of ``least`` characters or more in CSV files with a column ``text``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    text = F.trim(F.regexp_replace("text", "^﻿", ""))
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.csv$", 1).alias("name"), text.alias("text")).where(F.length("text") >= least)


def answer_pairs(spark: SparkSession, path: str, least: int = 80) -> DataFrame:
    """(label, text) of question files with lists of human and generated answers; 1 is generated."""
    rows = spark.read.schema("human_answers array<string>, chatgpt_answers array<string>").json(path)
    side = lambda c, y: rows.select(F.lit(y).alias("label"), F.explode(c).alias("text"))
    return side("human_answers", 0).unionByName(side("chatgpt_answers", 1)).where(F.length("text") >= least)


def generated(spark: SparkSession, path: str) -> DataFrame:
    """(model, scene, prompt_id, text) of generated samples; errors and empty texts are skipped."""
    return spark.read.schema("model string, scene string, prompt_id long, text string").json(path).where("text is not null and text <> ''")


def channel(spark: SparkSession, path: str) -> DataFrame:
    """(channel, title, text) of files of one channel each."""
    rows = spark.read.schema("meta struct<channel: string>, items array<struct<title: string, text: string>>").option("multiLine", True).json(path)
    return rows.select("meta.channel", F.explode("items").alias("i")).select("channel", "i.*")


#: A marker of spam within so many characters of either end.
SPAM, SPAM_ENDS = "转载请注明|点击关注|扫码关注|版权归原作者", 120


def without_spam(rows: DataFrame) -> DataFrame:
    head, tail = F.substring("text", 1, SPAM_ENDS), F.expr(f"right(text, {SPAM_ENDS})")
    return rows.where(~head.rlike(SPAM) & ~tail.rlike(SPAM))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """(session, ts, id, hook, tool, content, ord): events of a session in order of time."""
    payload = "struct<tool_name: string, tool_input: struct<content: string, new_string: string, new_source: string, file_path: string>>"
    rows = spark.read.schema(f"id string, session string, ts string, hook string, payload {payload}").json(path)
    ts = F.to_timestamp("ts")
    content = F.coalesce("payload.tool_input.content", "payload.tool_input.new_string", "payload.tool_input.new_source")
    order = Window.partitionBy("session").orderBy("ts", "id")
    return rows.select("session", ts.alias("ts"), "id", "hook", F.col("payload.tool_name").alias("tool"), content.alias("content")).where("ts is not null").withColumn("ord", F.row_number().over(order))


def cjk_lines(rows: DataFrame, least: int = 20, share: float = 0.6) -> DataFrame:
    """(doc_id, text) of lines of ``least`` characters whose greater part is Chinese."""
    x = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).select("doc_id", F.trim("text").alias("text"))
    return x.where((F.length("text") >= least) & (F.regexp_count("text", F.lit("[一-鿿]")) / F.length("text") >= share))


def temp_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Tables below a folder as views for SQL users."""
    for n in names:
        if not re.fullmatch(r"\w+", n):
            raise ValueError(n)
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
