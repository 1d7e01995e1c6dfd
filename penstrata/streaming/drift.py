"""The same analysis over streams: scores of arriving documents, and drift by windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from penstrata.operators import facts, segment
from penstrata.packs import Pack


def live_hits(docs: DataFrame, pack: Pack) -> DataFrame:
    """Sentence hits of a stream of plain documents (doc_id, ts, text): stateless, line by line, ungated."""
    lines = docs.select("doc_id", "ts", F.posexplode(F.split("text", "\n")).alias("para", "line"))
    s = lines.select("doc_id", "ts", "para", F.posexplode(segment.split_sentences(F.col("line"))).alias("pos", "text"))
    ids = facts.per_rule(pack, "id")
    hit = F.transform(facts.sentence_hits(pack, F.col("text")), lambda h: F.element_at(ids, h["rule_ord"] + 1))
    return s.where(segment.has_content(F.col("text"))).select("doc_id", "ts", "para", "pos", F.explode(hit).alias("rule_id"))


def windowed_rates(hits: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, rule_id, n) with a watermark; late rows beyond it are left out of closed windows."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", width), "rule_id").agg(F.count("*").alias("n"))


def run_into(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet exactly once, from its checkpoint on."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
