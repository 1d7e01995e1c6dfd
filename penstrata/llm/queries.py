"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from penstrata.llm.token_stream import read_digests, write_stream_files

    docs = _table(spark, sf_dir, "documents")
    shards = write_stream_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, shards)


def op2_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penstrata.llm.covertree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op3_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penstrata.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op4_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penstrata.llm.toxicity import learn, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op5_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penstrata.llm.simhash import hex16, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16().alias("fingerprint"), "component_id")


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penstrata.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"))


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penstrata.llm.language import learn, predicted

    docs = _table(spark, sf_dir, "documents")
    return predicted(docs, learn(docs))


def op6_patience_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penstrata.llm.licenses import scanned

    return scanned(_table(spark, sf_dir, "documents"))


def op9_maxplus_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from penstrata.llm.sentencepieces import encoded

    return encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: Pages carry no time of their own: the query takes page_id for the day of the fetch, 977 days apart over four years.
FETCHED = "timestamp_seconds(1577836800 + (page_id * 977 % 1461) * 86400)"
#: Every fifth host by hash is listed, for 400 days from a day that the hash gives; the hosts of four advertisers for good.
LISTED = r"""
    SELECT host AS entry, timestamp_seconds(1577836800 + (h % 1461) * 86400) AS at, 'add' AS action FROM hosts WHERE h % 5 = 0
    UNION ALL
    SELECT host, timestamp_seconds(1577836800 + (h % 1461 + 400) * 86400), 'remove' FROM hosts WHERE h % 5 = 0
    UNION ALL
    SELECT entry, to_timestamp('2021-03-01'), 'add'
    FROM (SELECT explode(array('casino-win.example.com', 'free-bets.example.com', 'cheap-pills.example.com', 'ads-track.example.com')) AS entry)
"""


def op10_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from penstrata.llm.urllist import host_of, judged

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 7), 16, 10).cast("long"))
    listed = spark.sql("WITH hosts AS (SELECT * FROM {hosts}) " + LISTED, hosts=hosts)
    return judged(pages, listed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_stream": op1_token_stream,
    "op2_cover_tree_topk": op2_cover_tree_topk,
    "op3_mcd_quality": op3_mcd_quality,
    "op4_factorization_toxicity": op4_factorization_toxicity,
    "op5_simhash_mih": op5_simhash_mih,
    "op6_patience_license": op6_patience_license,
    "op7_length_buckets": op7_length_buckets,
    "op8_rank_order_language": op8_rank_order_language,
    "op9_maxplus_sentencepiece": op9_maxplus_sentencepiece,
    "op10_temporal_url_list": op10_temporal_url_list,
}
ORACLES: dict[str, str] = {
    "op2_cover_tree_topk": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.r AS query_row, q.vec_id AS query_id, p.vec_id AS vec_id, CASE WHEN least(len(q.v), len(p.v)) = 0 THEN 0
        ELSE CAST(list_inner_product(list_resize(q.v, least(len(q.v), len(p.v))), list_resize(p.v, least(len(q.v), len(p.v)))) AS BIGINT) END AS score
    FROM v q JOIN v p ON q.vec_id % 50 = 0 AND q.r <> p.r
), ranked AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank
    FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op10_temporal_url_list": r"""
WITH page AS (
    SELECT row_number() OVER () AS k, page_id, url, make_timestamp((1577836800 + (page_id * 977 % 1461) * 86400) * 1000000) AS fetched_at,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host
    FROM pages
), hosts AS (
    SELECT host, CAST(('0x' || substr(md5(host), 1, 7)) AS BIGINT) AS h FROM (SELECT DISTINCT host FROM page WHERE host IS NOT NULL)
), event AS (
    SELECT host AS entry, make_timestamp((1577836800 + (h % 1461) * 86400) * 1000000) AS moment, 'add' AS action FROM hosts WHERE h % 5 = 0
    UNION ALL
    SELECT host, make_timestamp((1577836800 + (h % 1461 + 400) * 86400) * 1000000), 'remove' FROM hosts WHERE h % 5 = 0
    UNION ALL
    SELECT entry, TIMESTAMP '2021-03-01', 'add'
    FROM (VALUES ('casino-win.example.com'), ('free-bets.example.com'), ('cheap-pills.example.com'), ('ads-track.example.com')) t(entry)
), one AS (
    SELECT entry, moment, max(action) AS action FROM event GROUP BY entry, moment
), life AS (
    SELECT entry, moment AS valid_from, lead(moment) OVER (PARTITION BY entry ORDER BY moment) AS valid_to, action FROM one
), hit AS (
    SELECT page.page_id, page.url, page.fetched_at, entry, valid_from,
        row_number() OVER (PARTITION BY page.k ORDER BY length(entry) DESC NULLS LAST, entry DESC) AS r
    FROM page LEFT JOIN life
        ON action = 'add' AND (host = entry OR ends_with(host, '.' || entry))
        AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)
)
SELECT page_id, url, fetched_at, entry IS NOT NULL AS blocked, entry, valid_from AS listed_at FROM hit WHERE r = 1
""",
}
