"""Perplexity from token likelihoods. The scorer of tokens itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstrata.operators.collect import ranked_percentiles

MOST_NLL = 50.0


def ppl_stats(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by…, avg_nll, ppl, n_tokens) of ``tokens(by…, nll)``; the mean is bounded before its exponential."""
    g = tokens.where("nll is not null").groupBy(*by).agg(F.avg("nll").alias("avg_nll"), F.count("*").alias("n_tokens"))
    return g.withColumn("ppl", F.exp(F.least(F.col("avg_nll"), F.lit(MOST_NLL))))


def ppl_features(sents: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, n, median, p10) of ``sents(doc_id, ppl)`` for documents of ``least`` sentences or more; the values at ranks n // 2 and n // 10."""
    ranks = ranked_percentiles(sents, ["doc_id"], "ppl", {"median": 0.5, "p10": 0.1})
    return ranks.where(F.col("known") >= least).select("doc_id", F.col("known").alias("n"), "median", "p10")


def smoothest(sents: DataFrame, share: int = 10) -> DataFrame:
    """(doc_id, pos, ppl, rank): of each document the ``1 / share`` of its sentences with the lowest perplexity, one at least."""
    w = Window.partitionBy("doc_id")
    ranked = sents.where("ppl is not null").withColumn("rank", F.row_number().over(w.orderBy("ppl", "pos"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / share))).select("doc_id", "pos", "ppl", "rank")


def token_nll(sents: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(doc_id, pos, nll) of every token. ``make`` builds a scorer once per task: texts to lists of negative log-likelihoods."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for f in frames:
            yield f[["doc_id", "pos"]].assign(nll=pd.Series(scorer(f["text"].tolist()), index=f.index)).explode("nll").dropna().astype({"nll": float})

    return sents.select("doc_id", "pos", "text").mapInPandas(score, "doc_id long, pos int, nll double")
