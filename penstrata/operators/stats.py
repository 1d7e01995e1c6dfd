"""Document statistics from sentences, over whole numbers until the last step."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstrata.functions.text import cv
from penstrata.functions.windows import MATTR_WINDOW, window_sums
from penstrata.operators.bydoc import COUNTS, SUMS
from penstrata.operators.facts import facts
from penstrata.operators.segment import ZH, Config

#: Texts shorter than this repeat nothing.
LEAST_REPEAT = 8


def _sums(clean: str):
    """``window_sums`` of a column, by document in memory: exploded bigrams would be a shuffle of many times the text."""

    @F.pandas_udf("tokens long, window_sum long, grams long, distinct_grams long")
    def udf(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([window_sums(t or "") for t in text], columns=["tokens", "window_sum", "grams", "distinct_grams"])

    return udf(clean)


def doc_stats(docs: DataFrame, lexicon: list[str] = (), config: Config = ZH) -> DataFrame:
    """doc_id, n_paragraphs, n_sentences, n_chars, sentence_cv, para_len_cv, ttr, conn_density, ngram_repeat, dash_density, avg_sentence_len.

    What cannot be judged is null, never NaN. A document without a block has no row.
    """
    return stats_of(facts(docs, lexicon=lexicon, config=config, need=(*COUNTS, *SUMS)), lexicon)


def stats_of(c: DataFrame, lexicon: list[str] = (), *more: str) -> DataFrame:
    """The statistics of rows of ``facts``, and their columns ``more``."""
    if "tokens" not in c.columns:
        c = c.withColumn("w", _sums("clean")).select("*", "w.*")
    n = F.col("n_sentences").cast("double")
    w = F.least(F.col("tokens"), F.lit(MATTR_WINDOW)).cast("double")
    return c.select(
        "doc_id", "n_paragraphs", "n_sentences", "n_chars", *more,
        cv(F.col("n_sentences"), F.col("n_chars"), F.col("sum_sq")).alias("sentence_cv"),
        cv(F.col("n_paragraphs"), F.col("n_chars"), F.col("para_sq")).alias("para_len_cv"),
        F.when(F.col("tokens") > 0, F.col("window_sum") / (w * (F.col("tokens") - w + 1))).alias("ttr"),
        (F.when(n > 0, F.col("conn") / n) if lexicon else F.lit(None).cast("double")).alias("conn_density"),
        F.when(F.col("n_chars") < LEAST_REPEAT, F.lit(0.0)).otherwise(1 - F.col("distinct_grams") / F.col("grams")).alias("ngram_repeat"),
        F.when(n > 0, F.col("dashes") / n).alias("dash_density"),
        F.when(n > 0, F.col("n_chars") / n).alias("avg_sentence_len"),
    )
