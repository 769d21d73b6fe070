"""How distinctive a term is for a record: probabilistic relevance weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import ALL


def term_weight(tf: Column, df: Column, length: Column, n: int, mean_length: float, k1: float = 1.2, b: float = 0.75, idf: str = "probabilistic") -> Column:
    """The weight of a term in a record.

    ``idf``: "probabilistic" is ln(1 + (n - df + 0.5) / (df + 0.5)), "plain" is
    ln(n / df). The term frequency saturates with ``k1`` and is normalised by
    the record's length with ``b``; at ``k1 = inf`` it does not saturate and
    the weight is tf * idf, divided by the length normalisation.
    """
    rarity = F.log(F.lit(float(n)) / df) if idf == "plain" else F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))
    norm = F.lit(1.0) if b == 0 else 1 - b + b * length / F.lit(mean_length)
    if math.isinf(k1):
        return rarity * tf if b == 0 else rarity * tf / norm
    return rarity * tf * (k1 + 1) / (tf + k1 * norm)


def score_terms(records: DataFrame, counts: DataFrame, key: str, terms: str, k1: float = 1.2, b: float = 0.75, idf: str = "probabilistic", min_df: int = 1, digits: int = 6) -> DataFrame:
    """``key, term, tf, df, score`` for every different term of every record.

    ``records`` are those to score; ``counts`` are the collection's counts by
    :func:`stormglass.llm.ngrams.ngram_counts`, materialized, from which the
    number of records and their average length come. Terms the collection
    lacks, or holds in fewer than ``min_df`` records, are left out.

    Records without terms, null arrays and empty tables give no rows. A record
    that is repeated under one key gives repeated rows: make keys unique first.
    Columns besides ``key`` and ``terms`` are ignored.
    """
    n, total = counts.agg(F.sum(F.when(F.col("ngram") == ALL, F.col("df"))), F.sum(F.when(F.col("ngram") != ALL, F.col("cf")))).first()
    n, total = n or 0, total or 0
    words = records.select(F.col(key).alias("_key"), F.size(F.coalesce(F.col(terms), F.array())).alias("_len"), F.explode(terms).alias("term"))
    tf = words.groupBy("_key", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("_len").alias("_len"))
    stats = counts.where((F.col("ngram") != ALL) & (F.col("df") >= min_df)).select(F.col("ngram").alias("term"), "df")
    weight = term_weight(F.col("tf"), F.col("df"), F.col("_len"), n, total / n if n else 1.0, k1, b, idf)
    return tf.join(stats, "term").select(F.col("_key").alias(key), "term", "tf", "df", F.round(weight, digits).alias("score"))


def top_terms(scores: DataFrame, key: str, min_terms: int = 1) -> DataFrame:
    """``key, term, score``: each record's best term, the first by code point on a tie,
    of records with at least ``min_terms`` scored terms."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("term").alias("t"))).alias("best")
    grouped = scores.groupBy(key).agg(best, F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_terms)
    return grouped.select(key, F.col("best.t").alias("term"), (-F.col("best.s")).alias("score"))
