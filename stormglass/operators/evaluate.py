"""Unigram precision, recall and F1 of one summary against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rouge(summaries: DataFrame, references: DataFrame, *by: str) -> DataFrame:
    """``model, *by, n_generated, n_reference, n_both, p, r, f1`` over the sets of terms.

    ``summaries`` has ``model, *by, terms`` and ``references`` ``*by, terms``, one
    row per line. A side without terms gives null where it would divide by zero.
    """
    own = summaries.select("model", *by, F.explode("terms").alias("term")).distinct()
    ref = references.select(*by, F.explode("terms").alias("term")).distinct()
    both = own.join(ref.withColumn("_hit", F.lit(1)), [*by, "term"], "left").groupBy("model", *by).agg(F.count(F.lit(1)).alias("n_generated"), F.count("_hit").alias("n_both"))
    sized = both.join(ref.groupBy(*by).agg(F.count(F.lit(1)).alias("n_reference")), list(by))
    p, r = F.col("n_both") / F.col("n_generated"), F.col("n_both") / F.col("n_reference")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r))
    return sized.select("model", *by, "n_generated", "n_reference", "n_both", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"))
