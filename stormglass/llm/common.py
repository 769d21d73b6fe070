"""What several of the operators share: terms of a text, first deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.runtime import materialize, scratch_dir, table  # noqa: F401

LINK = r"https?://[^ \t\r\n]*"


def terms(text: Column) -> Column:
    """Terms of a text, in order, duplicates kept; an empty array for null.

    Links are blanked first, then the text is lower-cased and the maximal runs
    of letters and digits are taken.
    """
    clean = F.lower(F.regexp_replace(text, LINK, " "))
    return F.coalesce(F.array_remove(F.split(clean, r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def first_deliveries(df: DataFrame, columns: list[str], key: str = "id", order: str = "delivery_id") -> DataFrame:
    """One row per non-null ``key``: the row with the smallest ``order``.

    The aggregate combines before its shuffle, so a key with any number of
    copies sends one row per map task. A null ``order`` counts as the largest;
    rows tied on ``order`` give the one with the smallest values.
    """
    rank = F.coalesce(F.col(order), F.lit(2**63 - 1))
    whole = F.min(F.struct(rank.alias("_rank"), *[F.col(c) for c in columns]))
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(whole.alias("_first"))
    return kept.select(key, *[F.col(f"_first.{c}").alias(c) for c in columns])
