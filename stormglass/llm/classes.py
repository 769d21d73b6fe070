"""Records with equal sets, collapsed into classes before any pair is formed."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_set(tokens: Column) -> Column:
    """The different elements of an array as sorted 64-bit hashes."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))


def shingle_set(tokens: Column, width: int) -> Column:
    """The different runs of ``width`` elements as sorted 64-bit hashes; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(tokens) - width)
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]))
    return F.when(F.size(tokens) >= width, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>"))


def short(tokens: Column) -> Column:
    """The hashes cut to 31 bits, for what only narrows down: half as much is moved."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))))


def keep_partitioned(df: DataFrame) -> DataFrame:
    """Persists ``df`` with the partitioning of its last shuffle, so that joins on that key do not shuffle it again."""
    spark, name = df.sparkSession, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        spark.conf.set(name, before)


def classes(members: DataFrame, key: str, tokens: str, cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(cls, rep, n, tokens)`` per different set, and ``(cls, key, tokens)`` per record.

    Copies of one set are combined before the shuffle, so a third of all rows
    being copies costs no more than one row per map task. ``rep`` is the
    smallest key. With ``cut`` the classes' tokens are those of :func:`short`;
    what is one class is decided on the whole hashes. Both results rest on one
    persisted table, the second, so that the records are read and hashed once;
    it keeps the records' partitioning. Unpersist both when done.
    """
    named = members.select(F.xxhash64(F.col(tokens), F.size(tokens)).alias("cls"), F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    named = keep_partitioned(named)
    own = F.first(short(F.col("tokens")) if cut else F.col("tokens")).alias("tokens")
    whole = named.groupBy("cls").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"), own)
    return keep_partitioned(whole), named
