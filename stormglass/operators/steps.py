"""Steps of event time, sliding snapshots, and orders over the whole stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.runtime import materialize

HOUR_MS = 3_600_000
WINDOW = 12


def time_step(ms: Column, ref: int, width: int = HOUR_MS) -> Column:
    """Steps since ``ref``; 0 before it."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor((ms - F.lit(ref)) / F.lit(width))).cast("int")


def with_step(posts: DataFrame, ms: str = "created_at_ms", width: int = HOUR_MS) -> DataFrame:
    """Adds ``step``, counted from the earliest post."""
    ref = posts.agg(F.min(ms)).first()[0]
    return posts.withColumn("step", time_step(F.col(ms), ref or 0, width))


def snapshots(posts: DataFrame, window: int = WINDOW, trigger_post: bool = False) -> DataFrame:
    """Each post once per snapshot that sees it, with ``snapshot``: the steps
    before it, as many as ``window``. Snapshots are taken at steps that have
    posts. With ``trigger_post`` a snapshot also sees the first post of its step.

    The window becomes an equality: a post is repeated for the steps that see
    it, so no range join is needed.
    """
    steps = posts.select(F.col("step").alias("snapshot")).distinct()
    seen = posts.withColumn("snapshot", F.explode(F.sequence(F.col("step") + 1, F.col("step") + window)))
    out = seen.join(steps, "snapshot", "left_semi")
    if trigger_post:
        first = posts.groupBy("step").agg(F.min_by(F.struct(*posts.columns), F.struct("created_at_ms", "tweet_id")).alias("m"))
        out = out.unionByName(first.select("m.*", F.col("step").alias("snapshot")))
    return out


def with_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Adds the position of each row in the order, from 0, without one task for all:
    ranges are sorted on their own and start at the sum of those before."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, rows = 0, []
    for p in sorted(counts):
        rows.append((p, start))
        start += counts[p]
    starts = spark.createDataFrame(rows, "_part int, _start bigint")
    ranked = parts.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return ranked.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_part", "_start", "_own")


def numbered(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts (``tweet_id, terms``) with numbers in place of names, which join, sort and travel better than strings.

    Returns ``tweet_id, post, terms``, the terms as numbers in their order, and the dictionaries ``tweet_id, post`` and
    ``term, number``, all materialized. Numbers are in the order of the names, so ties by number are ties by name.
    """
    base = words.groupBy("tweet_id").agg(F.first("terms").alias("terms"))
    posts = materialize(with_index(base.select("tweet_id"), "tweet_id", name="post"))
    terms = materialize(with_index(base.select(F.explode("terms").alias("term")).distinct(), "term", name="number"))
    each = base.select("tweet_id", F.posexplode("terms").alias("i", "term")).join(terms, "term")
    rows = each.groupBy("tweet_id").agg(F.array_sort(F.collect_list(F.struct("i", "number"))).alias("t"))
    return materialize(rows.join(posts, "tweet_id").select("tweet_id", "post", F.transform("t", lambda x: x["number"]).alias("terms"))), posts, terms


def running_max(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """Adds the largest ``value`` of all rows before each row in the order."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    rows, most = [], None
    for r in sorted(parts.groupBy("_part").agg(F.max(value).alias("m")).collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], most))
        most = r["m"] if most is None else max(most, r["m"] if r["m"] is not None else most)
    starts = spark.createDataFrame(rows, "_part int, _most bigint")
    own = F.max(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.greatest(own, "_most")).drop("_part", "_most")


def running_sets(words: DataFrame, by: str, key: str, order: str, terms: str) -> DataFrame:
    """``by, key, new_terms, n_union, n_both``: of each set in its group's order the terms no earlier one holds,
    the size of the union up to it, and what it shares with the union before it."""
    each = words.select(by, order, key, F.explode(F.array_distinct(terms)).alias("_t"))
    first = each.groupBy(by, "_t").agg(F.min(F.struct(order, key)).alias("f")).groupBy(by, F.col(f"f.{key}").alias(key)).agg(F.count(F.lit(1)).alias("new_terms"))
    sized = words.select(by, key, order, F.size(F.array_distinct(terms)).cast("bigint").alias("n")).join(first, [by, key], "left").withColumn("new_terms", F.coalesce("new_terms", F.lit(0).cast("bigint")))
    up_to = F.sum("new_terms").over(Window.partitionBy(by).orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0))
    return sized.select(by, key, "new_terms", up_to.alias("n_union"), (F.col("n") - F.col("new_terms")).alias("n_both"))


def skip_first(df: DataFrame, n: int, *order: str, key: str) -> DataFrame:
    """All rows but the first ``n`` in the order: those are found by a bounded sort and taken out by key."""
    return df.join(F.broadcast(df.orderBy(*order).limit(n).select(key)), key, "left_anti")


def top_mass(df: DataFrame, value: str, key: str, share: float) -> DataFrame:
    """Rows in descending order of value until their sum reaches ``share`` of the
    whole, the one that crosses it included; equal values by key. Meant for
    the ranked list of one result."""
    order = Window.orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.agg(F.sum(value)).first()[0] or 0.0
    before = F.coalesce(F.sum(value).over(order), F.lit(0.0))
    return df.withColumn("_before", before).where(F.round("_before", 9) < round(share * whole, 9)).drop("_before")
