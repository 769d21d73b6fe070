"""Readers of posts and of the lists beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormglass.functions.text import EXTRA_STOP_WORDS, extract_terms
from stormglass.functions.times import created
from stormglass.operators.steps import with_step
from stormglass.runtime import materialize, table

TSV = "tweet_id string, unused string, created_at_ms bigint, user_id string, text string"
RAW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("user", T.StructType([T.StructField("id", T.LongType())])),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Posts of all files of a folder, five columns without quoting; what follows
    a sixth tab is dropped, a line without a numeric time fails the read."""
    part = F.split("value", "\t", -1)
    lines = spark.read.text(path)
    null = lambda i: F.when(F.get(part, i) != "", F.get(part, i))
    return lines.select(null(0).alias("tweet_id"), F.get(part, F.lit(1)).alias("unused"), F.get(part, F.lit(2)).cast("bigint").alias("created_at_ms"), null(3).alias("user_id"), F.get(part, F.lit(4)).alias("text"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts, one JSON object per line; lines without id are skipped."""
    return spark.read.schema(RAW).json(path).where("id IS NOT NULL")


def as_tsv_rows(raw: DataFrame) -> DataFrame:
    """Raw posts as rows of the TSV form: times in ms, no line breaks."""
    user = F.col("user.id") if "user" in raw.columns else F.col("user_obj.id")
    return raw.select(F.col("id").cast("string").alias("tweet_id"), F.lit("null").alias("unused"), F.unix_millis(created(F.col("created_at"))).alias("created_at_ms"), user.cast("string").alias("user_id"), F.regexp_replace("text", "[\r\n]", " ").alias("text"))


def unique_posts(posts: DataFrame) -> DataFrame:
    """One row per tweet id: the earliest of repeated lines."""
    first = F.min(F.struct("created_at_ms", "text", "user_id")).alias("m")
    return posts.where("tweet_id IS NOT NULL").groupBy("tweet_id").agg(first).select("tweet_id", "m.user_id", "m.created_at_ms", "m.text")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return unique_posts(table(spark, sf, "posts"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``tweet_id`` of a file with an id per line: blanks around it are no part of it, each once, empty lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("tweet_id")).where("tweet_id <> ''").distinct()


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``word`` of files of words with commas between, in lower case, each once, with those that always are stop words."""
    own = spark.read.text(path).select(F.explode(F.split(F.lower("value"), ",")).alias("word")).where("word <> ''")
    return own.union(spark.createDataFrame([(w,) for w in EXTRA_STOP_WORDS], "word string")).distinct()


def read_summaries(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """``path, rank_no, text``: the lines of summary files in their order, from 1, or the first ``head`` of each.

    A summary is a file and small; files are read whole, in parallel.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("rank_no"), "text")
    return lines.where(F.col("rank_no") <= head) if head is not None else lines


def read_raw(spark: SparkSession, path: str, fields: int) -> DataFrame:
    """``id, rest, tokens`` of lines of ``fields`` fields with blanks between, the last of which is the rest of the line:
    the text under its id (8 fields), or the tokens of a post (5). Lines with fewer fields give null."""
    part = F.split("value", r"[ \t\x0B\f\r]+", fields)
    rest = F.get(part, F.lit(fields - 1))
    return spark.read.text(path).select(F.get(part, F.lit(0)).alias("id"), rest.alias("rest"), F.split(rest, r"[ \t\x0B\f\r]+").alias("tokens"))


def stop_words(spark: SparkSession, sf: str) -> DataFrame:
    """The different stop words in lower case, with those that always are."""
    own = table(spark, sf, "stop_words").where("word IS NOT NULL").select(F.lower("word").alias("word"))
    return own.union(spark.createDataFrame([(w,) for w in EXTRA_STOP_WORDS], "word string")).distinct()


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with their step and terms, those with a term; written once, since most
    queries read them several times and extraction is the dear part. Stop words
    are a short list of the language and become part of the expression."""
    stop = [r["word"] for r in stop_words(spark, sf).collect()]
    terms = extract_terms(F.col("text"), stop)
    return materialize(with_step(posts(spark, sf)).withColumn("terms", terms).where(F.size("terms") >= 1))


def id_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "id_list").select(F.trim("tweet_id").alias("tweet_id")).where("tweet_id IS NOT NULL").distinct()


def words_of(spark: SparkSession, sf: str, df: DataFrame, text: str) -> DataFrame:
    """``df`` with the terms of a text column."""
    stop = [r["word"] for r in stop_words(spark, sf).collect()]
    return df.withColumn("terms", extract_terms(F.col(text), stop))
