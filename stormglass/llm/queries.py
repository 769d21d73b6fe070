"""The queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.runtime import materialize, table

from . import diverse, mixing, neardup, ngrams, packing, relevance, setjoin, splitting, truncation
from .sql import SQL  # noqa: F401
from .classes import shingle_set, token_set
from .common import first_deliveries, terms
from .tokens import token_counts

QUERIES: dict = {}



def query(f):
    QUERIES[f.__name__] = f
    return f


def first_posts(spark: SparkSession, sf: str) -> DataFrame:
    return first_deliveries(table(spark, sf, "hurricane_harvey").select("id", "delivery_id", "text"), ["text"])


def term_counts(posts: DataFrame) -> DataFrame:
    return materialize(ngrams.ngram_counts(posts.select(terms(F.col("text")).alias("terms")), "terms", 1))


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    marked = ngrams.mark_extremes(term_counts(first_posts(spark, sf)), min_df=3, max_share=1 / 20)
    return marked.where(F.col("mark").isNotNull()).select(F.col("ngram").alias("term"), "mark")


@query
def p5_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, posts and mark of every run of one to three terms of the first deliveries."""
    words = first_posts(spark, sf).select(terms(F.col("text")).alias("terms"))
    return ngrams.mark_extremes(materialize(ngrams.ngram_counts(words, "terms", 3)), min_df=3, max_share=1 / 20)


def listed_posts(spark: SparkSession, sf: str, posts: DataFrame) -> DataFrame:
    """First deliveries whose id stands in the id list."""
    ids = table(spark, sf, "id_list").select(F.expr("try_cast(trim(tweet_id) AS bigint)").alias("id")).where("id IS NOT NULL").distinct()
    return posts.join(ids, "id", "left_semi")


def listed_scores(spark: SparkSession, sf: str, **how) -> DataFrame:
    posts = first_posts(spark, sf).persist()
    counts = term_counts(posts)
    chosen = materialize(listed_posts(spark, sf, posts).select("id", terms(F.col("text")).alias("terms")))
    posts.unpersist()
    return relevance.score_terms(chosen, counts, "id", "terms", **how)


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    scores = listed_scores(spark, sf, k1=math.inf, b=0, idf="plain", min_df=2)
    return relevance.top_terms(scores, "id", min_terms=5).select("id", "term")


@query
def p4_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return listed_scores(spark, sf)


def near_posts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # Only texts of 20 terms need to travel; a first delivery with fewer arrives without text and falls out.
    text = F.when(F.size(terms(F.col("text"))) >= 20, F.col("text"))
    rows = table(spark, sf, "hurricane_harvey").select("id", "delivery_id", text.alias("text"))
    words = first_deliveries(rows, ["text"]).select("id", terms(F.col("text")).alias("terms")).where(F.size("terms") >= 20)
    sets = words.select("id", shingle_set(F.col("terms"), 2).alias("tokens"))
    return neardup.near_duplicates(sets, "id", "tokens", threshold=0.5, bands=120, rows=4)


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links, whole, members = near_posts(spark, sf)
    found = materialize(neardup.all_pairs(links, whole, members).select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))
    whole.unpersist()
    members.unpersist()
    return found


@query
def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of each post with at least 20 terms: one number for all that are linked by small changes."""
    links, whole, members = near_posts(spark, sf)
    found = materialize(neardup.components(links, members).select(F.col("key").alias("id"), F.col("group").alias("group_id")))
    whole.unpersist()
    members.unpersist()
    return found


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    posts = first_posts(spark, sf).select("id", token_set(terms(F.col("text"))).alias("tokens")).where(F.size("tokens") >= 5)
    shown = table(spark, sf, "summaries").select("summary_id", token_set(terms(F.col("text"))).alias("tokens")).where(F.size("tokens") >= 5)
    return setjoin.join_similar(shown, posts, "summary_id", "id", "tokens", 0.6).select("summary_id", "id")


def limits(spark: SparkSession, sf: str) -> dict[str, int]:
    return {r["limit_name"]: r["n_tokens"] for r in table(spark, sf, "size_limits").collect()}


def split_documents(spark: SparkSession, sf: str, with_text: bool) -> DataFrame:
    n = limits(spark, sf)
    return splitting.split_oversized(table(spark, sf, "documents"), "doc_id", "text", n["piece_limit"], n["piece_overlap"], with_text=with_text)


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_documents(spark, sf, False).where("piece_no = 1").select("doc_id")


@query
def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_documents(spark, sf, True)


@query
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = materialize(token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    return packing.containers(sizes, "doc_id", "n_tokens", limits(spark, sf)["container_capacity"])


def mixed_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(mixing.sized(table(spark, sf, "documents"), "doc_id", "text", ["source", "lang"]))
    named = materialize(mixing.assigned(sizes, mixing.fit_topics(sizes, "doc_id")))
    return mixing.mix(named, table(spark, sf, "mix_targets"), "doc_id", "source", "lang"), named


@query
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_documents(spark, sf)[0]


@query
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(mixed_documents(spark, sf)[0], table(spark, sf, "mix_targets"), "source")


@query
def p9_marginals(spark: SparkSession, sf: str) -> DataFrame:
    mixed, named = mixed_documents(spark, sf)
    return mixing.marginals(materialize(mixed), named, table(spark, sf, "mix_targets"), "source", "lang")


@query
def p7_varied(spark: SparkSession, sf: str) -> DataFrame:
    posts = first_posts(spark, sf).select("id", "text", token_set(terms(F.col("text"))).alias("tokens")).persist()
    chosen = diverse.varied_subset(posts, "id", "tokens", 100)
    found = materialize(chosen.join(posts.select("id", "text"), "id"))
    posts.unpersist()
    return found


def cut_texts(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.evidence(table(spark, sf, "hurricane_harvey"), "delivery_id", "id", "source", "text")


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return cut_texts(spark, sf).where("cut").select("delivery_id")


@query
def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_report(cut_texts(spark, sf))
