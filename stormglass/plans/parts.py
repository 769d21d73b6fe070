"""Queries of the models' single operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormglass.functions import sampling
from stormglass.functions.times import created
from stormglass.operators import cluster, graph, paths, select
from stormglass.operators import steps as S
from stormglass.operators import vectors as V
from stormglass.runtime import materialize, scratch_dir, table
from stormglass.sources import posts as P
from stormglass.streaming import windows

from .base import CREATED
from .models import tagged_windows, windows_of
from .registry import SNAPSHOTS, query
from .vectors import JACCARD, WEIGHTS


@query()
def gr7_greedy_subtopics(spark: SparkSession, sf: str) -> DataFrame:
    words, snaps = windows_of(spark, sf)
    return select.inc_summary(words, snaps, stage="topics").withColumnsRenamed({"tweet_id": "term", "score": "rank"})


@query()
def gr8_select_posts(spark: SparkSession, sf: str) -> DataFrame:
    words, snaps = windows_of(spark, sf)
    return select.inc_summary(words, snaps, stage="posts")


#: The subtopics are given: the ten most frequent terms of a window; a post's value is the sum of its different terms' shares of the window, without the topics.
GIVEN_TOPICS = f"""{SNAPSHOTS}, o AS (SELECT snapshot, tweet_id, unnest(list_distinct(terms)) AS term FROM snap), c AS (SELECT snapshot, term, count(*) AS n FROM o GROUP BY ALL),
tp AS (SELECT snapshot, term, row_number() OVER (PARTITION BY snapshot ORDER BY n DESC, term) AS place FROM c QUALIFY place <= 10),
v AS (SELECT o.snapshot, o.tweet_id, coalesce(sum(c.n) FILTER (tp.term IS NULL), 0) AS value, min(tp.place) AS place, list(o.term) AS terms FROM o JOIN c USING (snapshot, term) LEFT JOIN tp USING (snapshot, term) GROUP BY ALL),
l AS (SELECT snapshot, list({{'id': tweet_id, 'place': place, 'value': value, 'terms': terms}} ORDER BY place, value DESC, tweet_id) AS xs FROM v WHERE place IS NOT NULL GROUP BY snapshot),
kept AS (SELECT snapshot, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.place = x[1].place)) < LEAST AND len(list_filter(acc, lambda k: len(list_intersect(k.terms, x[1].terms)) / len(list_distinct(k.terms || x[1].terms)) > 0.2)) = 0 THEN acc || x ELSE acc END)) AS x FROM l)"""


def given_topics(spark: SparkSession, sf: str, per_topic: int) -> DataFrame:
    _, snaps = windows_of(spark, sf)
    n = snaps.select("snapshot", "tweet_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("snapshot", "term").agg(F.count(F.lit(1)).alias("n"))
    return select.posts_for_topics(snaps, n, 10, per_topic)


@query(f"WITH {GIVEN_TOPICS.replace('LEAST', '3')} SELECT snapshot, CAST(x.place AS INT) AS place, x.id AS tweet_id, CAST(x.value AS BIGINT) AS value FROM kept")
def top6_topk_per_subtopic(spark: SparkSession, sf: str) -> DataFrame:
    """At most three posts for each given subtopic."""
    return given_topics(spark, sf, 3)


@query(f"WITH {GIVEN_TOPICS.replace('LEAST', str(select.PER_TOPIC))} SELECT snapshot, CAST(x.place AS INT) AS place, x.id AS tweet_id, CAST(x.value AS BIGINT) AS value FROM kept")
def gr8_given_topics(spark: SparkSession, sf: str) -> DataFrame:
    return given_topics(spark, sf, select.PER_TOPIC)


#: a post is left out if an earlier one of its step shares more than a fifth of the terms of both.
@query(f"""WITH {JACCARD}, near AS (SELECT a, b FROM i JOIN n x ON x.tweet_id = a JOIN n y ON y.tweet_id = b WHERE round(i / (x.n + y.n - i), 9) > 0.2)
SELECT tweet_id FROM w WHERE NOT EXISTS (SELECT 1 FROM near JOIN w o ON o.tweet_id IN (a, b) AND o.tweet_id <> w.tweet_id WHERE w.tweet_id IN (a, b) AND (o.created_at_ms, o.tweet_id) < (w.created_at_ms, w.tweet_id))""")
def jn6_anti_existing(spark: SparkSession, sf: str) -> DataFrame:
    w = P.words(spark, sf)
    near = V.jaccard_pairs(w, "tweet_id", 0.0, "step").where(F.round("similarity", 9) > 0.2)
    at = w.select("tweet_id", F.struct("created_at_ms", "tweet_id").alias("at"))
    both = near.join(at.withColumnsRenamed({"tweet_id": "a", "at": "x"}), "a").join(at.withColumnsRenamed({"tweet_id": "b", "at": "y"}), "b")
    later = both.select(F.when(F.col("x") < F.col("y"), F.col("b")).otherwise(F.col("a")).alias("tweet_id")).distinct()
    return w.select("tweet_id").join(later, "tweet_id", "left_anti")


@query()
def gr21_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences joined from several continuations of one begin."""
    return paths.candidates(tagged_windows(spark, sf)).where("joined")


#: one sentence, its content, its gain (the number of terms) and length; similar ones of a step are held against each other in order.
@query()
def gr22_dedup_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Summary posts as candidates, their gain by length: of those of a step that share much content, one stays."""
    s = table(spark, sf, "summaries")
    tagged = paths.tagged(s, "summary_id", "text").join(s.select("summary_id", "step", "rank_no"), "summary_id")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names: dict[tuple, int] = {}
        gain: dict[tuple, float] = {}
        for i, r, n in sorted(zip(g["summary_id"], g["rank_no"], g["nodes"]), key=lambda x: x[0]):
            names.setdefault(tuple(n), i)
            gain.setdefault(tuple(n), 1.0 / r)
        kept = paths.deduplicate([paths.Candidate(n, gain[n], len(n), []) for n in names])
        return pd.DataFrame({"step": key[0], "summary_id": sorted(names[c.nodes] for c in kept)})

    return tagged.groupBy("step").applyInPandas(run, "step int, summary_id bigint")


@query("SELECT i, round(CAST(keep AS DOUBLE), 9) AS keep, other FROM (VALUES (0, 0.25, 0), (1, 0.15, 0), (2, 0.10, 3), (3, 0.20, 0)) t(i, keep, other)")
def mth13_alias_table(spark: SparkSession, sf: str) -> DataFrame:
    keep, alias = sampling.alias_table([0.4, 0.15, 0.1, 0.35])
    return spark.createDataFrame([(i, round(k, 9), a) for i, (k, a) in enumerate(zip(keep, alias))], "i int, keep double, other int")


def _per_window(spark: SparkSession, sf: str, rank) -> DataFrame:
    """A rank of the terms of every window's directed graph."""
    words, snaps = windows_of(spark, sf)
    edges = graph.window_edges(words).withColumnsRenamed({"u": "a", "v": "b"})
    alone = snaps.select("snapshot", F.explode("terms").alias("a")).distinct().select("snapshot", "a", F.lit(None).cast("string").alias("b"), F.lit(0).cast("bigint").alias("total"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g.loc[g["b"].isna(), "a"].unique())
        at = {t: i for i, t in enumerate(names)}
        e = g[g["b"].notna()]
        u, v, w = e["a"].map(at).to_numpy(np.int64), e["b"].map(at).to_numpy(np.int64), e["total"].to_numpy(float)
        order = np.lexsort((v, u))
        r = rank(u[order], v[order], w[order], len(names))
        return pd.DataFrame({"snapshot": key[0], "term": names, "rank": r})

    return edges.unionByName(alone).groupBy("snapshot").applyInPandas(run, "snapshot int, term string, rank double")


@query()
def gr3_sample_walks(spark: SparkSession, sf: str) -> DataFrame:
    def share(u, v, w, n):
        visits = sampling.sample_walks(u, v, w, n)
        return visits / max(1.0, visits.sum())

    return _per_window(spark, sf, share)


@query()
def gr4_incremental_rewalk(spark: SparkSession, sf: str) -> DataFrame:
    """The walks of each window taken over to the next: only those a change can touch are walked again."""
    words, _ = windows_of(spark, sf)
    edges = materialize(graph.window_edges(words))
    snaps = S.snapshots(words.select("tweet_id", "step", "created_at_ms", "terms"))
    order = Window.orderBy("snapshot")
    steps = edges.select("snapshot").distinct().withColumn("after", F.lead("snapshot").over(order))  # one row per step
    alone = snaps.select("snapshot", F.explode("terms").alias("u")).distinct().select("snapshot", "u", F.lit(None).cast("string").alias("v"), F.lit(0).cast("bigint").alias("total"))
    both = edges.select("snapshot", "u", "v", "total").unionByName(alone).join(steps, "snapshot")
    rows = both.select(F.col("snapshot"), F.lit(False).alias("old"), "u", "v", "total").unionByName(both.where("after IS NOT NULL").select(F.col("after").alias("snapshot"), F.lit(True).alias("old"), "u", "v", "total"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        store = sampling.WalkStore()
        for old in (True, False):
            part = g[g["old"] == old]
            e = part[part["v"].notna()].sort_values(["u", "v"])
            if len(part):
                store.update(part.loc[part["v"].isna(), "u"].tolist(), dict(zip(zip(e["u"], e["v"]), e["total"].astype(float))))
        return pd.DataFrame({"snapshot": key[0], "n_terms": [len(store.names)], "n_walks": [len(store.store)], "n_rewalked": [store.rewalked], "n_new": [store.new], "most_visited": [store.names[int(store.shares().argmax())] if store.names else None]})

    return rows.groupBy("snapshot").applyInPandas(run, "snapshot int, n_terms int, n_walks int, n_rewalked int, n_new int, most_visited string")


@query(f"""WITH {WEIGHTS}, m AS (SELECT right(cluster, 1) AS part, tweet_id, term, weight FROM v), nm AS (SELECT tweet_id, sqrt(sum(weight * weight)) AS norm FROM m GROUP BY tweet_id)
SELECT part, term, round(sum(weight / norm), 5) AS norm_sum, round(sum(weight), 5) AS weight_sum FROM m JOIN nm USING (tweet_id) WHERE norm > 0 GROUP BY ALL""")
def gr15_tcv_merge(spark: SparkSession, sf: str) -> DataFrame:
    words = P.words(spark, sf).withColumn("cluster", F.coalesce("user_id", F.lit("-")))
    vectors = V.weights(words, "tweet_id").join(words.select("tweet_id", "cluster"), "tweet_id")
    sums = V.cluster_vectors(vectors, "tweet_id", "cluster")
    merged = sums.groupBy(F.expr("right(cluster, 1)").alias("part"), "term").agg(F.sum("norm_sum").alias("norm_sum"), F.sum("weight_sum").alias("weight_sum"))
    return merged.select("part", "term", F.round("norm_sum", 5).alias("norm_sum"), F.round("weight_sum", 5).alias("weight_sum"))


@query()
def gr16_merge_clusters(spark: SparkSession, sf: str) -> DataFrame:
    words = P.words(spark, sf).withColumn("day", (F.col("step") / 24).cast("int").cast("string"))
    return cluster.merged_clusters(words, "day")


@query(f"""WITH h AS (SELECT delivery_id, epoch_us({CREATED}) // 1000 AS ms FROM hurricane_harvey), m AS (SELECT *, max(ms) OVER (ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h WHERE ms IS NOT NULL)
SELECT delivery_id, before - ms AS late_ms FROM m WHERE ms < before - 3600000""")
def st8_late_data(spark: SparkSession, sf: str) -> DataFrame:
    """Lines more than an hour older than the newest before them, found live: what a watermark of an hour may drop."""
    h = materialize(table(spark, sf, "hurricane_harvey").select("delivery_id", F.unix_millis(created(F.col("created_at"))).alias("ms")))
    path = scratch_dir(spark)
    return windows.replay(h, "delivery_id", 4, lambda stream: windows.late_rows(stream, path, "delivery_id", "ms", 3_600_000))
