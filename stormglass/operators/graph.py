"""Word graphs, the ranking of their nodes by walks, and what is near a node."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.runtime import materialize

SPAN = 3  #: terms up to this far apart in a post are neighbours
STOP = 0.15
WALK = 20


def pairs(words: DataFrame, *keep: str, span: int = SPAN) -> DataFrame:
    """``*keep, u, v`` for every two different terms of a post, u before v, at most
    ``span`` apart. Built within the row: no self-join and no shuffle."""
    at = F.sequence(F.lit(0), F.size("terms") - 1)
    one = lambda i: F.transform(F.sequence(i + 1, F.least(i + span, F.size("terms") - 1)), lambda j: F.struct(F.get("terms", i).alias("u"), F.get("terms", j).alias("v")))
    each = F.transform(at, lambda i: F.when(i < F.size("terms") - 1, one(i)).otherwise(F.array().cast("array<struct<u:string,v:string>>")))
    return words.where(F.size("terms") > 1).select(*keep, F.inline(F.flatten(each))).where("u <> v")


def places(words: DataFrame, gap: int = SPAN, key: str = "tweet_id", terms: str = "terms") -> DataFrame:
    """``key, u, v, at``: the places of a term v after another term u in the same post,
    at most ``gap`` on, each once. Built within the row: the join on post and place needs no shuffle."""
    behind = lambda j: F.transform(F.sequence(F.greatest(F.lit(0), j - gap), j - 1), lambda i: F.struct(F.get(terms, i).alias("u"), F.get(terms, j).alias("v"), j.alias("at")))
    each = F.transform(F.sequence(F.lit(1), F.size(terms) - 1), lambda j: F.array_distinct(behind(j)))
    return words.where(F.size(terms) > 1).select(key, F.inline(F.flatten(each))).where("u <> v")


def edges(words: DataFrame, *by: str) -> DataFrame:
    """``*by, a, b, weight``: how often two terms were neighbours, undirected, a < b."""
    p = pairs(words, *by)
    return p.groupBy(*by, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def both_ways(undirected: DataFrame, *by: str) -> DataFrame:
    """``*by, u, v, total`` for each direction that occurs, from ``*by, a, b, there, back``: both
    directions of a pair are one row, so no edge has to look for its reverse."""
    total = F.col("there") + F.col("back")
    there = F.when(F.col("there") > 0, F.struct(F.col("a").alias("u"), F.col("b").alias("v"), total.alias("total")))
    back = F.when(F.col("back") > 0, F.struct(F.col("b").alias("u"), F.col("a").alias("v"), total.alias("total")))
    return undirected.select(*by, F.inline(F.filter(F.array(there, back), lambda e: e.isNotNull())))


def window_edges(words: DataFrame, window: int = 12) -> DataFrame:
    """``snapshot, u, v, total``: directed neighbours per snapshot, with the
    undirected total. Edges add up, so steps are counted once and summed."""
    p = pairs(words, "step")
    there = (F.col("u") < F.col("v")).cast("int")
    per = p.groupBy("step", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum(there).alias("there"), F.sum(1 - there).alias("back"))
    steps = words.select(F.col("step").alias("snapshot")).distinct()
    seen = per.select(F.explode(F.sequence(F.col("step") + 1, F.col("step") + window)).alias("snapshot"), "a", "b", "there", "back").join(steps, "snapshot", "left_semi")
    return both_ways(seen.groupBy("snapshot", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back")), "snapshot")


def directed(words: DataFrame, *by: str) -> DataFrame:
    """As :func:`window_edges` over all posts of each ``by``, or of all."""
    there = (F.col("u") < F.col("v")).cast("int")
    return both_ways(pairs(words, *by).groupBy(*by, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum(there).alias("there"), F.sum(1 - there).alias("back")), *by)


def transitions(walkable: DataFrame, *by: str) -> DataFrame:
    """``*by, u, v, p``: steps of a walk, proportional to the totals."""
    out = walkable.groupBy(*by, "u").agg(F.sum("total").alias("s"))
    return walkable.join(out, [*by, "u"]).select(*by, "u", "v", (F.col("total") / F.col("s")).alias("p"))


def walk_rank(nodes: DataFrame, steps: DataFrame, *by: str, length: int = WALK, stop: float = STOP, cut_every: int = 5) -> DataFrame:
    """``*by, node, rank``: the expected share of visits of walks of up to
    ``length`` nodes from every node, which end with probability ``stop`` at each.

    Deterministic: the visits of the next step are a join with the transitions,
    which are written once; plans are cut every few steps the same way.
    """
    steps = materialize(steps) if length > 2 else steps
    now = nodes.select(*by, F.col("node"), F.lit(1.0).alias("r"))
    total = now
    for k in range(1, length):
        moved = now.withColumnRenamed("node", "u").join(steps, [*by, "u"]).groupBy(*by, F.col("v").alias("node")).agg(F.sum(F.col("r") * F.col("p") * (1 - stop)).alias("r"))
        now = materialize(moved) if k % cut_every == 0 else moved
        total = total.unionAll(now)
    visits = total.groupBy(*by, "node").agg(F.sum("r").alias("r"))
    if by:
        joined = visits.join(visits.groupBy(*by).agg(F.sum("r").alias("s")), list(by))
    else:
        visits = materialize(visits)
        joined = visits.withColumn("s", F.lit(visits.agg(F.sum("r")).first()[0] or 1.0))
    return joined.select(*by, "node", (F.col("r") / F.col("s")).alias("rank"))


def series_rank(u: np.ndarray, v: np.ndarray, total: np.ndarray, n: int, length: int = WALK, stop: float = STOP) -> np.ndarray:
    """As :func:`walk_rank` for one graph held in arrays."""
    out = np.bincount(u, total, n)
    p = total / out[u] if len(u) else total
    now = np.ones(n)
    visits = now.copy()
    for _ in range(length - 1):
        now = (1 - stop) * np.bincount(v, now[u] * p, n)
        visits += now
    return visits / visits.sum() if n else visits


def neighborhood_utility(ranks: DataFrame, undirected: DataFrame, *by: str) -> DataFrame:
    """``*by, node, utility``: a node's rank and that of its neighbours."""
    both = undirected.select(*by, F.col("a").alias("node"), F.col("b").alias("other")).unionAll(undirected.select(*by, F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.join(ranks.withColumnRenamed("node", "other"), [*by, "other"]).select(*by, "node", "rank")
    return near.unionAll(ranks.select(*by, "node", "rank")).groupBy(*by, "node").agg(F.sum("rank").alias("utility"))
