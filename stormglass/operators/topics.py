"""One topic per post by Gibbs sampling over all posts, and posts that represent the topics of a window."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.runtime import materialize

from .select import jaccard

LEAST_UNIQUE, CONFIDENT, SCORED_UNIQUE = 5, 0.8, 7
TOPICS, BETA, BURN, SWEEPS, EVERY = 30, 0.01, 100, 600, 20
POSTS_PER_PART = 4000  #: posts a task samples between two exchanges of counts
PARTS_AT_ONCE = 32  #: a task updates its counts after each so-manieth part of its posts


def core_terms(occurrences: DataFrame, least_count: int = 5, least_terms: int = 3) -> DataFrame:
    """``tweet_id, term`` left when terms with few occurrences and posts with few
    terms are dropped in turn, until nothing changes."""
    now, n = materialize(occurrences.select("tweet_id", "term")), None
    while True:
        terms = now.groupBy("term").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_count).select("term")
        kept = now.join(terms, "term", "left_semi")
        posts = kept.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_terms).select("tweet_id")
        now = materialize(kept.join(posts, "tweet_id", "left_semi"))
        m = now.count()
        if m == n or not m:
            return now
        n = m


class Sampler:
    """Posts of one part as flat arrays; draws their topics against counts of terms.

    A post's probability under a topic multiplies the counts of its terms, each
    occurrence of a term raised by those before it in the post, over the topic's
    total, raised by the place in the post; the post itself is taken out first.
    """

    def __init__(self, posts: list[list[int]], z: np.ndarray, n_terms: int, topics: int, beta: float):
        self.z, self.topics, self.beta, self.n_terms = z, topics, beta, n_terms
        self.size = np.array([len(p) for p in posts], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.term = np.fromiter((w for p in posts for w in p), np.int64, int(self.start[-1]))
        self.place = np.arange(len(self.term)) - np.repeat(self.start[:-1], self.size)
        self.post = np.repeat(np.arange(len(posts)), self.size)
        # Terms of a post are sorted: how often a term stood before in its post is its distance to the run's begin.
        run = np.r_[True, (self.term[1:] != self.term[:-1]) | (self.post[1:] != self.post[:-1])] if len(self.term) else np.zeros(0, bool)
        self.before = np.arange(len(self.term)) - np.maximum.accumulate(np.where(run, np.arange(len(self.term)), 0)) if len(self.term) else self.place
        # How often its post holds the term: runs by their length.
        at = np.flatnonzero(run)
        self.times = np.repeat(np.diff(np.r_[at, len(self.term)]), np.diff(np.r_[at, len(self.term)]))

    def sweep(self, terms: np.ndarray, total: np.ndarray, per: np.ndarray, alpha: float, rng: np.random.Generator) -> None:
        """One draw for every post; the counts (``terms`` by topic, ``total``, ``per``) follow."""
        n, longest = len(self.size), int(self.size.max(initial=0))
        by_term = np.ascontiguousarray(terms.T)
        flat = by_term.reshape(-1)  # the same numbers
        # Logs of all counts; a draw changes few.
        logs = np.log(np.maximum(by_term, 0) + self.beta)
        steps = np.arange(longest)[:, None]
        for a in range(0, n, max(1, -(-n // PARTS_AT_ONCE))):
            b = min(n, a + max(1, -(-n // PARTS_AT_ONCE)))
            lo, hi = self.start[a], self.start[b]
            term, post, z, size = self.term[lo:hi], self.post[lo:hi] - a, self.z[a:b], self.size[a:b]
            here, every = np.arange(hi - lo), np.arange(b - a)
            # What the post itself adds to its topic: of each term as often as it holds it, of all as long as it is.
            each = logs[term]
            raised = np.flatnonzero(self.before[lo:hi])
            each[raised] = np.log(np.maximum(by_term[term[raised]], 0) + (self.beta + self.before[lo:hi][raised])[:, None])
            was = term * self.topics + z[post]
            each[here, z[post]] = np.log(np.maximum(flat[was] - self.times[lo:hi], 0) + (self.beta + self.before[lo:hi]))
            like = np.add.reduceat(each, self.start[a:b] - lo) if hi > lo else np.zeros((b - a, self.topics))
            # The totals depend on a post's length and topic only: logs are added up by place for all lengths there are.
            bottom = self.n_terms * self.beta
            like -= np.vstack([np.zeros(self.topics), np.cumsum(np.log(np.maximum(total, 0) + bottom + steps), axis=0)])[size]
            plain = np.log(np.maximum(total[z], 0) + bottom + steps)
            less = np.log(np.maximum(total[z] - size, 0) + bottom + steps)
            like[every, z] += np.where(steps < size, plain - less, 0.0).sum(axis=0)
            mine = np.zeros((b - a, self.topics))
            mine[every, z] = 1.0
            logp = like + np.log(np.maximum(per[None, :] - mine, 0) + alpha)
            q = np.cumsum(np.exp(logp - logp.max(axis=1, keepdims=True)), axis=1)
            new = np.minimum((q < rng.random((b - a, 1)) * q[:, -1:]).sum(axis=1), self.topics - 1)
            now = term * self.topics + new[post]
            np.add.at(flat, was, -1.0)
            np.add.at(flat, now, 1.0)
            for cells in (was, now):
                logs.reshape(-1)[cells] = np.log(np.maximum(flat[cells], 0) + self.beta)
            np.add.at(total, z, -size.astype(float))
            np.add.at(total, new, size.astype(float))
            np.add.at(per, z, -1.0)
            np.add.at(per, new, 1.0)
            self.z[a:b] = new
        terms[:] = by_term.T


def _seed(*parts: int) -> np.random.Generator:
    return np.random.default_rng([abs(p) for p in parts])


def fit(core: DataFrame, topics: int = TOPICS, sweeps: int = SWEEPS, burn: int = BURN, every: int = EVERY, beta: float = BETA, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``topic, term, phi`` and ``topic, theta`` of all posts in ``core``, materialized.

    Every post takes part. Posts are divided into parts by a hash of their id,
    4,000 or so each; a task sweeps its part ``every`` times against the counts
    of all, its own changes included, then the parts' topics are written and
    counted anew (two aggregations, by topic and by topic and term). Counts go to
    a part only for its own terms, by a join, so no table of all terms is held
    anywhere. After ``burn`` sweeps the distributions are added up at each
    exchange. With one part, as on small tables, this is the sequential sampler
    but for the posts drawn at once. Deterministic for given parts.
    """
    spark = core.sparkSession
    alpha = 50.0 / topics
    posts = core.groupBy("tweet_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    n_posts = core.select("tweet_id").distinct().count()
    n_terms = core.select("term").distinct().count()
    if not n_posts:
        return spark.createDataFrame([], "topic int, term string, phi double"), spark.createDataFrame([(k, 1.0 / topics) for k in range(topics)], "topic int, theta double")
    parts = max(1, math.ceil(n_posts / POSTS_PER_PART))
    spread = posts.withColumn("part", F.pmod(F.xxhash64("tweet_id"), F.lit(parts)).cast("int"))
    state = materialize(spread.withColumn("z", F.pmod(F.xxhash64("tweet_id", F.lit(seed)), F.lit(topics)).cast("int")).repartition(min(parts, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part", "tweet_id"))
    needed = materialize(state.select("part", F.explode(F.array_distinct("terms")).alias("term")).distinct())

    def run(number: int, sizes: tuple):
        def sample(key: tuple, own: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("tweet_id", kind="stable")
            names = sorted({t for ts in own["terms"] for t in ts})
            at = {t: i for i, t in enumerate(names)}
            terms = np.zeros((topics, n_terms if len(names) == n_terms else len(names)))
            for t, row in zip(counts["term"], counts["per_topic"]):
                if row is not None:
                    terms[:, at[t]] = row
            rows = [[at[t] for t in ts] for ts in own["terms"]]
            s = Sampler([sorted(r) for r in rows], own["z"].to_numpy(np.int64).copy(), n_terms, topics, beta)
            per, total = (np.array(x, float) for x in sizes)
            rng = _seed(seed, number, int(key[0]))
            for _ in range(every):
                s.sweep(terms, total, per, alpha, rng)
            return own.assign(z=s.z.astype(np.int32))[["part", "tweet_id", "terms", "z"]]

        return sample

    held: DataFrame | None = None
    theta, taken = np.zeros(topics), 0
    sizes, counts = _counted(state, topics)
    for number in range(math.ceil(sweeps / every)):
        sent = needed.join(counts, "term", "left")
        state = materialize(state.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(run(number, sizes), "part int, tweet_id string, terms array<string>, z int"))
        sizes, counts = _counted(state, topics)
        if (number + 1) * every > burn:
            theta, taken = theta + _shares(sizes, alpha, n_posts), taken + 1
            one = _phi(sizes, counts, beta, n_terms)
            held = one if held is None else held.unionAll(one)
    held = held if held is not None else _phi(sizes, counts, beta, n_terms)
    taken = max(1, taken)
    # A term's row per sample holds all topics; topics without it have the smoothed share of the sample.
    phi = held.groupBy("term").agg(*[(F.sum(F.get("phi", F.lit(k))) / taken).alias(f"k{k}") for k in range(topics)])
    long = phi.select("term", F.posexplode(F.array(*[F.col(f"k{k}") for k in range(topics)])).alias("topic", "phi"))
    theta = theta / taken if theta.sum() else _shares(sizes, alpha, n_posts)
    return materialize(long.select("topic", "term", "phi")), materialize(spark.createDataFrame([(k, float(x)) for k, x in enumerate(theta)], "topic int, theta double"))


def _counted(state: DataFrame, topics: int) -> tuple[tuple[list, list], DataFrame]:
    """The posts and the terms of each topic, and, written once for sweeps and samples, ``term, per_topic``."""
    counted = state.select("z", F.explode("terms").alias("term")).groupBy("term").agg(*[F.sum((F.col("z") == k).cast("int")).alias(f"k{k}") for k in range(topics)])
    per = {r["z"]: (r["n"], r["l"]) for r in state.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("l")).collect()}
    return tuple([per.get(k, (0, 0))[i] for k in range(topics)] for i in range(2)), materialize(counted.select("term", F.array(*[F.col(f"k{k}") for k in range(topics)]).alias("per_topic")))


def _shares(sizes: tuple[list, list], alpha: float, n_posts: int) -> np.ndarray:
    return (np.array(sizes[0]) + alpha) / (n_posts + len(sizes[0]) * alpha)


def _phi(sizes: tuple[list, list], counts: DataFrame, beta: float, n_terms: int) -> DataFrame:
    """``term, phi`` of one sample, the shares under all topics in an array."""
    return counts.select("term", F.array(*[(F.get("per_topic", F.lit(k)) + beta) / (n + n_terms * beta) for k, n in enumerate(sizes[1])]).alias("phi"))


def infer(core: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """``tweet_id, topic, posterior, n_unique, score``: each post's most probable
    topic; the score is the mean probability of its different terms there, 0 if
    they are few. Every post has a row: a term the model lacks, as when posts came
    later, says nothing about the topic but counts among the different ones, with
    the probability 0; a post of such terms only has the most probable topic."""
    seen = core.groupBy("tweet_id", "term").agg(F.count(F.lit(1)).alias("n"))
    per = phi.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("topic", "phi"))).alias("phis"))
    named = F.array_sort(F.collect_list(F.struct("topic", "theta")))
    prior = theta.agg(named.alias("m"))
    row = prior.first()["m"] or []
    topics, shares = [int(r["topic"]) for r in row], [float(r["theta"]) for r in row]
    joined = seen.join(per, "term", "left").select("tweet_id", "n", F.transform("phis", lambda p: p["phi"]).alias("phis"))

    def of(k: int):
        return F.get("phis", F.lit(k))

    sums = joined.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n_unique"), *[F.sum(F.coalesce(F.col("n") * F.log(of(k)), F.lit(0.0))).alias(f"l{k}") for k in range(len(topics))], *[F.sum(F.coalesce(of(k), F.lit(0.0))).alias(f"s{k}") for k in range(len(topics))])
    likes = F.array(*[F.struct((F.col(f"l{k}") + math.log(shares[k])).alias("l"), F.lit(-t).alias("t"), (F.col(f"s{k}") / F.col("n_unique")).alias("mean")) for k, t in enumerate(topics)])
    best = sums.select("tweet_id", "n_unique", likes.alias("a")).withColumn("m", F.array_max("a"))
    whole = F.aggregate(F.transform("a", lambda x: F.exp(x["l"] - F.col("m.l"))), F.lit(0.0), lambda s, x: s + x)
    score = F.when(F.col("n_unique") >= SCORED_UNIQUE, F.col("m.mean")).otherwise(0.0)
    return best.select("tweet_id", (-F.col("m.t")).alias("topic"), (1 / whole).alias("posterior"), "n_unique", score.alias("score"))


def confident(inferred: DataFrame) -> DataFrame:
    return inferred.where((F.col("n_unique") >= LEAST_UNIQUE) & (F.col("posterior") >= CONFIDENT))


def topic_share(inferred: DataFrame, by: str = "snapshot") -> DataFrame:
    """``by, topic, share`` among the confident posts of each window."""
    per = confident(inferred).groupBy(by, "topic").agg(F.count(F.lit(1)).alias("n"))
    return per.select(by, "topic", (F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("share"))


def representatives(inferred: DataFrame, mass: float = 0.9, near: float = 0.5) -> DataFrame:
    """``snapshot, rank_no, tweet_id, topic``: per window the best post of each of
    the topics that make up ``mass`` of it, without near copies.

    ``inferred`` has a row per window and post, with ``terms``. A window sends one
    post per topic to the last step.
    """
    order = Window.partitionBy("snapshot").orderBy(F.desc("share"), "topic").rowsBetween(Window.unboundedPreceding, -1)
    top = topic_share(inferred).withColumn("before", F.coalesce(F.sum("share").over(order), F.lit(0.0))).where(F.round("before", 9) < mass)
    best = confident(inferred).groupBy("snapshot", "topic").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "tweet_id", "terms")).alias("m"))
    rows = best.join(top, ["snapshot", "topic"]).select("snapshot", "topic", "share", "m.tweet_id", "m.terms")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["share", "topic"], ascending=[False, True], kind="stable")
        kept: list[tuple] = []
        for p, t, terms in zip(g["tweet_id"], g["topic"], g["terms"]):
            if all(jaccard(frozenset(terms), k[2]) < near for k in kept):
                kept.append((p, t, frozenset(terms)))
        return pd.DataFrame({"snapshot": key[0], "rank_no": range(1, len(kept) + 1), "tweet_id": [k[0] for k in kept], "topic": [k[1] for k in kept]})

    return rows.groupBy("snapshot").applyInPandas(run, "snapshot int, rank_no int, tweet_id string, topic int")


def in_windows(inferred: DataFrame, steps: DataFrame, window: int = 12) -> DataFrame:
    """Each post once per window that sees it: those of the window's step and the steps before it, ``window`` in all."""
    at = steps.select(F.col("step").alias("snapshot")).distinct()
    seen = steps.withColumn("snapshot", F.explode(F.sequence(F.col("step"), F.col("step") + window - 1))).join(at, "snapshot", "left_semi")
    return seen.join(inferred, "tweet_id")


def top_terms(phi: DataFrame, k: int = 10) -> DataFrame:
    """``topic, term, phi`` of each topic's ``k`` most probable terms."""
    order = Window.partitionBy("topic").orderBy(F.desc("phi"), "term")
    return phi.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def coherence(core: DataFrame, phi: DataFrame, k: int = 10) -> DataFrame:
    """``topic, coherence``: how often the ``k`` top terms of a topic stand in one post, as the sum of
    ln((posts with both + 1) / posts with one) over ordered pairs, by the number of pairs."""
    top = F.broadcast(top_terms(phi, k).select("topic", "term"))  # topics times k rows
    held = core.distinct().join(top, "term").groupBy("topic", "tweet_id").agg(F.collect_set("term").alias("t"))
    count = held.select("topic", F.explode("t").alias("u")).groupBy("topic", "u").agg(F.count(F.lit(1)).alias("n"))
    pair = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: a != b), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    both = held.select("topic", F.inline(pair)).groupBy("topic", "u", "v").agg(F.count(F.lit(1)).alias("m"))
    each = count.join(count.select("topic", F.col("u").alias("v")), "topic").where("u <> v").join(both, ["topic", "u", "v"], "left")
    return each.groupBy("topic").agg((F.sum(F.log((F.coalesce("m", F.lit(0)) + 1) / F.col("n"))) / (k * (k - 1) / 2)).alias("coherence"))


def given(core: DataFrame, topic: DataFrame, beta: float = BETA) -> tuple[DataFrame, DataFrame]:
    """``phi`` and ``theta`` of a given division of the posts: ``topic`` has ``tweet_id, topic``."""
    own = core.join(topic, "tweet_id")
    per = own.groupBy("topic").agg(F.count(F.lit(1)).alias("l"), F.countDistinct("tweet_id").alias("p"))
    n_terms, n_posts = core.agg(F.countDistinct("term"), F.countDistinct("tweet_id")).first()
    cells = core.select("term").distinct().crossJoin(F.broadcast(per.select("topic", "l")))  # a row per term and topic is the result
    n = own.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    phi = cells.join(n, ["topic", "term"], "left").select("topic", "term", ((F.coalesce("n", F.lit(0)) + beta) / (F.col("l") + n_terms * beta)).alias("phi"))
    return phi, per.select("topic", (F.col("p") / n_posts).alias("theta"))


def write_model(path: str, core: DataFrame, phi: DataFrame, theta: DataFrame, inferred: DataFrame, steps: DataFrame, k_terms: int = 10, k_posts: int = 5) -> None:
    """The files of a model below ``path``: words, topicWordDistributions, topWords, topPosts (by score), stepTopics, coherence, topics.

    ``steps`` has ``tweet_id, step, text``.
    """
    from stormglass.sources.sinks import write_csv

    order = Window.partitionBy("topic").orderBy(F.desc("score"), "tweet_id")
    best = inferred.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k_posts)
    per = inferred.join(steps.select("tweet_id", "step"), "tweet_id").groupBy("step", "topic").agg(F.count(F.lit(1)).alias("n"))
    parts = {
        "words": phi.select("term").distinct(),
        "topicWordDistributions": phi.select("topic", "term", "phi"),
        "topWords": top_terms(phi, k_terms),
        "topPosts": best.join(steps, "tweet_id").select("topic", "tweet_id", "score", F.regexp_replace("text", "[\r\n]", " ").alias("text")),
        "stepTopics": per.select("step", "topic", (F.col("n") / F.sum("n").over(Window.partitionBy("step"))).alias("share")),
        "coherence": coherence(core, phi, k_terms),
        "topics": theta,
    }
    for name, df in parts.items():
        write_csv(df, f"{path}/{name}")


__all__ = ["coherence", "confident", "core_terms", "fit", "given", "in_windows", "infer", "representatives", "top_terms", "topic_share", "write_model"]
