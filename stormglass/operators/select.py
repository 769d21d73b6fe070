"""Subtopics of a window and posts that cover them without repeating each other."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .steps import numbered

TOPICS_STOP, NOVELTY, PER_TOPIC, OVERLAP, DIVERSE_STOP = 0.05, 0.1, 50, 0.2, 0.01
ALIKE_BLOCK = 500_000  #: pairs of posts whose shared terms are counted at once


Lists = tuple[np.ndarray, np.ndarray]  #: lists of numbers end to end, with where each begins and the last ends


def lists(owner: np.ndarray, member: np.ndarray, n: int) -> Lists:
    """The different members of each owner, 0 to n - 1, in order."""
    order = np.lexsort((member, owner))
    owner, member = owner[order], member[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (member[1:] != member[:-1])] if len(owner) else np.zeros(0, bool)
    return np.searchsorted(owner[new], np.arange(n + 1)), member[new]


def subtopics(rank: np.ndarray, near: Lists, posts: Lists, n_posts: int, stop: float = TOPICS_STOP, novelty: float = NOVELTY) -> list[int]:
    """Terms that stand for subtopics, in order, by number.

    The term of the largest utility (its rank and its neighbours') is taken; one
    whose posts are mostly new is general, set aside and put at the end. Others
    are accepted, what they and their neighbours explain is taken off the
    utilities nearby, until the best is below a share of the sum of those taken.
    """
    n = len(rank)
    first, other = near
    utility = rank + np.bincount(np.repeat(np.arange(n), np.diff(first)), rank[other], n) if n else rank
    left, done = np.ones(n, bool), np.zeros(n, bool)
    covered, n_covered, seen = np.zeros(n_posts, bool), 0, 0.0
    accepted: list[int] = []
    general: list[int] = []
    while left.any():
        b = int(np.where(left, utility.round(12), -np.inf).argmax())
        left[b] = False
        own = posts[1][posts[0][b] : posts[0][b + 1]]
        fresh = int((~covered[own]).sum())
        if fresh / max(1, n_covered + fresh) > novelty:
            general.append(b)
            covered[own] = True
            n_covered += fresh
            continue
        seen += utility[b]
        if utility[b] <= 0 or utility[b] / seen < stop:
            break
        accepted.append(b)
        around = other[first[b] : first[b + 1]]
        if not done[b]:
            utility[around] -= rank[b] + rank[around]
        for c in around[~done[around]]:
            utility[other[first[c] : first[c + 1]]] -= rank[c]
        done[around] = True
        done[b] = True
    return accepted + general


def jaccard(a: frozenset, b: frozenset) -> float:
    union = len(a | b)
    return len(a & b) / union if union else 0.0


#: How posts are chosen for the subtopics. ``measure``: the sum of ranks of a post's terms without topic terms ("new") or
#: of all ("all"), or its similarity to the topic's other posts ("alike"). ``apart``: a post is held against those chosen
#: for all topics, for its own, or none. ``once``: a post counts for its first topic only.
SELECTORS = {
    "new": {"measure": "new", "apart": "all", "once": True},
    "all": {"measure": "all", "apart": "all", "once": True},
    "per_topic": {"measure": "new", "apart": "topic", "once": False},
    "without_redundancy": {"measure": "new", "apart": "topic", "once": True},
    "score_only": {"measure": "new", "apart": "none", "once": False},
    "most_alike": {"measure": "alike", "apart": "none", "once": False},
}


def alike(own: list[str], terms: dict[str, frozenset]) -> dict[str, float]:
    """The sum of each post's similarities to the others, from the terms they share: counted in blocks of posts against all."""
    m, at = len(own), {}
    size = np.array([len(terms[p]) for p in own], np.int64)
    start = np.r_[0, np.cumsum(size)]
    term = np.fromiter((at.setdefault(t, len(at)) for p in own for t in terms[p]), np.int64, int(start[-1]))
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(term, kind="stable")
    by, first = owner[order], np.searchsorted(term[order], np.arange(len(at) + 1))
    total, step = np.zeros(m), max(1, ALIKE_BLOCK // max(1, m))
    for a in range(0, m, step):
        b = min(m, a + step)
        own_terms = term[start[a] : start[b]]
        n = first[own_terms + 1] - first[own_terms]
        place = np.repeat(first[own_terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(owner[start[a] : start[b]] - a, n) * m + by[place]
        shared = np.bincount(cell, minlength=(b - a) * m).reshape(b - a, m)
        each = shared / np.maximum(1, size[a:b, None] + size[None, :] - shared)
        each[np.arange(b - a), np.arange(a, b)] = 0.0
        total[a:b] = each.sum(axis=1)
    return dict(zip(own, total.tolist()))


def choose_posts(topics: list[str], rank: dict[str, float], terms: dict[str, frozenset], per_topic: int = PER_TOPIC, overlap: float = OVERLAP, score: str = "new", representative: bool = False) -> list[tuple[str, float]]:
    """Posts for the topics in turn, the best first; one too similar to a chosen one is left out.

    ``score`` names one of :data:`SELECTORS`. With ``representative`` only posts
    count of which no term has a higher rank than the topic's. A post chosen
    for several topics is listed once, at the first.
    """
    how = SELECTORS[score]
    chosen: dict[str, float] = {}
    taken: set[str] = set()
    outside = set(topics) if how["measure"] == "new" else set()
    by: dict[str, list[str]] = {}
    for p, ts in terms.items():
        for t in ts:
            by.setdefault(t, []).append(p)
    met: dict[str, list[str]] = {}

    def repeats(p: str) -> bool:
        shared = Counter(q for t in terms[p] for q in met.get(t, ()))
        return any(n / (len(terms[p]) + len(terms[q]) - n) > overlap for q, n in shared.items())

    for t in topics:
        own = [p for p in by.get(t, []) if p not in taken and not (representative and any(rank.get(x, 0.0) > rank.get(t, 0.0) for x in terms[p]))]
        if how["once"]:
            taken.update(own)
        if how["apart"] != "all":
            met = {}
        value = alike(own, terms) if how["measure"] == "alike" else {p: sum(rank.get(x, 0.0) for x in sorted(terms[p]) if x not in outside) for p in own}
        kept = 0
        for p in sorted(own, key=lambda p: (-round(value[p], 12), p)):
            if kept == per_topic:
                break
            if how["apart"] == "none" or not repeats(p):
                chosen.setdefault(p, value[p])
                kept += 1
                for x in terms[p]:
                    met.setdefault(x, []).append(p)
    return list(chosen.items())


def diversify(names: list[str], terms: dict[str, frozenset], stop: float = DIVERSE_STOP, cover: float | None = None) -> list[tuple[str, float]]:
    """Posts by what they share with the others; what is shared with a chosen one
    counts no more. With ``cover`` those at least that similar to it are left out."""
    by: dict[str, list[str]] = {}
    for p in names:
        for t in terms[p]:
            by.setdefault(t, []).append(p)
    shared = {p: Counter(q for t in terms[p] for q in by[t] if q != p) for p in names}
    s = {p: {q: n / (len(terms[p]) + len(terms[q]) - n) for q, n in sorted(shared[p].items())} for p in names}
    value = {p: sum(x.values()) for p, x in s.items()}
    heap = [(-round(v, 12), p) for p, v in value.items()]
    heapq.heapify(heap)
    seen = 0.0
    out: list[tuple[str, float]] = []
    while heap:
        v, p = heapq.heappop(heap)
        if p not in value:
            continue
        if v != -round(value[p], 12):
            heapq.heappush(heap, (-round(value[p], 12), p))
            continue
        seen += value[p]
        if value[p] <= 0 or value[p] / seen < stop:
            break
        out.append((p, value.pop(p)))
        for q, v in s[p].items():
            if q in value:
                if cover is not None and v >= cover:
                    del value[q]
                else:
                    value[q] -= v
    return out or [(p, 0.0) for p in names[:1]]


def posts_for_topics(snapshots: DataFrame, counts: DataFrame, topics: int, per_topic: int, overlap: float = OVERLAP) -> DataFrame:
    """``snapshot, place, tweet_id, value``: posts for the ``topics`` most frequent terms of each window.

    ``counts`` has ``snapshot, term, n``. A post belongs to the first topic it
    holds, by place; its value is the sum of n of its different terms that are no
    topics. Values and places are joins; only posts that hold a topic go to the
    greedy step, where one too similar to a chosen one is left out.
    """
    place = Window.partitionBy("snapshot").orderBy(F.desc("n"), "term")
    top = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= topics).select("snapshot", "term", "place")
    each = snapshots.select("snapshot", "tweet_id", F.explode(F.array_distinct("terms")).alias("term"))
    valued = each.join(counts, ["snapshot", "term"]).join(top, ["snapshot", "term"], "left")
    own = valued.groupBy("snapshot", "tweet_id").agg(F.coalesce(F.sum(F.when(F.col("place").isNull(), F.col("n"))), F.lit(0)).alias("value"), F.min("place").alias("place"), F.collect_list("term").alias("terms")).where("place IS NOT NULL")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["place", "value", "tweet_id"], ascending=[True, False, True], kind="stable")
        met: dict[str, list[int]] = {}
        kept: list[tuple] = []
        n: Counter = Counter()
        for p, t, v, terms in zip(g["place"], g["tweet_id"], g["value"], g["terms"]):
            terms = frozenset(terms)
            shared = Counter(i for x in terms for i in met.get(x, ()))
            if n[p] < per_topic and not any(m / (len(terms) + kept[i][3] - m) > overlap for i, m in shared.items()):
                for x in terms:
                    met.setdefault(x, []).append(len(kept))
                kept.append((p, t, v, len(terms)))
                n[p] += 1
        return pd.DataFrame({"snapshot": key[0], "place": [k[0] for k in kept], "tweet_id": [k[1] for k in kept], "value": [k[2] for k in kept]})

    return own.groupBy("snapshot").applyInPandas(run, "snapshot int, place int, tweet_id string, value bigint")


def inc_summary(words: DataFrame, snapshots: DataFrame, cover: float | None = None, length: int = 20, stage: str = "diverse", per_topic: int = PER_TOPIC, ways: dict[str, dict] | None = None) -> DataFrame:
    """``snapshot, rank_no, tweet_id, score``: the diversified summary of each window;
    with ``stage`` "posts" what is chosen before that, with "topics" the subtopic
    terms (in place of ids) with their rank. With ``ways``, names and what they
    ask of :func:`choose_posts`, that is given for each, with its name as
    ``selector``: graph, ranks and subtopics, which they share, are made once.

    The directed word graphs of all windows are one join over counts per step;
    ranks and the greedy choice, sequential by nature, run per window on its
    graph, which the choice needs as a whole anyway. Nothing but sets of terms,
    edges and ids goes there; texts stay outside.
    """
    plain, names, dictionary = numbered(words)
    own = words.select("tweet_id", "step").join(plain, "tweet_id")
    walkable = graph.window_edges(own)
    seen = snapshots.select("snapshot", "tweet_id").join(plain, "tweet_id")
    # A post's terms are rows of weight 0, so that all columns are numbers.
    left = seen.select("snapshot", F.col("post").alias("a"), F.explode(F.array_distinct("terms")).alias("b"), F.lit(0).cast("bigint").alias("w"))
    right = walkable.select("snapshot", F.col("u").alias("a"), F.col("v").alias("b"), F.col("total").alias("w"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a, b, w = (g[c].to_numpy(np.int64) for c in "abw")
        held, edge = w == 0, w > 0
        order = np.lexsort((b[held], a[held]))
        posts, flat = a[held][order], b[held][order]
        ids, size = np.unique(posts, return_counts=True)
        known = np.unique(flat)  # the window's terms, in order
        terms, post = np.searchsorted(known, flat), np.repeat(np.arange(len(ids)), size)
        u, v = np.searchsorted(known, a[edge]), np.searchsorted(known, b[edge])
        order = np.lexsort((v, u))
        u, v, n = u[order], v[order], len(known)
        rank = graph.series_rank(u, v, w[edge].astype(float)[order], n, length)
        found = subtopics(rank, lists(np.r_[u, v], np.r_[v, u], n), lists(terms, post, n), len(ids))
        if stage == "topics":
            best = [("", k, known[t], rank[t]) for k, t in enumerate(found, 1)]
        else:
            sets = {i: frozenset(x.tolist()) for i, x in enumerate(np.split(terms, np.cumsum(size)[:-1]))}
            ranks, best = dict(enumerate(rank.tolist())), []
            for name, how in (ways or {"": {}}).items():
                picked = choose_posts(found, ranks, sets, per_topic, **how)
                if stage == "diverse":
                    picked = diversify([i for i, _ in picked], sets, cover=cover)
                best += [(name, k, ids[i], x) for k, (i, x) in enumerate(picked, 1)]
        return pd.DataFrame({"snapshot": key[0], "rank_no": np.array([x[1] for x in best], np.int32), "id": np.array([x[2] for x in best], np.int64), "score": np.array([x[3] for x in best], float), "selector": [x[0] for x in best]})

    out = left.unionAll(right).groupBy("snapshot").applyInPandas(run, "snapshot int, rank_no int, id bigint, score double, selector string")
    back = dictionary.select(F.col("number").alias("id"), F.col("term").alias("tweet_id")) if stage == "topics" else names.select(F.col("post").alias("id"), "tweet_id")
    return out.join(back, "id").select("snapshot", "rank_no", "tweet_id", "score", *(["selector"] if ways else []))
