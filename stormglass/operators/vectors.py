"""Term statistics, sparse vectors and similar pairs, as joins on terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2000  #: vectors that meet as many others in one task


def occurrences(words: DataFrame, *keep: str) -> DataFrame:
    return words.select(*keep, F.explode("terms").alias("term"))


def term_count(words: DataFrame, *by: str) -> DataFrame:
    """Occurrences (not posts) per term."""
    return occurrences(words, *by).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))


def windowed_term_count(words: DataFrame, window: int = 12) -> DataFrame:
    """Occurrences per snapshot and term: counted per step first, then summed
    over the steps a snapshot sees, so each post is counted once."""
    per = term_count(words, "step")
    steps = words.select(F.col("step").alias("snapshot")).distinct()
    seen = per.select(F.explode(F.sequence(F.col("step") + 1, F.col("step") + window)).alias("snapshot"), "term", "n")
    return seen.groupBy("snapshot", "term").agg(F.sum("n").alias("n")).join(steps, "snapshot", "left_semi")


def doc_freq(words: DataFrame) -> DataFrame:
    """``term, df, idf``: posts per term and ln(N / df)."""
    n = words.count()
    per = words.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return per.withColumn("idf", F.log(F.lit(float(max(n, 1))) / F.col("df")))


def weights(words: DataFrame, key: str, *by: str) -> DataFrame:
    """``*by, key, term, weight``: each occurrence weighs ln(1 + N / occurrences),
    N and occurrences within the group ``by`` (a snapshot or step; all posts if none)."""
    counts = term_count(words, *by).withColumnRenamed("n", "_c")
    tf = occurrences(words, *by, key).groupBy(*by, key, "term").agg(F.count(F.lit(1)).alias("tf"))
    joined = tf.join(counts, [*by, "term"])
    joined = joined.join(words.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), list(by)) if by else joined.withColumn("_n", F.lit(words.count()))
    return joined.select(*by, key, "term", (F.col("tf") * F.log1p(F.col("_n") / F.col("_c"))).alias("weight"))


def norms(vectors: DataFrame, key: str, *by: str) -> DataFrame:
    return vectors.groupBy(*by, key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def units(vectors: DataFrame, key: str, *by: str) -> DataFrame:
    """Vectors scaled to length one; those without length are left out."""
    whole = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*by, key)))
    return vectors.withColumn("_norm", whole).where("_norm > 0").select(*by, key, "term", (F.col("weight") / F.col("_norm")).alias("weight"))


def similar_pairs(vectors: DataFrame, key: str, threshold: float, *by: str) -> DataFrame:
    """``*by, a, b, similarity`` with a < b: cosine of at least ``threshold``
    between vectors of one group, from the terms they share.

    Vectors are scaled before they meet, so the pairs are joined once and summed
    once, and nothing is joined to them afterwards.
    """
    unit = units(vectors, key, *by)
    left = unit.select(*by, "term", F.col(key).alias("a"), F.col("weight").alias("x"))
    right = unit.select(*by, "term", F.col(key).alias("b"), F.col("weight").alias("y"))
    dots = left.join(right, [*by, "term"]).where("a < b").groupBy(*by, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))
    return dots.where(F.round("similarity", 9) >= threshold)


def blocked_pairs(vectors: DataFrame, key: str, threshold: float, by: str, block: int = BLOCK) -> DataFrame:
    """As :func:`similar_pairs` for whole-number keys and terms (:func:`stormglass.operators.steps.numbered`).

    A group's vectors are divided by key into blocks of ``block`` or so, and every two
    blocks meet in one task, which adds up products by term in a matrix of that
    size. A term that all vectors share makes no task larger than any other, and
    only pairs at or above the threshold leave it.
    """
    unit = units(vectors, key, by)
    n = unit.groupBy(by).agg(F.countDistinct(key).alias("_n")).select(by, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    own = unit.join(n, by).withColumn("_x", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = own.select(by, F.least("_x", "_y").alias("_lo"), F.greatest("_x", "_y").alias("_hi"), F.col("_x"), F.col(key).alias("a"), "term", "weight")

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        same = k[1] == k[2]
        low = g["_x"].to_numpy() == k[1]
        side = [_sorted(g[c]) for c in ((low,) if same else (low, ~low))]
        left, right = side[0], side[-1]
        total = np.zeros(len(left[0]) * len(right[0]))
        for i, j, w in _products(left, right):
            total += np.bincount(i * len(right[0]) + j, w, len(total))
        total = total.reshape(len(left[0]), -1)
        i, j = np.nonzero(total.round(9) >= threshold)
        if same:
            i, j = i[i < j], j[i < j]
        x, y = left[0][i], right[0][j]
        return pd.DataFrame({by: k[0], "a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": total[i, j]})

    kind = vectors.schema[by].dataType.simpleString()
    return sent.groupBy(by, "_lo", "_hi").applyInPandas(run, f"{by} {kind}, a bigint, b bigint, similarity double")


def _sorted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys, and the rows by term: the term, the key's place, the weight."""
    keys, place = np.unique(rows["a"].to_numpy(np.int64), return_inverse=True)
    term = rows["term"].to_numpy(np.int64)
    order = np.lexsort((place, term))
    return keys, term[order], place[order], rows["weight"].to_numpy(float)[order]


def _products(left: tuple, right: tuple, at_once: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and products of all rows of equal terms, some millions at a time."""
    _, t, i, x = left
    _, u, j, y = right
    first, last = np.searchsorted(u, t, side="left"), np.searchsorted(u, t, side="right")
    many = last - first
    ends = np.cumsum(many)
    start = 0
    while start < len(t):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, side="right")))
        m = many[start:stop]
        rows = np.repeat(np.arange(start, stop), m)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[start:stop], m)
        yield i[rows], j[other], x[rows] * y[other]
        start = stop


def mean_similarity(vectors: DataFrame, key: str, *by: str) -> DataFrame:
    """``*by, n, mean``: the mean cosine of all pairs of a group's vectors, null below two.

    The sum over all pairs is that of the summed unit vectors with themselves,
    so no pair is formed.
    """
    unit = units(vectors, key, *by)
    n = unit.groupBy(*by, key).agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    whole = unit.groupBy(*by, "term").agg(F.sum("weight").alias("s")).groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("s"))
    return n.join(whole, list(by)).select(*by, "n", F.when(F.col("n") > 1, (F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean"))


def jaccard_pairs(words: DataFrame, key: str, threshold: float, *by: str) -> DataFrame:
    """As :func:`similar_pairs` for the Jaccard similarity of term sets."""
    sized = words.select(*by, F.col(key).alias("k"), F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    left = sized.select(*by, "term", F.col("k").alias("a"), F.col("n").alias("na"))
    right = sized.select(*by, "term", F.col("k").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, [*by, "term"]).where("a < b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("i"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return met.select(*by, "a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("similarity")).where(F.round("similarity", 9) >= threshold)


def cluster_vectors(vectors: DataFrame, key: str, cluster: str) -> DataFrame:
    """``cluster, term, norm_sum, weight_sum``: sums of unit and of plain vectors, which merge by adding."""
    unit = vectors.join(norms(vectors, key).where("norm > 0"), key)
    return unit.groupBy(cluster, "term").agg(F.sum(F.col("weight") / F.col("norm")).alias("norm_sum"), F.sum("weight").alias("weight_sum"))


def cluster_stats(sums: DataFrame, times: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: posts, sums of step and squared step, and the average similarity
    of a post to the centroid."""
    per = sums.groupBy(cluster).agg(F.sum(F.col("norm_sum") * F.col("weight_sum")).alias("dot"), F.sqrt(F.sum(F.col("weight_sum") * F.col("weight_sum"))).alias("length"))
    t = times.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("sum_t"), F.sum(F.col("step") * F.col("step")).alias("sum_t2"))
    joined = t.join(per, cluster)
    return joined.select(cluster, "n", "sum_t", "sum_t2", (F.col("dot") / (F.col("n") * F.col("length"))).alias("avg_similarity"))


def normal_quantile(p: float) -> float:
    """The quantile of the standard normal by seven terms of the series of the inverse error function."""
    import math

    z, c, total = 2 * p - 1, [1.0], 0.0
    for k in range(1, 7):
        c.append(sum(c[m] * c[k - 1 - m] / ((m + 1) * (2 * m + 1)) for m in range(k)))
    for k in range(7):
        total += c[k] / (2 * k + 1) * (math.sqrt(math.pi) / 2 * z) ** (2 * k + 1)
    return total * math.sqrt(2)


def freshness(stats: DataFrame, least: int = 50, p: float = 0.95) -> DataFrame:
    """Adds ``freshness``: the mean step of small clusters, of larger ones the step below which ``p`` of their posts lie."""
    mean = F.col("sum_t") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("sum_t2") / F.col("n") - mean * mean, F.lit(0.0)))
    return stats.withColumn("freshness", F.when(F.col("n") < least, mean).otherwise(mean + spread * normal_quantile(p)))
