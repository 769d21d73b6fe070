"""Mixing sources to target weights, by iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.runtime import materialize

from .tokens import TOKENIZER, load

DIMS = 256
STEPS = 4096  #: sampling ranks are counted in this many steps per source
RANK_MAX = 4.0


def _features(tokens: list[int]) -> np.ndarray:
    """Square roots of the counts of hashed tokens, scaled to bytes."""
    v = np.sqrt(np.bincount(np.array(tokens, np.int64) * 2654435761 % 2**32 >> 24, minlength=DIMS).astype(np.float64))
    return np.rint(v / (v.max() or 1.0) * 255).astype(np.uint8)


def sized(df: DataFrame, key: str, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, *keep, n_tokens, vector`` of every row; texts are read once. A null or empty text has no token and a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer)[0].encode_ordinary
        for batch in batches:
            tokens = [encode(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            vector = [_features(t).tobytes() if t else None for t in tokens]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, tokens), pa.int64()), pa.array(vector, pa.binary())], names=[key, *keep, "n_tokens", "vector"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *keep])
    return df.select(key, *keep, text).mapInArrow(run, f"{kinds}, n_tokens bigint, vector binary")


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, DIMS).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_topics(sizes: DataFrame, key: str, topics: int = 8, sample: int = 2000, rounds: int = 20, settled: float = 1e-4) -> np.ndarray:
    """Centroids of ``topics`` groups of texts, by spherical k-means over the vectors of all rows.

    ``sizes`` is a result of :func:`sized`, materialized. The first centroids are
    far from each other among a bounded sample, the ``sample`` rows of the
    smallest hash of their key; each round is a pass over all rows that adds up
    vectors per centroid, until no centroid moves by more than ``settled``.
    Deterministic but for the order of sums. Without any text there is one topic.
    """
    rows = sizes.where("vector IS NOT NULL")
    start = rows.select(F.xxhash64(key).alias("h"), "vector").orderBy("h", "vector").limit(sample).collect()
    if not start:
        return np.zeros((1, DIMS))
    x = _unit([bytes(r["vector"]) for r in start])
    centers = x[:1]
    while len(centers) < min(topics, len(x)):
        centers = np.vstack([centers, x[(x @ centers.T).max(axis=1).argmin()]])

    def sums(centers: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(centers)
            for batch in batches:
                if batch.num_rows:
                    v = _unit(batch.column(0).to_pylist())
                    np.add.at(total, (v @ centers.T).argmax(axis=1), v)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(centers)), DIMS)), pa.array(np.tile(np.arange(DIMS), len(centers))), pa.array(total.ravel())], names=["c", "d", "x"])

        return run

    for _ in range(rounds):
        added = rows.select("vector").mapInArrow(sums(centers), "c bigint, d bigint, x double").groupBy("c", "d").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros_like(centers)
        total[added.column("c").to_numpy(), added.column("d").to_numpy()] = added.column("x").to_numpy()
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(norm > 0, total / np.maximum(norm, 1e-9), centers)
        moved = np.abs(new - centers).max()
        centers = new
        if moved < settled:
            break
    return centers


def assigned(sizes: DataFrame, centers: np.ndarray) -> DataFrame:
    """``sizes`` with ``topic`` in place of the vector; rows without text have topic 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("vector")
            vectors = [v or bytes(DIMS) for v in batch.column(at).to_pylist()]
            topic = (_unit(vectors) @ centers.T).round(9).argmax(axis=1) if vectors else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(topic, pa.int32())], names=[*(n for n in batch.schema.names if n != "vector"), "topic"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema if f.name != "vector")
    return sizes.mapInArrow(run, f"{kinds}, topic int")


def _fill(weight: np.ndarray, tokens: np.ndarray, cap: float, target: float) -> np.ndarray:
    """Scales weights, none above ``cap``, so that the weighted tokens are the target; all at the cap if it is out of reach."""
    if target <= 0 or not tokens.sum():
        return np.zeros_like(weight)
    weight = np.maximum(weight, 1e-12)
    if cap * tokens.sum() <= target * (1 + 1e-12):
        return np.full_like(weight, cap)
    lo, hi = 0.0, 1.0
    while (np.minimum(cap, hi * weight) * tokens).sum() < target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(cap, mid * weight) * tokens).sum() < target else (lo, mid)
    return np.minimum(cap, hi * weight)


def rake(cells: list[tuple], targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = 10_000) -> tuple[np.ndarray, float]:
    """Weights per cell (source, language, topic, tokens), and the size of the mix.

    Language and topic marginals are those of the collection's targeted tokens;
    source marginals the target shares, which come last in each round and so
    hold exactly, with no weight above the source's largest number of repeats.
    Without ``total`` the mix is the largest in which every target can hold;
    sources without tokens are left out of that, the others' shares then sum up
    to less than 1 of it and are scaled. Rounds end when no weight moves any more;
    where caps leave no weights that meet all marginals, the source shares hold
    and the rounds end at ``rounds``: :func:`marginals` reports the gap.
    """
    tokens = np.array([c[3] for c in cells], float)
    dims = [np.unique([str(c[i]) for c in cells], return_inverse=True) for i in range(3)]
    sources = dims[0][0] if len(cells) else []
    per = {s: tokens[dims[0][1] == i].sum() for i, s in enumerate(sources)}
    live = {s: t for s, t in targets.items() if t[0] > 0 and per.get(s, 0) > 0}
    share = sum(t[0] for t in live.values())
    if not live:
        return np.zeros(len(cells)), 0.0
    most = min(t[1] * per[s] / (t[0] / share) for s, t in live.items())
    total = most if total is None else total
    weight = np.array([1.0 if str(c[0]) in live else 0.0 for c in cells])
    pool = (tokens * weight).sum()
    aims = [np.bincount(d[1], tokens * weight, len(d[0])) / pool * total for d in dims[1:]]
    for _ in range(rounds):
        before = weight.copy()
        for (_, own), aim in zip(dims[1:], aims):
            now = np.bincount(own, tokens * weight, len(aim))
            weight = weight * np.divide(aim, now, out=np.ones_like(aim), where=now > 0)[own]
        for i, s in enumerate(sources):
            own = dims[0][1] == i
            if s in live:
                weight[own] = _fill(weight[own], tokens[own], live[s][1], live[s][0] / share * total)
        if np.abs(weight - before).max() < 1e-9:
            break
    return weight, total


def mix(sizes: DataFrame, targets: DataFrame, key: str, source: str, lang: str, total: float | None = None) -> DataFrame:
    """``key, source, lang, topic, n_tokens, repeats`` of the records in the mix.

    ``sizes`` is a result of :func:`assigned`, materialized; ``targets`` has
    ``source, target_share, max_repeats``. A record in a cell of weight w is
    used floor(w) times, and once more with the probability of the rest: ranks
    u / p with u from a hash of the key, taken in order until the source's
    tokens are reached. A record that no longer fits what is left is passed
    over, and the next pass looks for smaller ones, until none fits, so that each
    source ends below its target by less than the smallest record left.

    A source's records are never sorted in one task: ranks are counted in steps
    and only the step where the target lies is ordered. Records of a null or
    untargeted source, or without tokens, are not used; null languages form one
    marginal. Repeated keys count as records of their own. If a target source
    has no tokens, the others share the mix.
    """
    aims = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source IS NOT NULL").collect()}
    named = sizes.select(F.col(key).alias("k"), F.col(source).alias("s"), F.coalesce(F.lower(lang), F.lit("-")).alias("l"), "topic", "n_tokens").where("s IS NOT NULL AND n_tokens > 0")
    named = named.join(F.broadcast(targets.select(F.col("source").alias("s")).distinct()), "s", "left_semi")
    cells = [tuple(r) for r in named.groupBy("s", "l", "topic").agg(F.sum("n_tokens")).collect()]
    weight, whole = rake(cells, aims, total)
    spark = sizes.sparkSession
    table = [(s, l, t, int(np.floor(w + 1e-9)), float(max(0.0, w - np.floor(w + 1e-9)))) for (s, l, t, _), w in zip(cells, weight)]
    plan = spark.createDataFrame(table, "s string, l string, topic int, base int, p double")
    u = (F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    ranked = materialize(named.join(plan, ["s", "l", "topic"]).withColumn("rank", F.when(F.col("p") > 1e-9, F.least(u / F.col("p"), F.lit(RANK_MAX)))))
    share = sum(aims[s][0] for s in {c[0] for c in cells}) or 1.0
    used = {r["s"]: r["t"] for r in ranked.groupBy("s").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("t")).collect()}
    left = {s: aims[s][0] / share * whole - t for s, t in used.items()}
    chosen = ranked.where("base > 0").select("k", "s", "l", "topic", "n_tokens", F.col("base").alias("repeats"))
    open_ = ranked.where("rank IS NOT NULL")
    step = F.least(F.floor(F.col("rank") * (STEPS / RANK_MAX)), F.lit(STEPS - 1)).cast("int")
    while True:
        room = spark.createDataFrame([(s, float(v)) for s, v in left.items()], "s string, room double")
        fits = open_.join(F.broadcast(room), "s").where(F.col("n_tokens") <= F.col("room")).withColumn("step", step)
        counted = fits.groupBy("s", "step").agg(F.sum("n_tokens").alias("t")).collect()
        by: dict[str, dict[int, int]] = {}
        for r in counted:
            by.setdefault(r["s"], {})[r["step"]] = r["t"]
        edge = []
        for s, steps in by.items():
            gone = 0
            for i in sorted(steps):
                if gone + steps[i] > left[s]:
                    break
                gone += steps[i]
            else:
                i = STEPS
            edge.append((s, i, float(left[s] - gone)))
        if not edge:
            break
        at = fits.join(F.broadcast(spark.createDataFrame(edge, "s string, edge int, rest double")), "s")
        run = Window.partitionBy("s").orderBy("rank", "k")
        inner = at.where("step = edge").withColumn("sum", F.sum("n_tokens").over(run)).where("sum <= rest")
        new = materialize(at.where("step < edge").select("k", "s", "l", "topic", "n_tokens").unionByName(inner.select("k", "s", "l", "topic", "n_tokens")))
        gained = {r["s"]: r["t"] for r in new.groupBy("s").agg(F.sum("n_tokens").alias("t")).collect()}
        if not gained:
            break
        left = {s: v - gained.get(s, 0) for s, v in left.items()}
        chosen = chosen.unionByName(new.withColumn("repeats", F.lit(1)))
        open_ = open_.join(new.select("k"), "k", "left_anti")
    out = chosen.groupBy("k", "s", "l", "topic").agg(F.max("n_tokens").alias("n_tokens"), F.sum("repeats").cast("int").alias("repeats"))
    return out.select(F.col("k").alias(key), F.col("s").alias(source), F.col("l").alias(lang), "topic", "n_tokens", "repeats")


def marginals(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, source: str, lang: str) -> DataFrame:
    """``dimension, value, target_share, actual_share``: the shares of tokens the mix was
    raked to, and those it has, by source, language and topic.

    Source targets are those given, scaled to the sources that have tokens;
    languages and topics have the shares of the targeted sources' tokens.
    """
    live = targets.where("source IS NOT NULL AND target_share > 0").select(F.col("source").alias("s"), "target_share").distinct()
    pool = sizes.select(F.col(source).alias("s"), F.coalesce(F.lower(lang), F.lit("-")).alias("l"), F.col("topic").cast("string").alias("t"), "n_tokens").where("n_tokens > 0").join(live, "s")
    has = pool.select("s", "target_share").distinct()
    aims = [has.select(F.lit("source").alias("dimension"), F.col("s").alias("value"), F.col("target_share").alias("x"))]
    aims += [pool.groupBy(F.lit(name).alias("dimension"), F.col(c).alias("value")).agg(F.sum("n_tokens").cast("double").alias("x")) for name, c in (("lang", "l"), ("topic", "t"))]
    own = mixed.select(F.col(source).alias("s"), F.col(lang).alias("l"), F.col("topic").cast("string").alias("t"), (F.col("n_tokens") * F.col("repeats")).alias("n"))
    got = [own.groupBy(F.lit(name).alias("dimension"), F.col(c).alias("value")).agg(F.sum("n").cast("double").alias("y")) for name, c in (("source", "s"), ("lang", "l"), ("topic", "t"))]
    whole = Window.partitionBy("dimension")
    aim = aims[0].unionAll(aims[1]).unionAll(aims[2])
    both = aim.join(got[0].unionAll(got[1]).unionAll(got[2]), ["dimension", "value"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    return both.select("dimension", "value", F.round(F.col("x") / F.sum("x").over(whole), 6).alias("target_share"), F.round(F.col("y") / F.sum("y").over(whole), 6).alias("actual_share"))


def shares(mixed: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_records, most_repeats`` of every target source, zeros where nothing was used."""
    per = mixed.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.count(F.lit(1)).alias("n"), F.max("repeats").alias("r"))
    per = materialize(per)
    whole = per.agg(F.sum("t")).first()[0] or 1
    joined = targets.select("source", "target_share").join(per, "source", "left")
    share = F.coalesce(F.col("t") / F.lit(whole), F.lit(0.0))
    return joined.select("source", "target_share", F.round(share, 6).alias("actual_share"), F.coalesce("t", F.lit(0)).alias("n_tokens"), F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("r", F.lit(0)).alias("most_repeats"))
