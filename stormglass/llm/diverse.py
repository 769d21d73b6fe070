"""Choosing a varied subset, by tournaments of rank-revealing QR."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import _flat
from .setjoin import SLOTS, _frequencies

NOMINEE = "node int, key bigint, row binary"


def _rows(values: np.ndarray, offsets: np.ndarray, freq: np.ndarray, n: int, dims: int, seed: int) -> np.ndarray:
    """Feature rows: rarity-weighted terms hashed with signs to ``dims`` columns, lengths damped.

    A term of a single record (a typo, a number) says nothing about what the
    collection holds and has no weight; one of two has half of its own.
    """
    with np.errstate(over="ignore"):
        h = (values ^ np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    count = np.maximum(1, freq[(values & np.uint64(SLOTS - 1)).astype(np.int64)])
    weight = np.log((n + 1) / count) * (1 - 1 / count) * np.where((h >> np.uint64(63)) == 0, 1.0, -1.0)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    flat = np.bincount(row * dims + ((h >> np.uint64(40)) % np.uint64(dims)).astype(np.int64), weight, (len(offsets) - 1) * dims)
    x = flat.reshape(-1, dims)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.sqrt(np.maximum(norm, 1e-9))[:, None]


def pivots(x: np.ndarray, k: int, least: float = 1e-6) -> list[int]:
    """Up to ``k`` linearly independent rows: each the one with the largest part
    outside the span of those before it; the first of equal ones."""
    x = x.copy()
    norm = (x * x).sum(axis=1)
    out: list[int] = []
    while len(out) < min(k, len(x)):
        i = int(norm.argmax())
        if norm[i] <= least:
            break
        out.append(i)
        q = x[i] / math.sqrt(norm[i])
        along = x @ q
        x -= along[:, None] * q
        norm = (x * x).sum(axis=1)
        norm[out] = 0
    return out


def _nominate(k: int, dims: int, seed: int, basis: np.ndarray, taken: frozenset, freq, n: int, keep_in: int):
    """Sets in; the rows a partition nominates out, found batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, rows = np.empty(0, np.int64), np.empty((0, dims))
        for batch in batches:
            values, offsets = _flat(batch.column(1))
            own = batch.column(0).to_numpy()
            for a in range(0, len(own), keep_in):
                cut = offsets[a : a + keep_in + 1]
                x = _rows(values[cut[0] : cut[-1]], cut - cut[0], freq.value, n, dims, seed)
                part = own[a : a + keep_in]
                if taken:
                    free = ~np.isin(part, np.fromiter(taken, np.int64))
                    x, part = x[free], part[free]
                x -= (x @ basis) @ basis.T
                both, names = np.vstack([rows, x]), np.r_[keys, part]
                best = pivots(both, k)
                keys, rows = names[best], both[best]
        if len(keys):
            node = np.full(len(keys), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys), pa.array([r.tobytes() for r in rows], pa.binary())], names=["node", "key", "row"])

    return run


def _meet(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable").reset_index(drop=True)
        x = np.stack([np.frombuffer(r) for r in group["row"]])
        return group.iloc[pivots(x, k)][["node", "key", "row"]]

    return run


def varied_subset(records: DataFrame, key: str, tokens: str, k: int, per_round: int | None = None, dims: int | None = None) -> DataFrame:
    """``rank, key`` of ``k`` records that cover the variety of all.

    ``records`` holds unique bigint keys and hashed term sets
    (:func:`stormglass.llm.classes.token_set`). In each round every partition
    nominates up to ``per_round`` linearly independent rows, tournaments of two
    in a tree pivot again, and what the winners span is deflated from all rows:
    copies and near copies of a chosen record have nothing left and cannot fill
    the subset, however many there are. Once the rows' rank is used up the
    features are drawn anew, without the chosen records, until there are ``k``.

    Rounds grow with ``k``: a round takes k / 40 records, 25 at least, and the
    features have k columns, 128 at least and 1024 at most, unless given; so the
    number of jobs stays near 40 up to k = 40,000.

    Null and empty sets have no features and are taken only after all others,
    by key; with fewer records than ``k`` all are taken. An empty table gives an
    empty result. Other columns are ignored; ties go to the smaller key.
    """
    spark = records.sparkSession
    dims = dims or min(1024, max(128, k))
    per_round = min(dims, per_round or max(25, k // 40))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = records.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(tokens), F.array().cast("array<bigint>")).alias("tokens"))
    sets = named.where(F.size("tokens") > 0).repartition(parts, "key").sortWithinPartitions("key").persist(StorageLevel.MEMORY_AND_DISK)
    n = sets.count()
    freq = spark.sparkContext.broadcast(_frequencies([sets]))
    levels = max(0, math.ceil(math.log2(parts)))
    chosen: list[int] = []
    basis, seed = np.empty((dims, 0)), 0
    while len(chosen) < min(k, n):
        want = min(per_round, k - len(chosen))
        rows = sets.mapInArrow(_nominate(want, dims, seed, basis, frozenset(chosen), freq, n, 4096), NOMINEE)
        for _ in range(levels):
            rows = rows.withColumn("node", F.shiftright("node", 1)).groupBy("node").applyInPandas(_meet(want), NOMINEE)
        best = rows.collect()
        if not best:
            if not basis.shape[1]:
                break
            basis, seed = np.empty((dims, 0)), seed + 1
            continue
        x = np.stack([np.frombuffer(r["row"]) for r in best])
        order = pivots(x, want)
        chosen += [best[i]["key"] for i in order]
        basis = np.linalg.qr(np.hstack([basis, x[order].T]))[0]
    sets.unpersist()
    if len(chosen) < k:
        rest = named.join(spark.createDataFrame([(c,) for c in chosen], "key bigint"), "key", "left_anti").orderBy("key").limit(k - len(chosen))
        chosen += [r["key"] for r in rest.select("key").collect()]
    return spark.createDataFrame(list(enumerate(chosen, 1)), f"rank int, `{key}` bigint")


def coverage(records: DataFrame, chosen: DataFrame, key: str, group: str) -> DataFrame:
    """``n_groups, n_covered, share_largest, share_largest_all``: of the values of ``group`` those the
    chosen records (``key``) hold, and the share of the most frequent value among the chosen and among all.

    Null groups are left out; without chosen records the share is null.
    """
    rows = records.where(F.col(group).isNotNull()).select(key, F.col(group).alias("_g"))
    all_ = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    own = rows.join(chosen.select(key), key, "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("m"))
    both = all_.join(own, "_g", "left")
    return both.agg(F.count(F.lit(1)).alias("n_groups"), F.count("m").alias("n_covered"), (F.max("m") / F.sum("m")).alias("share_largest"), (F.max("n") / F.sum("n")).alias("share_largest_all"))
