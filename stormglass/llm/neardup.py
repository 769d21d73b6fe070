"""Near-duplicate records with small edits, by banded signatures and sequential Bayesian verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.runtime import materialize

from .classes import classes

BLOCK = 256  #: a run of records under one band key is compared in blocks of this many
CHUNK = 1 << 16
MEMBERS = 1024  #: records of one class that meet in one task when its pairs are written out


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array of hash lists without nulls; 32-bit hashes are spread over 64 bits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    if values.dtype == np.int32:
        values = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return values.view(np.uint64), offsets - offsets[0]


def minhashes(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One row per hash function, one column per non-empty set."""
    out = np.empty((len(a), len(offsets) - 1), np.uint32)
    short, a, c = (values >> np.uint64(32)).astype(np.uint32), (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (c >> np.uint64(31)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(len(a)):
            out[i] = np.minimum.reduceat((short ^ c[i]) * a[i], offsets[:-1])
    return out


def _numbered(base: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with the number of their first set. The sets of a partition come sorted, so a partition that is computed again gets the same numbers."""
    at = base.get(TaskContext.get().partitionId(), 0)
    for batch in batches:
        yield at, batch
        at += batch.num_rows


def _bands(bands: int, rows: int, split: int, seed: int, base: dict[int, int]):
    """Sets in; per bucket (a band and a part of its keys) the sets' band keys out, in order of the sets' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = _constants(bands * rows, seed)
        mix, _ = _constants(rows, seed + 1)
        for start, batch in _numbered(base, batches):
            if not batch.num_rows:
                continue
            sig = minhashes(*_flat(batch.column(1)), a, c).astype(np.uint64).reshape(bands, rows, -1)
            bucket, keys, places = [], [], []
            with np.errstate(over="ignore"):
                for b in range(bands):
                    key = (sig[b] * mix[:, None]).sum(axis=0, dtype=np.uint64)
                    key = (key ^ (key >> np.uint64(29))) * mix[0]
                    part, key = (key % np.uint64(split)).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32)
                    order = np.argsort(part, kind="stable")
                    edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
                    for i, j in zip(edge, edge[1:]):
                        at = order[i:j]
                        bucket.append(b * split + int(part[at[0]]))
                        keys.append(key[at].tobytes())
                        places.append(at.astype(np.uint32).tobytes() if split > 1 else b"")
            first = pa.array(np.full(len(bucket), start, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), first, pa.array(keys, pa.binary()), pa.array(places, pa.binary())], names=["bucket", "start", "keys", "places"])

    return run


def _runs(key: np.ndarray, record: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Record pairs that share a band key, as two arrays; the flag says that every one of the first meets every one of the second."""
    order = np.argsort(key, kind="stable")
    key, record = key[order], record[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[edge, len(key)])
    place = np.arange(len(key)) - np.repeat(edge, length)
    small = np.repeat(length <= BLOCK, length)
    left, right = [], []
    for step in range(1, int(min(BLOCK, length.max()))):
        at = np.flatnonzero((place >= step) & small)
        if not len(at):
            break
        left.append(record[at - step])
        right.append(record[at])
    if left:
        l, r = np.concatenate(left), np.concatenate(right)
        for i in range(0, len(l), CHUNK):
            yield l[i : i + CHUNK], r[i : i + CHUNK], False
    for start, n in zip(edge[length > BLOCK], length[length > BLOCK]):
        own = [record[start + i : start + min(i + BLOCK, n)] for i in range(0, n, BLOCK)]
        for i, x in enumerate(own):
            for y in own[i:]:
                yield x, y, True


def _candidates(kind: type, width: int):
    """Band keys sorted by bucket in; blocks of candidate pairs out.

    Pairs of short runs are routed by their smaller record, so that a pair found
    in several bands meets itself in one task; blocks of long runs go anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            key, record = (np.concatenate(x) for x in zip(*parts))
            rows: list[tuple[int, bytes, bytes, bool]] = []
            for left, right, every in _runs(key, record):
                if every:
                    rows.append((-1 - int(left[0] ^ right[0]), left.tobytes(), right.tobytes(), True))
                    continue
                a, b = np.minimum(left, right), np.maximum(left, right)
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                route = a // width
                edge = np.flatnonzero(np.r_[True, route[1:] != route[:-1], True])
                rows += [(int(route[i]), a[i:j].tobytes(), b[i:j].tobytes(), False) for i, j in zip(edge, edge[1:])]
                if len(rows) > 10_000:
                    yield take(rows)
                    rows = []
            if rows:
                yield take(rows)

        def take(rows: list[tuple[int, bytes, bytes, bool]]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["route", "l", "r", "every"])

        now, parts = None, []
        for batch in batches:
            for bucket, start, keys, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now and parts:
                    yield from out(parts)
                    parts = []
                now, key = bucket, np.frombuffer(keys, np.uint32)
                place = np.frombuffer(places, np.uint32) if places else np.arange(len(key))
                parts.append((key, (place.astype(np.int64) + start).astype(kind)))
        if parts:
            yield from out(parts)

    return run


def _expand(kind: type):
    """Blocks sorted by route in; pairs out, each once per route."""

    def different(l: list[np.ndarray], r: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(l), np.concatenate(r)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, l, r, n = None, [], [], 0
        for batch in batches:
            for route, left, right, every in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(left, kind).astype(np.int64), np.frombuffer(right, kind).astype(np.int64)
                if every:
                    x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                    x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
                if l and (route != now and n > CHUNK or n > 16 * CHUNK):
                    yield different(l, r)
                    l, r, n = [], [], 0
                now, n = route, n + len(x)
                l.append(x)
                r.append(y)
        if l:
            yield different(l, r)

    return run


def _names(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, batch in _numbered(base, batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + batch.num_rows)), batch.column(0)], names=["number", "cls"])

    return run


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among ``n`` hashes at which a pair stays.

    With a uniform prior the posterior of the similarity after m matches of n
    is Beta(m + 1, n - m + 1); its mass above the threshold is
    P(Binomial(n + 1, threshold) <= m). Below ``miss`` the pair is dropped.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _verify(threshold: float, hashes: int, batch_size: int, miss: float, seed: int, cut: bool):
    """Pairs with both sets in; those at or above the threshold out, with their similarity and whether it is beyond doubt."""

    def overlap(lv: np.ndarray, lo: np.ndarray, rv: np.ndarray, ro: np.ndarray) -> np.ndarray:
        n = len(lo) - 1
        both = np.concatenate([lv, rv])
        pair = np.concatenate([np.repeat(np.arange(n), np.diff(lo)), np.repeat(np.arange(n), np.diff(ro))])
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        return np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=n)

    def take(values: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(offsets)
        return values[np.repeat(keep, size)], np.r_[0, np.cumsum(size[keep])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = _constants(hashes, seed + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            (lv, lo), (rv, ro) = _flat(batch.column(2)), _flat(batch.column(3))
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n, m = np.diff(lo), np.diff(ro)
            alive, same = np.minimum(n, m) >= threshold * np.maximum(n, m), np.zeros(len(x), int)
            for done in range(0, hashes + 1, batch_size):
                if done:
                    alive = same >= least_matches(done, threshold, miss)
                (lv, lo), (rv, ro), x, y, same = take(lv, lo, alive), take(rv, ro, alive), x[alive], y[alive], same[alive]
                if done >= hashes or not len(x):
                    break
                part = slice(done, done + batch_size)
                same = same + (minhashes(lv, lo, a[part], c[part]) == minhashes(rv, ro, a[part], c[part])).sum(axis=0)
            if not len(x):
                continue
            shared = overlap(lv, lo, rv, ro)
            near = shared / (np.diff(lo) + np.diff(ro) - shared)
            # Hashes cut to 31 bits may share a few elements too many or too few: what is near the threshold is looked at again.
            size = np.diff(lo) + np.diff(ro)
            surely, maybe = (shared - 2) / (size - shared + 2), (shared + 2) / np.maximum(1, size - shared - 2)
            good = maybe >= threshold if cut else near >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good]), pa.array(near[good]), pa.array((surely >= threshold)[good])], names=["cls_a", "cls_b", "similarity", "sure"])

    return run


def similar_classes(whole: DataFrame, named: DataFrame | None = None, threshold: float = 0.8, bands: int = 20, rows: int = 5, hashes: int = 128, batch_size: int = 32, miss: float = 1e-4, seed: int = 7, bucket_rows: int = 1_000_000, task_keys: int = 2_000_000) -> DataFrame:
    """``cls_a, cls_b, similarity`` of all pairs of different sets (see
    :func:`stormglass.llm.classes.classes`) found by the bands and at or above
    the threshold; cls_a < cls_b.

    A pair of similarity s becomes a candidate with probability
    1 - (1 - s ** rows) ** bands. Candidates compare signature batches of hash
    functions of their own; a pair is dropped once the posterior probability
    that it reaches the threshold falls below ``miss``, and what is left is
    verified on the whole sets. If ``named`` is given, ``whole`` holds hashes cut
    to 31 bits, and pairs close to the threshold are verified once more on the
    whole hashes of ``named``. No bucket or number of partners is capped: a band
    key shared by many sets is divided into blocks that other tasks compare.
    Buckets and tasks grow in number with the sets, not in size.
    """
    spark = whole.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = whole.where(F.size("tokens") > 0).select("cls", "tokens").sortWithinPartitions("cls")
    size = dict(sets.groupBy(F.spark_partition_id().alias("p")).count().collect())
    total, base, before = sum(size.values()), {}, 0
    for p in sorted(size):
        base[p], before = before, before + size[p]
    kind, split = np.uint32 if total < 2**32 else np.uint64, max(1, math.ceil(total / bucket_rows))
    tasks = max(parts, math.ceil(total * bands / task_keys))
    width = max(1, total // (4 * tasks))
    keys = sets.mapInArrow(_bands(bands, rows, split, seed, base), "bucket bigint, start bigint, keys binary, places binary")
    blocks = keys.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(kind, width), "route bigint, l binary, r binary, every boolean")
    pairs = blocks.repartition(tasks, "route").sortWithinPartitions("route").mapInArrow(_expand(kind), "a bigint, b bigint").distinct()
    names = sets.mapInArrow(_names(base), "number bigint, cls bigint")
    a = pairs.join(names.withColumnsRenamed({"number": "a", "cls": "x"}), "a")
    b = a.join(names.withColumnsRenamed({"number": "b", "cls": "y"}), "b").select("x", "y")
    tokens = whole.select("cls", "tokens")
    one = b.join(tokens.withColumnsRenamed({"cls": "x", "tokens": "s"}), "x")
    two = one.join(tokens.withColumnsRenamed({"cls": "y", "tokens": "t"}), "y").select("x", "y", "s", "t")
    found = two.mapInArrow(_verify(threshold, hashes, batch_size, miss, seed, named is not None), "cls_a bigint, cls_b bigint, similarity double, sure boolean")
    found = found.select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b"), "similarity", "sure")
    if named is None:
        return found.drop("sure")
    found = materialize(found)
    rep = whole.select("cls", "rep")
    open_ = found.where(~F.col("sure")).select("cls_a", "cls_b")
    ends = open_.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct().join(rep, "cls").withColumnRenamed("rep", "key")
    full = materialize(ends.join(named.select("key", "tokens"), "key").select("cls", "tokens"))
    both = open_.join(full.withColumnsRenamed({"cls": "cls_a", "tokens": "s"}), "cls_a").join(full.withColumnsRenamed({"cls": "cls_b", "tokens": "t"}), "cls_b")
    shared = F.size(F.array_intersect("s", "t"))
    exact = both.select("cls_a", "cls_b", (shared / (F.size("s") + F.size("t") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    return found.where("sure").drop("sure").unionByName(exact)


def near_duplicates(records: DataFrame, key: str, tokens: str, threshold: float = 0.8, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between different sets, the classes, and each record's class.

    ``records`` holds unique keys and, in ``tokens``, sorted 64-bit hashes of the
    different shingles (:func:`stormglass.llm.classes.shingle_set`). Null or
    empty sets are similar to nothing and only appear among the members; records
    with equal sets form one class and are not compared again. Other columns are
    ignored; an empty table gives three empty results.
    """
    named = records.select(F.col(key).alias("key"), F.coalesce(F.col(tokens), F.array().cast("array<bigint>")).alias("tokens"))
    whole, members = classes(named, "key", "tokens", cut=True)
    return similar_classes(whole, members, threshold, **how), whole, members


def all_pairs(links: DataFrame, whole: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b`` with a < b: every pair of keys of linked classes or of one class.

    A class of many records is divided into blocks by a hash of the key, and two
    blocks meet under a key of their own, so no task holds a whole class.
    """
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    sized = whole.select("cls", blocks.alias("blocks"), "n")
    m = members.select("cls", "key").join(sized.where("n > 1"), "cls", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.lit(0))).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    far = links.select("cls_a", "cls_b").join(sized.select(F.col("cls").alias("cls_a"), F.col("blocks").alias("x")), "cls_a").join(sized.select(F.col("cls").alias("cls_b"), F.col("blocks").alias("y")), "cls_b")
    far = far.select("cls_a", "cls_b", F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("i"), "y").select("cls_a", "cls_b", "i", F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j"))
    far = far.join(m.select(F.col("cls").alias("cls_a"), F.col("block").alias("i"), F.col("key").alias("p")), ["cls_a", "i"]).join(m.select(F.col("cls").alias("cls_b"), F.col("block").alias("j"), F.col("key").alias("q")), ["cls_b", "j"]).select("p", "q")
    own = m.where("n > 1")
    left = own.select("cls", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.col("key").alias("p"))
    right = own.select("cls", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("key").alias("q"))
    near = left.join(right, ["cls", "i", "j"]).where("i < j OR p < q").select("p", "q")
    return far.unionByName(near).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def components(links: DataFrame, members: DataFrame, rounds: int = 60) -> DataFrame:
    """``key, group``: the records of linked classes under one number, the smallest class of the group.

    Smallest numbers travel along the links and then take the number of their
    number, until nothing changes; each round is one join, written to the shared
    folder. A group that is not settled after ``rounds`` raises an error.
    """
    both = links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).unionAll(links.select(F.col("cls_b").alias("a"), F.col("cls_a").alias("b")))
    both = materialize(both)
    now = materialize(both.select(F.col("a").alias("cls"), F.col("a").alias("group")).distinct())
    for _ in range(rounds):
        near = both.join(now.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("group").alias("other"))
        less = now.join(near, "cls").select("cls", F.least("group", "other").alias("group"))
        jump = less.join(less.select(F.col("cls").alias("group"), F.col("group").alias("next")), "group").select("cls", F.least("group", "next").alias("group"))
        new = materialize(jump)
        moved = new.join(now.withColumnRenamed("group", "old"), "cls").where("group <> old").limit(1).count()
        now = new
        if not moved:
            return members.join(now, "cls", "left").select("key", F.coalesce("group", "cls").alias("group"))
    raise RuntimeError("groups not settled")
