"""All similar pairs between set-valued records, by prefixes of adaptive length."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.runtime import materialize

from .classes import classes
from .neardup import _constants, _flat

SLOTS = 1 << 20  #: slots of the frequency table, whatever the number of tokens: at most 8 MB
BITS = (24, 28)  #: the signature filter has 2 MB at least and 32 MB at most
LEVELS = (1, 2, 3)
COMBINATIONS = 20_000  #: a set sends so many combinations at a level above 1, or does not use the level


def _frequencies(sets: list[DataFrame]) -> np.ndarray:
    """How many sets hold a token of each slot. Only the order of tokens rests on it, so shared slots cost speed, never a result."""
    slot = F.explode(F.transform("tokens", lambda t: t.bitwiseAND(F.lit(SLOTS - 1)))).alias("slot")
    rows = [s.select(slot) for s in sets]
    whole = rows[0] if len(rows) == 1 else rows[0].unionAll(rows[1])
    found = whole.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return table


def _level_bounds(threshold: float, levels):
    """A function of sizes: the highest level whose combinations a set of that size sends. It falls with the size."""
    ends = []
    for level in levels[1:]:
        n = level
        while math.comb(n - math.ceil(threshold * n - 1e-9) + level, level) <= COMBINATIONS:
            n += 1
        ends.append(n)
    ends = np.minimum.accumulate(np.array(ends, np.int64))
    return lambda size: levels[0] + sum((size < end).astype(np.int64) for end in ends)


def _signatures(threshold: float, table, n_sets: int, levels, adaptive: bool, filters, bits: int = 24):
    """Sets in; ``sig, cls, size`` out: every combination of ``level`` tokens of the set's prefix for that level.

    Two sets of similarity t share at least ceil(t * n) tokens, n the size of
    either; in a common order of tokens they then share at least ``level`` within
    their first n - ceil(t * n) + level tokens. Long sets would send too many
    combinations at the higher levels: a set chooses a level only if the largest
    set it can pair with sends it, and sends those its own size allows; level 1,
    whose combinations are as many as tokens, is open to all.
    """
    bound = _level_bounds(threshold, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = table.value
        allowed, shift = (filters.value if filters is not None else None), np.uint64(64 - bits)
        mix, _ = _constants(max(LEVELS) + 1, 11)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _flat(batch.column(1))
            cls = batch.column(0).to_numpy()
            size = np.diff(offsets)
            weight = freq[(values & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((values, weight, np.repeat(np.arange(len(size)), size)))
            values, weight = values[order], weight[order]
            need = np.ceil(threshold * size - 1e-9).astype(np.int64)
            chosen = np.full(len(size), levels[0])
            if adaptive:
                most = bound(np.ceil(size / threshold + 1e-9).astype(np.int64))
                cost = np.stack([np.where(most >= k, _cost(weight, offsets, size, need, k, n_sets, most >= k), np.inf) for k in levels])
                chosen = np.array(levels)[cost.argmin(axis=0)]
            else:
                most = bound(size)
            sigs, owners = [], []
            for level in levels:
                prefix = np.minimum(size, size - need + level)
                use = (chosen == level) & (need >= level) if adaptive else (size >= level) & (most >= level)
                for p in np.unique(prefix[use]):
                    own = np.flatnonzero(use & (prefix == p))
                    block = values[offsets[own][:, None] + np.arange(p)]
                    combos = np.array(list(combinations(range(int(p)), level)))
                    at_once = max(1, 2_000_000 // len(combos))
                    for i in range(0, len(own), at_once):
                        part = block[i : i + at_once]
                        with np.errstate(over="ignore"):
                            sig = np.full((len(part), len(combos)), level, np.uint64) * mix[level]
                            for j in range(level):
                                sig = (sig ^ part[:, combos[:, j]]) * mix[j]
                                sig ^= sig >> np.uint64(31)
                        owner = np.repeat(cls[own[i : i + len(part)]], len(combos))
                        sig = sig.ravel()
                        if allowed is not None:
                            at = (sig >> shift).astype(np.int64)
                            keep = allowed[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                            sig, owner = sig[keep], owner[keep]
                        sigs.append(sig)
                        owners.append(owner)
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "cls"])

    return run


def _filter(signatures: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the signatures' leading ``bits``. Its blocks of 8 KB are filled by the tasks, so only the bitmap reaches the driver."""

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        block = np.zeros(1 << 16, np.uint8)
        block[group.column("bit").to_numpy()] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})

    at = F.shiftrightunsigned("sig", 64 - bits)
    rows = signatures.select(F.shiftright(at, 16).cast("int").alias("block"), at.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.groupBy("block").applyInArrow(fill, "block int, bytes binary").collect():
        out[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bytes"], np.uint8)
    return out


def _cost(weight: np.ndarray, offsets: np.ndarray, size: np.ndarray, need: np.ndarray, level: int, n_sets: int, use: np.ndarray) -> np.ndarray:
    """Expected candidates of each set at a level, plus its signatures.

    The sum over all combinations of ``level`` shares is the elementary symmetric
    polynomial of the tokens' shares; tokens are taken as independent but for a
    factor, since words of one subject come together.
    """
    out = np.full(len(size), np.inf)
    share = weight / max(1, n_sets)
    prefix = np.minimum(size, size - need + level)
    for p in np.unique(prefix):
        own = np.flatnonzero((prefix == p) & (need >= level) & use)
        if not len(own):
            continue
        block = share[offsets[own][:, None] + np.arange(p)]
        poly = [np.ones(len(own))] + [np.zeros(len(own)) for _ in range(level)]
        for j in range(int(p)):
            for k in range(level, 0, -1):
                poly[k] = poly[k] + poly[k - 1] * block[:, j]
        out[own] = poly[level] * n_sets * 4 ** (level - 1) + math.comb(int(p), level)
    return out


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``cls_a, cls_b, similarity`` between the classes of two tables (or of one
    with itself: pass it twice), all pairs whose Jaccard similarity is at least
    ``threshold``; exact.

    The sets of ``left`` choose the length of their prefix, that is how many
    shared tokens a pair must have in it, by the candidates they would have;
    those of ``right`` send the combinations for every length a set of ``left``
    may have chosen. A filter sized by the signatures of ``left`` (2 to 32 MB)
    drops those of ``right`` that none of them equals. Let ``left`` be the
    smaller table.
    """
    spark = left.sparkSession
    one, two = left.where(F.size("tokens") > 0).select("cls", "tokens"), right.where(F.size("tokens") > 0).select("cls", "tokens")
    same = left is right
    table = _frequencies([one] if same else [one, two])
    n_sets = two.count()
    freq = spark.sparkContext.broadcast(table)
    schema = "sig bigint, cls bigint"
    a = one.mapInArrow(_signatures(threshold, freq, n_sets, LEVELS, True, None), schema)
    filters, bits = None, BITS[0]
    if not same:
        a = materialize(a)
        bits = min(BITS[1], max(BITS[0], (32 * a.count()).bit_length()))
        filters = spark.sparkContext.broadcast(_filter(a, bits))
    b = two.mapInArrow(_signatures(threshold, freq, n_sets, LEVELS, False, filters, bits), schema)
    met = a.withColumnRenamed("cls", "x").join(b.withColumnRenamed("cls", "y"), "sig")
    if same:
        met = met.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = met.select("x", "y").distinct()
    full = pairs.join(two.withColumnsRenamed({"cls": "y", "tokens": "t"}), "y").join(one.withColumnsRenamed({"cls": "x", "tokens": "s"}), "x")
    shared = F.size(F.array_intersect("s", "t"))
    sized = full.select(F.col("x").alias("cls_a"), F.col("y").alias("cls_b"), shared.alias("_i"), (F.size("s") + F.size("t")).alias("_n"))
    near = sized.select("cls_a", "cls_b", (F.col("_i") / (F.col("_n") - F.col("_i"))).alias("similarity"))
    return near.where(F.col("similarity") >= threshold)


def join_similar(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, threshold: float) -> DataFrame:
    """``left_key, right_key, similarity`` of all pairs between two tables.

    Both hold unique keys and, in ``tokens``, sorted hashes of the different
    values (:func:`stormglass.llm.classes.token_set`). Null and empty sets pair
    with nothing; equal sets are compared once. Other columns are ignored, also
    where their names clash.
    """
    lw, lm = classes(left.select(F.col(left_key).alias("k"), F.col(tokens).alias("tokens")).where(F.size("tokens") > 0), "k", "tokens")
    rw, rm = classes(right.select(F.col(right_key).alias("k"), F.col(tokens).alias("tokens")).where(F.size("tokens") > 0), "k", "tokens")
    near = similar_sets(lw, rw, threshold)
    a = near.join(lm.select(F.col("cls").alias("cls_a"), F.col("key").alias("_l")), "cls_a")
    b = a.join(rm.select(F.col("cls").alias("cls_b"), F.col("key").alias("_r")), "cls_b")
    out = materialize(b.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key), "similarity"))
    for kept in (lw, lm, rw, rm):
        kept.unpersist()
    return out
