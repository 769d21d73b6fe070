"""Filling fixed-capacity containers with items, by large-item matching and best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
PER_TASK = 500_000  #: items of one size that are ordered in one task


class Plan:
    """Where the items of each size go; built from the number of items per size alone.

    Containers are numbered; all with the same content up to now are kept as
    ranges of numbers, so the plan's length depends on the capacity, not on the
    number of items. ``places`` has rows (size, first rank, first container,
    items of this size per container).
    """

    def __init__(self, counts: dict[int, int], capacity: int, first: int = 0):
        self.capacity, self.next, self.places = capacity, first, []
        self.used: dict[int, int] = {}
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        left = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self._match({s: left.pop(s) for s in [*left] if 3 * s > capacity})
        for size in sorted(left, reverse=True):
            self._best_fit(size, left[size])

    def _put(self, size: int, container: int, containers: int, each: int) -> None:
        self.places.append((size, self.used.get(size, 0), container, each))
        self.used[size] = self.used.get(size, 0) + containers * each

    def _keep(self, gap: int, container: int, containers: int) -> None:
        if gap > 0 and containers:
            if gap not in self.open:
                insort(self.gaps, gap)
            self.open.setdefault(gap, []).append((container, containers))

    def _new(self, containers: int) -> int:
        self.next += containers
        return self.next - containers

    def _match(self, left: dict[int, int]) -> None:
        """Items above a third of the capacity: the largest takes the largest other that fits beside it."""
        sizes = sorted(left)
        while sizes:
            a = sizes[-1]
            at = bisect_left(sizes, self.capacity - a + 1) - 1
            if at < 0 or sizes[at] == a and left[a] < 2:
                at -= 1 if at >= 0 else 0
            if at < 0:
                n = left.pop(sizes.pop())
                box = self._new(n)
                self._put(a, box, n, 1)
                self._keep(self.capacity - a, box, n)
                continue
            b = sizes[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            box = self._new(n)
            if a == b:
                self._put(a, box, n, 2)
            else:
                self._put(a, box, n, 1)
                self._put(b, box, n, 1)
            self._keep(self.capacity - a - b, box, n)
            for s in {a, b}:
                left[s] -= n * (2 if a == b else 1)
                if not left[s]:
                    del left[s]
                    sizes.remove(s)

    def _best_fit(self, size: int, n: int) -> None:
        while n:
            at = bisect_left(self.gaps, size)
            if at == len(self.gaps):
                each = self.capacity // size
                box, containers, gap = self._new(-(-n // each)), -(-n // each), self.capacity
            else:
                gap = self.gaps[at]
                box, containers = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
                each = gap // size
            full = min(containers, n // each)
            if full:
                self._put(size, box, full, each)
                self._keep(gap - each * size, box, full)
                n -= full * each
            if full < containers:
                if n and n < each:
                    self._put(size, box + full, 1, n)
                    self._keep(gap - n * size, box + full, 1)
                    full, n = full + 1, 0
                self._keep(gap, box + full, containers - full)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = np.array(sorted(self.places), np.int64).reshape(-1, 4)
        return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def containers(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``container_id, key, part_no, size_from, size``: every item in a container.

    ``sizes`` holds unique keys and their sizes, materialized. An item above the
    capacity, and no other, is divided: full containers of its own and the rest,
    as an item like any other. Items above a third of the capacity are matched
    in pairs, smaller ones, the largest first, go where the least room is left
    that holds them.

    The plan is made on the driver from the count of items of each size, which
    is as long as the capacity at most; the items find their container from
    their rank within their size, in parallel also where one size has many.
    Null sizes count as 0. Items of size 0 need no room and are spread over the
    containers, or share container 0 if there is none. Ties go by key.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    items = sizes.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("whole"))
    rest = items.withColumn("full", F.floor(F.col("whole") / capacity)).withColumn("size", F.col("whole") % capacity)
    counted = rest.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    n_full = sum(r["full"] for r in counted)
    plan = Plan({r["size"]: r["n"] for r in counted}, capacity, n_full)
    of, lo, box, each = plan.table()
    total = max(1, plan.next)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            at = np.searchsorted((of << 40) + lo, (s << 40) + rank, side="right") - 1
            found = box[at] + (rank - lo[at]) // each[at] if len(of) else np.zeros(len(s), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "part_no", "size_from", "size")), pa.array(found, pa.int64())], names=["k", "part_no", "size_from", "size", "container_id"])

    kind = sizes.schema[key].dataType.simpleString()
    salts = max(SALTS, -(-max((r["n"] for r in counted), default=0) // PER_TASK))
    salt = F.pmod(F.xxhash64("k"), F.lit(salts)).alias("salt")
    open_ = rest.where("size > 0").select("k", "size", "full", salt)
    offset = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = open_.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).select("size", "salt", F.coalesce(F.sum("n").over(offset), F.lit(0)).alias("before"))
    ranked = open_.withColumn("own", F.row_number().over(Window.partitionBy("size", "salt").orderBy("k")))
    ranks = ranked.join(before, ["size", "salt"]).select("k", (F.col("full") + 1).cast("int").alias("part_no"), (F.col("full") * capacity).alias("size_from"), "size", (F.col("before") + F.col("own") - 1).alias("rank"))
    placed = ranks.mapInArrow(place, f"k {kind}, part_no int, size_from bigint, size bigint, container_id bigint")
    # The full containers of divided items take the first numbers.
    big = rest.where("full > 0").withColumn("salt", salt)
    per = big.groupBy("salt").agg(F.sum("full").alias("n")).select("salt", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("salt").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    started = big.withColumn("own", F.coalesce(F.sum("full").over(inner), F.lit(0))).join(per, "salt")
    full = started.select("k", F.posexplode(F.sequence(F.lit(1), F.col("full"))).alias("i", "part_no"), (F.col("before") + F.col("own")).alias("at"))
    whole = full.select("k", F.col("part_no").cast("int").alias("part_no"), (F.col("i") * F.lit(capacity).cast("bigint")).alias("size_from"), F.lit(capacity).cast("bigint").alias("size"), (F.col("at") + F.col("i")).alias("container_id"))
    none = rest.where("whole = 0").select("k", F.lit(1).alias("part_no"), F.lit(0).cast("bigint").alias("size_from"), F.lit(0).cast("bigint").alias("size"), F.pmod(F.xxhash64("k"), F.lit(total)).alias("container_id"))
    out = placed.unionByName(whole).unionByName(none)
    return out.select("container_id", F.col("k").alias(key), "part_no", "size_from", F.col("size").alias(size))
