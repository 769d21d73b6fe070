"""Exactly one copy of each message of an at-least-once stream.

A keyed state store holds the identifiers seen within a horizon of event time;
it is checkpointed together with the output. What may be older than the store
remembers is set aside and decided by a lookup in the output's history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stormglass.runtime import scratch_dir

NONE = -(2**63)
OUT = "kind string, key bigint, ord bigint"
STATE = "keys binary, ords binary, seen binary"
PER_BUCKET = 50_000  #: identifiers a bucket should hold: about 1 MB
PASS = 64  #: extra buckets for rows already known to be copies


def _combine(buckets: int):
    """Within one batch of rows only the earliest copy of a key can be new; the
    others skip the store, spread over buckets without state, so a key with any
    share of the rows sends one row per batch to its own bucket.

    The watermark goes on by a row of its own for a bucket without state. Spark
    drops rows whose ``mark`` is older than the watermark, so the messages have
    none: one delivered long after others of its time is late, not lost."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.sort_values(["key", "ord"], kind="stable")
            copy = p["key"].duplicated().to_numpy()
            keys, ords = p["key"].to_numpy(np.int64), p["ord"].to_numpy(np.int64)
            with np.errstate(over="ignore"):
                own = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
            p["bucket"] = np.where(copy, buckets + ords % PASS, own.astype(np.int64)).astype(np.int32)
            p["mark"] = pd.Series(pd.NaT, p.index, "datetime64[ns]")
            yield p[["bucket", "key", "ord", "event_ms", "at", "mark"]]
            if len(p):
                yield pd.DataFrame({"bucket": np.array([buckets + PASS], np.int32), "key": 0, "ord": 0, "event_ms": NONE, "at": 0, "mark": pd.to_datetime([p["at"].max()], unit="ms")})

    return run


def _rows(kind: str, keys: np.ndarray, ords: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(keys), kind, object), "key": keys, "ord": ords})


def _seen(buckets: int):
    """State of one bucket, which ends by a timer also if no row comes: sorted keys with their earliest order and last sighting.

    Rows of keys in it are copies, unless their order is smaller, which
    supersedes the copy kept so far. Of the others a row is first if all earlier
    copies would still be in the store, that is if its message is not older than
    the watermark; else it is late, for the lookup. So what is in the store stays
    until the watermark has passed its message's own time, too.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] == buckets + PASS:
            return
        if key[0] >= buckets:
            for p in parts:
                yield _rows("copy", p["key"].to_numpy(), p["ord"].to_numpy())
            return
        if state.hasTimedOut:
            # The watermark has passed the oldest entries of a bucket no row came for.
            keys, ords, seen = (np.frombuffer(b, np.int64) for b in state.get)
            _keep(state, keys, ords, seen, state.getCurrentWatermarkMs())
            return
        if state.exists:
            keys, ords, seen = (np.frombuffer(b, np.int64) for b in state.get)
        else:
            keys = ords = seen = np.empty(0, np.int64)
        mark = state.getCurrentWatermarkMs()
        alive = seen >= mark
        keys, ords, seen = keys[alive], ords[alive], seen[alive]
        for p in parts:
            p = p.sort_values(["key", "ord"], kind="stable")
            k, o = p["key"].to_numpy(np.int64), p["ord"].to_numpy(np.int64)
            event = p["event_ms"].to_numpy(np.int64)
            at = np.maximum(p["at"].to_numpy(np.int64), event)
            lead = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
            last = np.maximum.reduceat(at, np.flatnonzero(lead)) if len(k) else at
            yield _rows("copy", k[~lead], o[~lead])
            k, o, event = k[lead], o[lead], event[lead]
            where = np.searchsorted(keys, k)
            known = np.zeros(len(k), bool)
            inside = where < len(keys)
            known[inside] = keys[where[inside]] == k[inside]
            slot = where[known]
            ords, seen = ords.copy(), seen.copy()
            less = o[known] < ords[slot]
            yield _rows("superseded", k[known][less], ords[slot[less]])
            yield _rows("first", k[known][less], o[known][less])
            yield _rows("copy", k[known][~less], o[known][~less])
            ords[slot] = np.minimum(ords[slot], o[known])
            seen[slot] = np.maximum(seen[slot], last[known])
            new, late = ~known, ~known & (event < mark)
            yield _rows("late", k[late], o[late])
            yield _rows("first", k[new & ~late], o[new & ~late])
            keys, ords, seen = np.r_[keys, k[new]], np.r_[ords, o[new]], np.r_[seen, last[new]]
            order = np.argsort(keys, kind="stable")
            keys, ords, seen = keys[order], ords[order], seen[order]
        _keep(state, keys, ords, seen, mark)

    return run


def _keep(state: GroupState, keys: np.ndarray, ords: np.ndarray, seen: np.ndarray, mark: int) -> None:
    """Stores what is not older than the watermark, and asks to be called when it has passed the oldest of that."""
    alive = seen >= mark
    if not alive.any():
        if state.exists:
            state.remove()
        return
    state.update((keys[alive].tobytes(), ords[alive].tobytes(), seen[alive].tobytes()))
    state.setTimeoutTimestamp(max(int(seen[alive].min()), mark) + 1)


def first_copies(stream: DataFrame, key: str, order: str, arrived: str, event: Column, horizon: str = "1 day", buckets: int = 256) -> DataFrame:
    """A stream of ``kind, key, ord`` for the messages of ``stream``.

    ``key`` identifies a message, ``order`` (bigint, unique) says which copy
    came first, ``arrived`` is the time of delivery that drives the watermark,
    ``event`` the message's own time, null where unknown. Kinds: first (the copy
    to keep), copy, superseded (kept at first, then an earlier copy came), late
    (for :func:`settle`). Rows without key or order are left out, but none for coming late.
    """
    ms = F.coalesce(F.unix_millis(event.cast("timestamp")), F.lit(NONE))
    slim = stream.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("ord"), ms.alias("event_ms"), F.coalesce(F.unix_millis(F.col(arrived).cast("timestamp")), F.lit(0)).alias("at")
    )
    parts = slim.mapInPandas(_combine(buckets), "bucket int, key bigint, ord bigint, event_ms bigint, at bigint, mark timestamp")
    timed = parts.withWatermark("mark", horizon)
    return timed.groupBy("bucket").applyInPandasWithState(_seen(buckets), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settle(history: DataFrame) -> DataFrame:
    """``key, ord`` of all copies, from the whole output of :func:`first_copies`.

    A late row, and what was taken as first under its key, is a copy if the
    history holds a smaller order; only late keys are looked up.
    """
    late = history.where("kind = 'late'").select("key", "ord")
    kept = history.where("kind = 'first'").select("key", "ord")
    open_ = late.unionAll(kept.join(late.select("key").distinct(), "key", "left_semi"))
    least = open_.groupBy("key").agg(F.min("ord").alias("least"))
    found = open_.join(least, "key").where("ord > least").select("key", "ord")
    # Only what was superseded can also be late or first; the rest is unique as it is.
    doubtful = history.where("kind = 'superseded'").select("key", "ord").unionAll(found).distinct()
    return history.where("kind = 'copy'").select("key", "ord").unionAll(doubtful)


def copies(stream: DataFrame, key: str, order: str, arrived: str, event: Column, horizon: str = "1 day", buckets: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs :func:`first_copies` over what is available and returns all copies
    (``key, ord``): every row whose key has a row of smaller order.

    State, progress and output are committed together under ``checkpoint``
    (default: a new folder below the shared one); called again with the same
    folder it goes on where it ended. Ties cannot occur: ``order`` is unique.
    An empty stream gives an empty result. A bucket's state is read and written as
    a whole in each batch that has rows for it, so ``buckets`` should be what the
    store remembers by :data:`PER_BUCKET`; a checkpoint keeps the number it began
    with.
    """
    buckets = buckets or 256
    spark = stream.sparkSession
    base = checkpoint or scratch_dir(spark)
    out = first_copies(stream, key, order, arrived, event, horizon, buckets)
    run = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return settle(spark.read.schema(OUT).parquet(f"{base}/out"))
