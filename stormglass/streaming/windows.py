"""The stream's windows and summaries live: event-time and count triggers, eviction, output per step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stormglass.operators.steps import running_max
from stormglass.runtime import scratch_dir


def tumbling_terms(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour", start: str = "0 seconds") -> DataFrame:
    """Occurrences per term and event-time window; a window is final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, startTime=start), "term").agg(F.count(F.lit(1)).alias("n"))


def sliding_terms(stream: DataFrame, time: str, width: str = "12 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """As :func:`tumbling_terms` over windows that slide: what leaves the window is evicted with its state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), "term").agg(F.count(F.lit(1)).alias("n"))


def replay(rows: DataFrame, order: str, batches: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows``, materialized, as a stream that brings them in order of the integer column ``order``, in ``batches`` equal ranges.

    A range is appended to a folder and ``run`` is called on the stream of that
    folder, with the same checkpoint each time, before the next one comes: so a
    range is one batch. Returns what the last call returned.
    """
    spark = rows.sparkSession
    path, out = scratch_dir(spark), None
    low, high = (x or 0 for x in rows.agg(F.min(order), F.max(order)).first())
    width = (high - low) // batches + 1
    for i in range(batches):
        rows.where((F.col(order) >= low + i * width) & (F.col(order) < low + (i + 1) * width)).write.mode("append").parquet(path)
        out = run(spark.readStream.schema(rows.schema).parquet(path))
    return out


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available into a table, state and progress beside it."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def per_batch(stream: DataFrame, path: str, summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One result per step of a stream with ``step``, replaced when a later batch brings more of it.

    A batch's rows are kept by step under its number, so a batch that is run again
    writes the same files; then the steps it touches, which are few, are summarized
    from the rows of these steps alone, and only their partitions are overwritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step", "batch").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        touched = [r["step"] for r in rows.where(F.col("batch") == number).select("step").distinct().collect()]
        if touched:
            summarize(rows.where(F.col("step").isin(touched)).drop("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(f"{path}/out")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def late_rows(stream: DataFrame, path: str, order: str, ms: str, late: int) -> DataFrame:
    """``order, late_ms`` of the rows more than ``late`` ms older than the newest before them, in order of ``order``:
    what a watermark of that delay may drop.

    Each batch leaves the newest time it held under its number, so a batch that is
    run again sees the same past and writes the same files. Null times are neither
    late nor new.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        past = spark.read.schema("newest bigint, batch int").parquet(f"{path}/newest").where(F.col("batch") < number).agg(F.max("newest")).first()[0] if number else None
        rows = running_max(batch.where(F.col(ms).isNotNull()).select(order, ms), order, ms)
        before = F.greatest(F.col("before"), F.lit(past).cast("bigint"))
        found = rows.withColumn("before", before).where(F.col(ms) < F.col("before") - late).select(order, (F.col("before") - F.col(ms)).alias("late_ms"))
        found.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        batch.agg(F.max(ms).cast("bigint").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out").drop("batch")


class CountTrigger(StatefulProcessor):
    """Emits ``key, bucket, n, first_ms, last_ms`` each time ``size`` more rows of a key have come."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "bucket int, n int, first_ms bigint, last_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket, n, first, last = self.state.get() if self.state.exists() else (0, 0, None, None)
        out = []
        for p in rows:
            for ms in p["created_at_ms"].sort_values():
                first = ms if n == 0 else first
                n, last = n + 1, ms
                if n == self.size:
                    out.append((key[0], bucket, n, int(first), int(last)))
                    bucket, n = bucket + 1, 0
        self.state.update((bucket, n, int(first) if first is not None else 0, int(last) if last is not None else 0))
        if out:
            yield pd.DataFrame(out, columns=["key", "bucket", "n", "first_ms", "last_ms"])

    def close(self) -> None:
        pass


def count_trigger(stream: DataFrame, key: str, size: int) -> DataFrame:
    """A result for every ``size`` rows of a key, across batches, from keyed state."""
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(CountTrigger(size), f"key {kind}, bucket int, n int, first_ms bigint, last_ms bigint", "append", "none")
