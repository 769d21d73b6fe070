"""All core queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions.times import created
from stormglass.runtime import materialize, scratch_dir, stream_table, table
from stormglass.streaming import dedup, windows

from .registry import QUERIES, SQL, query


def buckets_for(rows: DataFrame) -> int:
    """As many buckets of state as all rows would fill: their number stands in the files' footers."""
    return max(256, rows.count() // dedup.PER_BUCKET)


@query("SELECT delivery_id, id FROM (SELECT delivery_id, id, row_number() OVER (PARTITION BY id ORDER BY delivery_id) AS rn FROM hurricane_harvey WHERE id IS NOT NULL) WHERE rn > 1")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    stream = stream_table(spark, sf, "hurricane_harvey", 2, most_batches=16)
    found = dedup.copies(stream, "id", "delivery_id", "received_at", created(F.col("created_at")), buckets=buckets_for(table(spark, sf, "hurricane_harvey")))
    return found.select(F.col("ord").alias("delivery_id"), F.col("key").alias("id"))


@query("""WITH a AS (SELECT delivery_id, id, received_at FROM hurricane_harvey), m AS (SELECT max(delivery_id) - min(delivery_id) + 1 AS n FROM a), twice AS (SELECT delivery_id, id FROM a UNION ALL SELECT delivery_id + n, id FROM a, m)
SELECT delivery_id, id FROM (SELECT delivery_id, id, row_number() OVER (PARTITION BY id ORDER BY delivery_id) AS rn FROM twice WHERE id IS NOT NULL) WHERE rn > 1""")
def p3_redelivered(spark: SparkSession, sf: str) -> DataFrame:
    """The whole stream in eight batches, and all of it once more a month later, long after the store
    has forgotten it: what it no longer remembers is found by the lookup."""
    h = table(spark, sf, "hurricane_harvey").select("delivery_id", "id", F.col("received_at").cast("timestamp").alias("received_at"), created(F.col("created_at")).alias("at"))
    low, high = h.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    again = h.select((F.col("delivery_id") + (high - low + 1)).alias("delivery_id"), "id", (F.col("received_at") + F.expr("INTERVAL 30 DAYS")).alias("received_at"), "at")
    base, n = scratch_dir(spark), buckets_for(h)
    found = windows.replay(materialize(h.unionByName(again)), "delivery_id", 16, lambda stream: dedup.copies(stream, "id", "delivery_id", "received_at", F.col("at"), buckets=n, checkpoint=base))
    return found.select(F.col("ord").alias("delivery_id"), F.col("key").alias("id"))


from . import base, models, parts, vectors  # noqa: E402, F401

__all__ = ["QUERIES", "SQL"]
