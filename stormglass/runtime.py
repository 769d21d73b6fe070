"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``.

    It is deleted when the application ends. Only where the session names none and all of it runs in this process (tests,
    a laptop) a temporary folder is created and set, and removed when the process ends; on a cluster that is an error,
    since the executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="stormglass-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/stormglass-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives the loss of any executor, and gives later jobs
    one fixed set of rows even where the plan before it was order-dependent.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 16, most_batches: int | None = None) -> DataFrame:
    """One of the test tables as a stream of its files, a Parquet file or folder.

    With ``most_batches`` a batch takes more than ``files_per_batch`` files where the files there are would otherwise
    make more batches than that. Each batch runs a task per shuffle partition and rewrites the state that it meets, so
    with batches of a fixed size the cost grows as the square of the table.
    """
    rows = table(spark, sf_dir, name)
    if most_batches:
        files_per_batch = max(files_per_batch, -(-len(rows.inputFiles()) // most_batches))
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")
