"""Session helpers: a local session for tests and benches, and the shared scratch folder.

Intermediate tables are written to the folder that ``spark.checkpoint.dir`` names, which the driver and
every executor can reach.  A written table cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("narrascope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package where they see the driver's folders; elsewhere it is shipped with the job."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which otherwise hold up to 10,000 rows or 64 MB on either side, several at a time."""
    share_code(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; one is set only where the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="narrascope-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Written intermediate tables of one call, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        share_code(spark)
        self.spark = spark
        self.path = f"{scratch_root(spark)}/narrascope/{name}-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, self.path)

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df``, with more ``options`` of the writer, and read it back."""
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, f"{self.path}/{name}")

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, where: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, where)
    except Exception:
        return  # the session has ended; the folder's owner clears it
