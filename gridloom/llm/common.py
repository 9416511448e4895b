"""Session helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch. A batch of texts is never more than this many texts, and over so many bytes only if one text is.
BATCH_ROWS, BATCH_BYTES = 64, 1 << 20

# a running session takes no spark.checkpoint.dir
OWN_DIR = "spark.gridloom.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get, for tables with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(OWN_DIR, own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and later reads give the same rows in the same partitions."""
    df.write.option("compression", "zstd").parquet(path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(docs: DataFrame, name: str, stable: bool) -> DataFrame:
    """docs itself if the caller states that it is stable, as a selection from files that stay is: every run of its tasks sees the same rows in the same order. Else written first."""
    return docs if stable else written(docs, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
