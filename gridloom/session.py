"""Sessions, rounding, and checkpoints in the folder that executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a running session takes no spark.checkpoint.dir
OWN_DIR = "spark.gridloom.dir"


def build(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(OWN_DIR, own)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed, as a table in the shared folder. Unlike checkpoint(), what the optimizer has derived of df's rows ends here too: in loops of self-joins that grows with every round."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def r6(x: Column | str) -> Column:
    """Six decimals, and no negative zero: what results are compared by."""
    return F.round(x, 6) + F.lit(0.0)
