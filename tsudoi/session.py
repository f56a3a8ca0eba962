"""Session settings the operators rely on, and the checkpoint folder."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings; each is set only where the session still has Spark's default.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", name: str = "tsudoi", memory: str = "16g") -> SparkSession:
    """A single-machine session whose small inputs still come in enough splits for its cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.files.openCostInBytes", str(256 << 10))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A single-machine session that names none gets a folder of its own;
    on a cluster a missing setting is an error, as executors couldn't share a local folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def dealt(df: DataFrame) -> DataFrame:
    """The looked-up side of a join that grows with the tables: dealt over the tasks, never sent to all by way of the driver.
    Spark judges sides before they run by the size of compressed files, far below what their rows take in memory."""
    return df.hint("shuffle_hash")


def looked_up(df: DataFrame, small: int = 50_000) -> DataFrame:
    """A written side of a join, one row a key: sent to all tasks if it was counted to have few rows, else dealt over them."""
    return F.broadcast(df) if df.limit(small + 1).count() <= small else dealt(df)
