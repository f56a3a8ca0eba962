"""Incremental ingest (S8): one streaming query and checkpoint per feed folder.

A trigger picks up only files not seen before. A stream hands a micro-batch over at least once: after a failure the same
batch comes again under the same number. A ledger row for each (feed, batch) is what makes it count once: a batch writes its
result to a folder of its own number and then its ledger row; readers follow the ledger, so a batch killed half way is
never seen and its replay writes the same folder anew, and a batch that is in the ledger is skipped. One feed failing does
not stop the next.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "feed string, batch long, version string"


def ingest_feed(spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame, int], None], checkpoint: str, *,
                file_format: str = "json", max_files: int | None = None, unique: Sequence[str] = (), event_time: str | None = None, late: str = "7 days") -> None:
    """Runs ``merge(batch, batch_id)`` over the new files of one folder and returns when they are done.

    ``unique``: rows that repeat these columns over all batches come once, told by the stream's own state; with
    ``event_time`` the state forgets what is ``late`` behind.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(folder)
    if unique:
        rows = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([*unique]) if event_time else rows.dropDuplicates([*unique])
    query = (rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def ingest_all(spark: SparkSession, feeds: Mapping[str, dict], merge: Callable[[str], Callable[[DataFrame, int], None]], checkpoint_root: str) -> dict[str, str | None]:
    """All feeds in order: {feed: None or the error text}. ``feeds[name]`` holds the options of ``ingest_feed``."""
    outcome: dict[str, str | None] = {}
    for name, options in feeds.items():
        try:
            ingest_feed(spark, merge=merge(name), checkpoint=f"{checkpoint_root}/{name}", **options)
            outcome[name] = None
        except Exception as err:  # the next feed must still run; the caller sees every failure
            outcome[name] = f"{type(err).__name__}: {err}"
    return outcome


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(feed, batch, version) of the committed batches under ``root``; empty if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table as of the last committed batch of any feed, in order of the ledger's versions; empty before the first."""
    last = ledger(spark, root).agg(F.max("version")).first()[0]
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{root}/{last}")


def merged_once(spark: SparkSession, root: str, feed: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``merge`` for ``ingest_feed``: merge(table, batch) gives the next version of the table under ``root``, written and
    committed once for each (feed, batch). Feeds that share a root must run one after the other, as ``ingest_all`` does."""
    def run(batch: DataFrame, number: int) -> None:
        done = ledger(spark, root)
        if not done.where((F.col("feed") == feed) & (F.col("batch") == number)).isEmpty():
            return
        # versions are numbered by the ledger, so a replay after a failed write takes the same number again
        version = f"version={done.count():010d}"
        merge(current(spark, root, schema), batch).write.mode("overwrite").parquet(f"{root}/{version}")
        spark.createDataFrame([(feed, number, version)], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return run
