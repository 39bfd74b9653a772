"""Incremental scans: a stream of file versions, of which each micro-batch scans only those that differ from the state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolith.operators.lineage import cut, numbered
from repolith.sources.repository import delta

LOG = "path string, status string, content_hash string, batch long"


@dataclass
class Rescan:
    """The state of an incremental scan, in a folder that driver and executors share.

    ``scan`` takes (path, content) rows and returns findings, each of one file: rules that look at a file by itself.
    Every batch adds to two tables what it found out and nothing else: ``log``, the paths whose content is new, and
    ``findings``, what those hold. Of a path only the rows of its latest batch count. A batch reads earlier batches only
    and overwrites its own rows, so one that is run again after a failure ends in the same state.
    """

    folder: str
    scan: Callable[[DataFrame], DataFrame]

    def start(self, changes: DataFrame, **trigger) -> StreamingQuery:
        """Follow a stream of versions (path, content, seq): null content is a removed file, the largest seq the latest."""
        out = changes.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (out.trigger(**trigger) if trigger else out).start()

    def log(self, spark: SparkSession) -> DataFrame:
        """(path, status, content_hash, batch) of all batches; a removed file has no hash."""
        spark.createDataFrame([], "path string, status string, content_hash string").write.mode("ignore").parquet(f"{self.folder}/log/batch=-1")
        return spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def batch(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        latest = rows.groupBy("path").agg(F.max("seq").alias("seq"))
        latest = rows.join(latest, ["path", "seq"], "left_semi").withColumn("content_hash", F.sha2("content", 256))
        narrow = cut(latest.select("path", "content_hash").distinct())
        before = self.log(spark).where(F.col("batch") < number).join(narrow.select("path"), "path", "left_semi")
        before = before.groupBy("path").agg(F.max_by("content_hash", "batch").alias("content_hash")).where("content_hash is not null")
        now = narrow.where("content_hash is not null")
        new = cut(delta(now, before).where("status <> 'unchanged'").join(now, "path", "left"))
        changed = latest.join(new.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
        self.scan(changed.select("path", "content")).write.mode("overwrite").parquet(f"{self.folder}/findings/batch={number}")
        new.write.mode("overwrite").parquet(f"{self.folder}/log/batch={number}")  # last: only now the batch counts

    def current(self, spark: SparkSession) -> DataFrame:
        """The findings of all files as they are now, with ids by rule, path and place."""
        last = self.log(spark).groupBy("path").agg(F.max("batch").alias("batch"))
        found = spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/findings").join(last, ["path", "batch"])
        found = numbered(found, "rule_id", "path", "seq").drop("batch")
        return found.withColumn("id", F.concat("rule_id", F.lit("-"), F.col("seq").cast("string")))
