"""Helpers that the operators share: lineage cuts, word splitting and connected components."""

from __future__ import annotations

import gc
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space (the same split as ``bytes.split()``).
WORD = r"[^\x20\x09-\x0D]+"

#: A null identifier is larger than any other.
NO_ID = (1 << 63) - 1


#: Bytes of an Arrow batch that a Python worker gets; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. In local mode, and only there, one of our own if none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def in_python(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, whatever the length of the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame) -> str:
    """The columns of ``df`` as the schema of a function that passes them on."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores before those that ``columns`` have already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def tagged(docs: DataFrame, id_: str, proof: str) -> DataFrame:
    """``docs`` with what tells its rows apart: ``id_``, the doc_id (NO_ID for null), and ``proof``, a hash of the text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), proof: F.xxhash64(text)})


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Have Spark delete shuffle files and checkpoints of frames that are gone. It does so when the driver collects garbage, which alone is rare."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to a new place in the shared folder and read again, for use in several jobs."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


#: Narrow rows that a task of an iterative operator takes at least.
TASK_ROWS = 50_000


def compact(df: DataFrame) -> DataFrame:
    """``cut``, in no more partitions than its rows need: small frames then shuffle as few files."""
    df = cut(df)
    return df.coalesce(1 + df.coalesce(16).count() // TASK_ROWS)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(buckets))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distributed union-find: (node, root) for every node of an edge, root being its component's smallest node.

    Alternates large-star and small-star steps until the edge set is a fixed point. Each step is a grouped
    minimum (combined before its shuffle) and an equi-join that AQE can split, so a node with very many
    neighbours is no bottleneck. Nulls and self-loops are ignored.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = compact(edges.where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, tasks = now, 1 + now[0] // TASK_ROWS  # no more tasks, and files, than the edges need
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.coalesce(tasks).union(low.select("u", "m").coalesce(tasks)).distinct().coalesce(tasks))


#: Narrow rows (of a few dozen bytes) that a broadcast may hold, about 10 MB.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, cut from their lineage and marked for broadcast if there are at most ``rows``; else joins shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def once(docs: DataFrame, id_: str, proof: str) -> DataFrame:
    """``docs`` tagged with ``id_`` and ``proof``; of rows that repeat both, one. Only such rows are shuffled."""
    rows = tagged(docs, id_, proof)
    again = broadcast_if_small(rows.groupBy(id_, proof).count().where("count > 1").select(id_, proof))
    if again.isEmpty():
        return rows
    repeated = rows.join(again, [id_, proof], "left_semi").dropDuplicates([id_, proof])
    return rows.join(again, [id_, proof], "left_anti").unionByName(repeated)
