"""Cutting lineage between the rounds of iterative operators, and numbering rows without a task that holds all."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; in local mode, in one of our own if that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Have Spark delete shuffle files and checkpoints of frames that are gone. It does so when the driver collects garbage, which alone is rare."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Narrow rows that a broadcast may hold, about 10 MB; rows that a task of an iterative operator takes at least.
BROADCAST_ROWS, TASK_ROWS = 200_000, 50_000


def settled(df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows (those that ``counted`` holds for), by one job; small frames in few partitions, so
    that the next round starts few tasks.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.lit(True) if counted is None else counted).alias("m")))
    return out.coalesce(1 + seen.get["n"] // TASK_ROWS), seen.get["m"]


def small(df: DataFrame, n: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its ``n`` rows are few; joins shuffle it otherwise."""
    return F.broadcast(df) if n <= most else df


def running(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with running sums, and last values that are not null, of each key up to and with each row.

    Rows are dealt by ranges of key and order, so no key is ever in one task. Inside a range a window runs; what the
    ranges before hold of a key that goes on across borders (two keys a range at most) is carried on. ``order`` should
    leave no ties.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lasts = lasts or {}
    sorted_by = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    rows = rows.withColumns({f"__v_{n}": c for n, c in [*sums.items(), *lasts.items()]})
    ranged = cut(rows.repartitionByRange(parts, *sorted_by).withColumn("__part", F.spark_partition_id()))
    at = F.struct(*[F.col(c) for c in order if isinstance(c, str)]) if all(isinstance(c, str) for c in order) else None
    inside = Window.partitionBy("__part", *keys).orderBy(*sorted_by).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: F.sum(f"__v_{n}").over(inside) for n in sums} | {n: F.last(f"__v_{n}", True).over(inside) for n in lasts})
    if at is None and lasts:
        raise ValueError("last values need an order of column names")
    held = ranged.groupBy("__part", *keys).agg(
        F.count("*").alias("__n"), *[F.sum(f"__v_{n}").alias(f"__c_{n}") for n in sums],
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(f"__c_{n}") for n in lasts],
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = held.withColumn("__parts", F.count("*").over(Window.partitionBy(*keys))).where("__parts > 1")
    carry = carry.select("__part", *keys, *[F.sum(f"__c_{n}").over(before).alias(f"__b_{n}") for n in sums], *[F.last(f"__c_{n}", True).over(before).alias(f"__b_{n}") for n in lasts])
    out = out.join(F.broadcast(cut(carry)), ["__part", *keys], "left")  # at most two rows a range
    out = out.withColumns({n: F.col(n) + F.coalesce(f"__b_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(n, f"__b_{n}") for n in lasts})
    return out.drop("__part", *[f"__{k}_{n}" for n in [*sums, *lasts] for k in "vb"])


def numbered(rows: DataFrame, *order, name: str = "seq") -> DataFrame:
    """rows with their place in a total order, from 0, as a long.

    Rows are range-partitioned by the order and counted inside each range; a range begins where the ranges before it
    end (one row a range). A column of that name is replaced.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    out = ranged.withColumn("__in", inside).join(F.broadcast(sizes), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__in") - 1).drop("__part", "__before", "__in")
