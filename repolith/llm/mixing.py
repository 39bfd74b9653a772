"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm.common import cut, fresh, once, quoted, word_count

#: No document is taken more often than this.
MAX_REPEATS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix"


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources share the sum of all sizes by weight; a target stops at ``max_repeats`` times its source's size and
    the excess is shared again by weight. That is water filling: in order of limit / weight, a source is held at
    its limit while its share of what is left exceeds it; the first that is not fixes the level for all others.
    The table has one row per source, so its windows are small whatever the corpus holds.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (index + 1).cast("int")).cast("long")
    limit = (F.col("source_size") * max_repeats).cast("double")
    total = total.withColumn("weight", weight).withColumn("limit", limit)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    total = total.withColumn("left", left).withColumn("rest", F.sum("weight").over(onward))
    total = total.withColumn("full", F.col("limit") * F.col("rest") < F.col("left") * F.col("weight"))
    total = total.withColumn("level", F.max(F.when(~F.col("full"), F.struct("rest", "left"))).over(everything))
    share = F.col("weight") * F.col("level.left") / F.col("level.rest")
    return total.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(share).alias("target"))


def running_sum(rows: DataFrame, order: list[Column], group: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` in ``order`` within ``group``, as a parallel scan.

    Rows are range-partitioned by group and order, summed inside each range, and shifted by the sums of the
    ranges before it (one row per range and group), so that no group is ever in one task.
    """
    by = [F.col(g).asc_nulls_last() for g in group]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id()))
    keys = ["part", *[f"_g{i}" for i in range(len(group))]]
    for i, g in enumerate(group):
        ranged = ranged.withColumn(f"_g{i}", F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("-")))
    sums = ranged.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys[1:]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumn("_in", F.sum(value).over(inside)).join(sums, keys)
    return ranged.withColumn(out, F.col("_in") + F.col("_before")).drop(*keys, "_in", "_before")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Choose how often each document is taken, so that sources meet their target shares.

    Each source's documents are shuffled by a hash of their identifier and repeated up to ``max_repeats`` times,
    pass after pass. A copy's virtual finish time is its source's running size divided by the source's target.
    All copies are range-sorted by that time and cut where the running size passes the budget (the sum of all
    sizes). Sources thus proceed at rates in proportion to their targets and all end within one document of them.

    Returns doc_id, source, size, source_size, target, copies, taken (= copies * size) and the columns of ``carry``. Sizes count words; null
    text has size 0. Null sources form one source, the last. Ties of the shuffle key are ordered by size;
    rows equal in all of that are interchangeable. An empty table gives an empty result.
    """
    sized = cut(docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size")))
    sized = sized.withColumn("shuffle", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed)).cast("binary")))
    place = [F.col("shuffle"), F.col("doc_id"), F.col("size")]
    sized = running_sum(sized, place, ["source"], "size", "sofar").withColumn("row", F.monotonically_increasing_id())
    sized = cut(sized)
    targets = cut(source_targets(sized, weights, max_repeats))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    joined = joined.select("d.*", "source_size", "target")
    copies = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    finish = F.try_divide(F.col("pass") * F.col("source_size") + F.col("sofar"), F.col("target"))
    # A copy that starts after its source's target can not be taken: all before it already fill the budget's share.
    copies = copies.where("pass * source_size < target or source_size = 0 and pass = 0")
    copies = copies.withColumn("finish", F.coalesce(finish, F.lit(0.0)))
    queue = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("pass"), *place]
    queued = running_sum(copies.select("row", "finish", "source", "pass", "shuffle", "doc_id", "size"), queue, [], "size", "total")
    taken = queued.where(F.col("total") <= F.lit(budget)).groupBy("row").agg(F.count("*").alias("copies"))
    copies = F.coalesce("copies", F.lit(0))
    return joined.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry
    )


def taken_copies(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the mix takes, with size, source_size, target, copies and taken.

    Names of these that ``docs`` has already get underscores in front. Rows that repeat doc_id and text are one document.
    """
    id_, proof, *names = fresh(docs.columns, "_id", "_proof", "size", "source_size", "target", "copies", "taken")
    rows = once(docs, id_, proof)
    taken = mix(rows.select(F.col(id_).alias("doc_id"), "source", "text", F.col(proof).alias("_proof")), carry=("_proof",)).where("copies > 0")
    values = [F.col(a).alias(b) for a, b in zip(("size", "source_size", "target", "copies", "taken"), names)]
    taken = taken.select(F.col("doc_id").alias(id_), F.col("_proof").alias(proof), *values)
    return rows.join(taken, [id_, proof]).select(*quoted(docs.columns), *names)
