"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import cut, in_python

#: Runs that one merge joins into one, and digests of a run that lie in one piece of it, about.
FAN_IN, PIECE = 16, 20_000
#: Texts are equal when their SHA-256, byte length and a second hash are.
KEY = ["text_sha256", "n_bytes", "proof"]
FIELDS = [*KEY, "doc_id", "row", "n"]

#: (digest, bytes, proof), doc_id and row of the best document, number of documents.
Entry = tuple[tuple, object, int, int]


def digest_runs(docs: DataFrame, text: Column) -> DataFrame:
    """One row per document: its identifier, digests of its text, and the run (input partition) it is in."""
    return docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.sha2(text, 256).alias("text_sha256"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("proof"),
    )


def width(n: int, piece: int) -> int:
    """Leading bits of a digest that part a run of n documents into pieces; digests are spread evenly."""
    return min(32, (-(-n // piece) - 1).bit_length()) if n else 0


def collapsed(entries: Iterable[Entry], largest: bool) -> Iterator[Entry]:
    """Sorted entries with one for each key: the best document, a null doc_id being the smallest, and the count."""
    rank = lambda e: (e[1] is not None, e[1], e[2])
    for key, same in groupby(entries, key=itemgetter(0)):
        best, n = None, 0
        for e in same:
            n += e[3]
            if best is None or (rank(e) > rank(best)) == largest:
                best = e
        yield key, best[1], best[2], n


def pieces(run: int, entries: Iterable[Entry], bits: int) -> Iterator[tuple[int, int, list[Entry]]]:
    """A sorted run cut where the leading bits of its digests change: the units that runs exchange."""
    for bucket, part in groupby(entries, key=lambda e: int(e[0][0][:8], 16) >> 32 - bits):
        yield run, bucket, list(part)


def packed(found: Iterable[tuple[int, int, list[Entry]]], id_type: pa.DataType, piece: int) -> Iterator[pa.RecordBatch]:
    """Pieces as rows (run, bucket, entries), in batches of about a piece."""
    types = [pa.string(), pa.int32(), pa.int64(), id_type, pa.int64(), pa.int64()]
    runs, buckets, ends, flat = [], [], [0], []

    def batch() -> pa.RecordBatch:
        columns = [*zip(*[(*key, *rest) for key, *rest in flat])] or [[]] * len(types)
        entries = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], FIELDS)
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), pa.array(buckets, pa.int64()), listed], ["run", "bucket", "entries"])

    for run, bucket, part in found:
        runs.append(run)
        buckets.append(bucket)
        flat += part
        ends.append(len(flat))
        if len(flat) >= piece:
            yield batch()
            runs, buckets, ends, flat = [], [], [0], []
    yield batch()


def unpacked(entries: pa.StructArray) -> Iterator[Entry]:
    for *key, doc_id, row, n in zip(*[entries.field(i).to_pylist() for i in range(len(FIELDS))]):
        yield tuple(key), doc_id, row, n


def sorted_runs(id_type: pa.DataType, largest: bool, bits: int, piece: int) -> Callable:
    """For the sorted documents of a partition: its run, in pieces."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Entry]]:
        for b in batches:
            for run, *key, doc_id, row in zip(*[b.column(c).to_pylist() for c in ("run", *KEY, "doc_id", "row")]):
                yield run, (tuple(key), doc_id, row, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in groupby(entries(batches), key=itemgetter(0)):
            yield from packed(pieces(number, collapsed(map(itemgetter(1), own), largest), bits), id_type, piece)

    return run


def multiway(id_type: pa.DataType, largest: bool, bits: int, piece: int) -> Callable:
    """For the pieces of one bucket from all runs of a merge: their merged run, cut for the next exchange."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sources = [unpacked(p.values) for p in table.column("entries")]
        merged = collapsed(heapq.merge(*sources, key=itemgetter(0)), largest)
        return pa.Table.from_batches(packed(pieces(key[0].as_py(), merged, bits), id_type, piece))

    return run


def exact_dedup(docs: DataFrame, text: str = "text", keep: str = "largest", fan_in: int = FAN_IN, piece: int = PIECE) -> DataFrame:
    """Mark, for each document, which document of those with the same text stays.

    Every input partition sorts its documents' digests and makes them a run: one entry a text, with its best document
    and count. In round r the runs of ``fan_in ** r`` partitions are merged: each is cut into pieces by the leading bits
    of its digests, so that merged pieces hold about ``piece`` documents, pieces of one bucket meet, and a multiway merge
    keeps the best document of each text. Each level is checkpointed. After the last round one run is left, in pieces.
    The way back down the tree tells each run, and then each document, what its digest's winner is. A text that a third
    of all rows share has one entry a run, so it meets only ``fan_in`` others at each level, and never one task.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null text counts as the empty text. A null doc_id
    is smaller than any other. Rows that repeat doc_id and text are a group in which exactly one row is kept.
    An empty table gives an empty result; columns of other names are ignored.
    """
    leaves = cut(digest_runs(docs, F.coalesce(F.col(text).cast("string"), F.lit(""))))
    shape = f"run int, bucket long, entries array<struct<text_sha256: string, n_bytes: int, proof: long, doc_id: {docs.schema['doc_id'].dataType.simpleString()}, row: long, n: long>>"
    id_type = leaves.select("doc_id").limit(0).toArrow().schema.field(0).type
    sizes = cut(leaves.groupBy("run").agg(F.count("*").alias("n")))
    parent = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    runs, bits, level = (sizes.agg(F.max("run")).first()[0] or 0) + 1, [], sizes
    while True:  # the widest run of each level, by the few rows that count runs
        bits.append(width(level.agg(F.max("n")).first()[0] or 0, piece))
        if runs == 1:
            break
        level, runs = level.groupBy(parent).agg(F.sum("n").alias("n")), -(-runs // fan_in)
    top = len(bits) - 1
    way = lambda r: (id_type, keep == "largest", bits[min(r + 1, top)], piece)
    levels = [cut(in_python(leaves.sortWithinPartitions("run", *KEY), sorted_runs(*way(0)), shape))]
    for r in range(1, top + 1):
        levels.append(cut(levels[-1].select(parent, "bucket", "entries").groupBy("run", "bucket").applyInArrow(multiway(*way(r)), shape)))
    known = levels.pop().select("run", F.inline("entries")).select("run", *KEY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
    while levels:
        below = levels.pop().select("run", F.inline("entries")).select("run", *KEY, parent.alias("up"))
        known = below.join(known.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    return leaves.join(known, ["run", *KEY]).select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("keep_row") == F.col("row")).alias("kept"), "text_sha256")
