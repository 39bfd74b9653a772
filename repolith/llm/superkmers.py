"""Super-k-mer partitioning: windows of a text dealt to buckets by their minimiser, packed in runs.

A window is ``width`` consecutive units (words or bytes) of one document. Its minimiser is the least hash of the
``probe``-unit pieces in it. Equal windows have equal minimisers, so all copies of a window reach one bucket,
and consecutive windows with one minimiser travel as one packed string.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import cut, in_python, tagged

#: Bytes of text that a task packs at once; units of the documents whose minimisers it looks for at once.
CHUNK, BLOCK = 4 << 20, 1 << 18
#: Minimisers that are hot, at most: one has to have more than a share of 1 / HOT_MOST of all super-k-mers (8 MB as a list).
HOT_MOST = 1_000_000
#: Bits of the filter of minimisers that occur twice (a fixed 16 MB; a fuller one lets more through).
TWICE_BITS = 27
#: Words of more bytes are hashed by XXH64, shorter ones by a polynomial for all words at once.
LONG_WORD = 64
#: Low bits of a window's minimum hold the place of the minimiser, the rest its hash.
PLACE = 24

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Kind:
    """words: units are words, else bytes."""

    words: bool
    width: int
    probe: int


@dataclass
class Chunk:
    """Texts end to end: unit hashes, where each unit begins and ends in ``buffer``, each document's first unit."""

    buffer: bytes
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(h: np.ndarray, width: int, c: np.uint64) -> np.ndarray:
    """Polynomial hash of each ``width`` consecutive values, built by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, size, now, power = np.zeros(n, np.uint64), 0, 1, h, c
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                out += factor * now[done : done + n]
                done, factor = done + size, factor * power
            if done == width:
                return out
            now, size, power = now[: len(now) - size] + power * now[size:], 2 * size, power * power


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v, size = np.minimum(v[: len(v) - size], v[size:]), 2 * size
    rest = width - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def word_hashes(data: np.ndarray, begin: np.ndarray, gap: np.ndarray, c: np.uint64) -> np.ndarray:
    """Hash of each word; ``gap`` marks the separator that follows each word."""
    with np.errstate(over="ignore"):
        length = np.diff(np.append(begin, len(data)))
        power = np.cumprod(np.full(LONG_WORD + 1, c, np.uint64))
        place = np.minimum(np.arange(len(data)) - np.repeat(begin, length), LONG_WORD)
        value = (data.astype(np.uint64) + np.uint64(1)) * power[place]
        value[gap] = 0
        out = mix(np.add.reduceat(value, begin))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[begin[i] : gap[i]], int(c) >> 1)
    return out


def chunk_of(texts: list[bytes], kind: Kind, c: np.uint64 = _C1) -> Chunk:
    if not kind.words:
        first = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(buffer := b"".join(texts), np.uint8)
        at = np.arange(len(data))
        return Chunk(buffer, mix(np.arange(256, dtype=np.uint64) + c)[data], at, at + 1, first)
    split = [t.split() for t in texts]
    first = np.cumsum([0, *map(len, split)])
    buffer = b" ".join(b" ".join(w) for w in split if w) + b" "
    if not first[-1]:
        return Chunk(b"", *[np.empty(0, t) for t in (np.uint64, np.int64, np.int64)], first)
    data = np.frombuffer(buffer, np.uint8)
    gap = np.flatnonzero(data == 32)
    begin = np.concatenate(([0], gap[:-1] + 1))
    return Chunk(buffer, word_hashes(data, begin, gap, c), begin, gap, first)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Units at which a window of one document begins."""
    size = np.diff(first)
    doc = np.flatnonzero(size >= width)
    n = size[doc] - width + 1
    return np.arange(n.sum()) + np.repeat(first[doc] - (np.cumsum(n) - n), n)


def runs(chunk: Chunk, kind: Kind) -> list[np.ndarray]:
    """Super-k-mers of a chunk: minimiser, first window, number of windows, document's place, repeats-inside.

    Documents are taken a few at a time, so that the arrays stay in the processor's cache.
    """
    parts, i, n = [], 0, len(chunk.first) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(chunk.first, chunk.first[i] + BLOCK, "right")) - 1)
        parts.append(_runs(chunk.hashes[chunk.first[i] : chunk.first[j]], chunk.first[i : j + 1] - chunk.first[i], kind))
        parts[-1][1] += chunk.first[i]
        parts[-1][3] += i
        i = j
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 5


def _runs(hashes: np.ndarray, first: np.ndarray, kind: Kind) -> list[np.ndarray]:
    at = window_starts(first, kind.width)
    if not len(at):
        return [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool)]
    pieces = mix(span_hash(hashes, kind.probe, _C2))
    low = np.uint64((1 << PLACE) - 1)
    v = (pieces & ~low) | (np.arange(len(pieces), dtype=np.uint64) & low)
    least = sliding_min(v, kind.width - kind.probe + 1)[at]
    key = least >> np.uint64(PLACE)
    begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))))
    end = np.append(begin[1:], len(at))
    doc = np.searchsorted(first, at[begin], "right") - 1
    return [key[begin].astype(np.int64), at[begin], end - begin, doc, least[begin] != least[end - 1]]


def chunks(batches: Iterator[pa.RecordBatch], kind: Kind):
    """(ids, proofs, Chunk) of about CHUNK bytes each."""
    ids, proofs, texts, size = [], [], [], 0
    for batch in batches:
        for i, p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = t.as_py() or b""
            if texts and size + len(text) > CHUNK:
                yield np.array(ids, np.int64), np.array(proofs, np.int64), chunk_of(texts, kind)
                ids, proofs, texts, size = [], [], [], 0
            ids.append(i)
            proofs.append(p)
            texts.append(text)
            size += len(text)
    if texts:
        yield np.array(ids, np.int64), np.array(proofs, np.int64), chunk_of(texts, kind)


def _count(kind: Kind):
    def run(batches):
        for _, _, chunk in chunks(batches, kind):
            key, _, _, _, _ = runs(chunk, kind)
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


_PACKED = [("key", np.int64), ("id", np.int64), ("proof", np.int64), ("first", np.int32), ("size", np.int32)]


def pack(columns: list[np.ndarray], text: bytes) -> bytes:
    out = io.BytesIO()
    out.write(np.int64(len(columns[0])).tobytes())
    for (_, kind), column in zip(_PACKED, columns):
        out.write(column.astype(kind).tobytes())
    out.write(text)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n, at, columns = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for _, kind in _PACKED:
        columns.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return columns, data[at:]


def _slot(key: np.ndarray) -> np.ndarray:
    return (mix(key.view(np.uint64)) >> np.uint64(64 - TWICE_BITS)).astype(np.int64)


def _slots_of(batches):
    for batch in batches:
        slot = _slot(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(slot & 63)], ["word", "bit"])


def _deal(kind: Kind, buckets: int, twice, hot):
    def run(batches):
        for ids, proofs, chunk in chunks(batches, kind):
            key, at, n, doc, inside = runs(chunk, kind)
            slot = _slot(key)
            again = (twice.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            keep = (again | inside) & ~np.isin(key, hot.value)
            key, at, n, doc, inside = (x[keep] for x in (key, at, n, doc, inside))
            if not len(key):
                continue
            bucket = key % buckets
            order = np.argsort(bucket, kind="stable")
            key, at, n, doc, inside, bucket = (x[order] for x in (key, at, n, doc, inside, bucket))
            begin, end = chunk.begin[at], chunk.end[at + n + kind.width - 2]
            first = at - chunk.first[doc]
            size = np.where(inside, -(end - begin), end - begin)  # a negative size marks a run with repeats inside
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
            slices = list(zip(begin.tolist(), end.tolist()))
            packed = []
            for i, j in zip(cuts, [*cuts[1:], len(key)]):
                text = b"".join([chunk.buffer[a:b] for a, b in slices[i:j]])
                packed.append(pack([key[i:j], ids[doc[i:j]], proofs[doc[i:j]], first[i:j], size[i:j]], text))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(packed, pa.binary())], ["bucket", "packed"])

    return run


def _hot_windows(kind: Kind, hot):
    """Windows with a hot minimiser, one by one, as half of their SHA-256."""

    def run(batches):
        for ids, proofs, chunk in chunks(batches, kind):
            key, at, n, doc, _ = runs(chunk, kind)
            keep = np.isin(key, hot.value)
            at, n, doc = at[keep], n[keep], doc[keep]
            if not len(at):
                continue
            window = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
            doc = np.repeat(doc, n)
            buffer, of = memoryview(chunk.buffer), hashlib.sha256
            for i in range(0, len(window), 100_000):
                w, d = window[i : i + 100_000], doc[i : i + 100_000]
                spans = zip(chunk.begin[w].tolist(), chunk.end[w + kind.width - 1].tolist())
                digest = pa.array([of(buffer[a:b]).digest()[:16] for a, b in spans], pa.binary())
                columns = [digest, *(pa.array(c) for c in (ids[d], proofs[d], (w - chunk.first[d]).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["window", "id", "proof", "first"])

    return run


def identified(docs: DataFrame) -> DataFrame:
    """(id, proof, text): rows with one doc_id but different texts differ in proof."""
    rows = tagged(docs.select("doc_id", "text"), "id", "proof")
    return rows.select("id", "proof", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def dealt(texts: DataFrame, kind: Kind, per_bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, packed) of all super-k-mers but those with a hot minimiser; and the hot windows, or None.

    A first pass counts super-k-mers by minimiser over all texts. A minimiser that occurs once has no window that
    repeats (but within its super-k-mer), so only the others travel: a filter of fixed size tells them. Their number
    gives the number of buckets, of ``per_bucket`` super-k-mers on average. A minimiser with more than that, and with
    more than one of HOT_MOST, is hot: no bucket takes it, its windows go one by one instead (window, id, proof, first)
    to grouped aggregates that combine before the shuffle. So the list of hot ones is bounded, and a bucket has at most
    ``per_bucket`` super-k-mers or one of HOT_MOST of all, for each of its minimisers.
    """
    counts = in_python(texts, _count(kind), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    context = texts.sparkSession.sparkContext
    hot = counts.where(F.col("n") > max(per_bucket, total // HOT_MOST)).select("key").collect()  # HOT_MOST rows at most
    hot = context.broadcast(np.array(sorted(r[0] for r in hot), np.int64))
    words = in_python(counts.select("key"), _slots_of, "word long, bit long").groupBy("word")
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))).alias("bits")).toArrow()
    twice = np.zeros(1 << (TWICE_BITS - 6), np.uint64)
    twice[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    twice = context.broadcast(twice)
    buckets = max(1, -(-total // per_bucket))
    packed = in_python(texts, _deal(kind, buckets, twice, hot), "bucket long, packed binary")
    if not len(hot.value):
        return packed, None
    return packed, in_python(texts, _hot_windows(kind, hot), "window binary, id long, proof long, first int")


def spans_of(id_: np.ndarray, proof: np.ndarray, first: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Windows as maximal runs of covered units: id, proof, begin, end."""
    order = np.lexsort((first, proof, id_))
    id_, proof, first = id_[order], proof[order], first[order]
    new = np.concatenate(([True], (id_[1:] != id_[:-1]) | (proof[1:] != proof[:-1]) | (first[1:] > first[:-1] + width))) if len(id_) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(id_))[: len(begin)] - 1
    return {"id": id_[begin], "proof": proof[begin], "begin": first[begin], "end": first[last] + width}


def hot_spans(spans: DataFrame, hot: DataFrame | None, width: int, smaller: bool) -> DataFrame:
    """``spans`` and those of repeated hot windows: repeats of a smaller id only, or of any other window."""
    if hot is None:
        return spans
    known = hot.groupBy("window").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    again = hot.join(known, "window")
    again = again.where("id > least") if smaller else again
    return spans.union(again.select("id", "proof", F.col("first").alias("begin"), (F.col("first") + width).alias("end")))


def by_document(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, proof, text, spans): each document with the runs to remove, in any order and overlapping."""
    spans = spans.groupBy("id", "proof").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    return texts.join(spans, ["id", "proof"], "left")


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Runs sorted by ``begin``, with overlapping and touching ones joined."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return list(zip(begin[new].tolist(), reach[np.append(new[1:], len(end)) - 1].tolist()))


def rows_of(batch: pa.RecordBatch):
    """(id, text, runs to remove) of rows of ``by_document``."""
    ids, texts, spans = (batch.column(n) for n in ("id", "text", "spans"))
    inner = spans.flatten()
    begin, end = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    sizes = np.array([0 if s is None else s for s in spans.value_lengths().to_pylist()], np.int64)
    heads = (np.cumsum(sizes) - sizes).tolist()
    for i, text, head, size in zip(ids.to_pylist(), texts, heads, sizes.tolist()):
        yield i, text.as_py(), merged(begin[head : head + size], end[head : head + size]) if size else []
