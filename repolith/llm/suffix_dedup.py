"""Substring dedup over bytes: suffixes of dealt shards, sorted by induction."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from repolith.llm.common import NO_ID, in_python
from repolith.llm.induced import sort_suffixes
from repolith.llm.superkmers import Kind, by_document, dealt, hot_spans, identified, rows_of, spans_of, unpack

#: Bytes of a repeated string; of the pieces that minimisers are chosen from.
WIDTH, PROBE = 400, 32
#: Super-k-mers of a shard, about 600 bytes each.
PER_SHARD = 8_000
#: Queue entries and characters of a shard in memory; what is beyond is on disk (a shard of 5 MB is).
MEMORY = 1 << 20
#: The character between strings is none of a text's bytes, so no string of a text reaches over it.
BETWEEN = 256


def repeated(packed: list[bytes], width: int, memory: int = MEMORY) -> dict[str, np.ndarray]:
    """Spans of a shard's ``width``-byte strings that start at two places or more.

    Equal super-k-mers are sorted once: they repeat as a whole. Of the others, only those can repeat whose
    minimiser occurs twice. Their suffixes are sorted; a string repeats if a neighbour in that order has at
    least ``width`` bytes in common with it.
    """
    columns, texts = [], []
    for p in packed:
        got, text = unpack(p)
        columns.append(got)
        ends = np.cumsum(np.abs(got[4])).tolist()
        texts += [text[a:b] for a, b in zip([0, *ends], ends)]
    key, id_, proof, first, size = (np.concatenate(c) for c in zip(*columns))
    _, group, n = np.unique(key, return_inverse=True, return_counts=True)
    keep = np.flatnonzero((n[group] > 1) | (size < 0)).tolist()
    place: dict[bytes, int] = {}
    member = np.array([place.setdefault(texts[i], len(place)) for i in keep], np.int64)
    if not len(member):
        return spans_of(id_[:0], proof[:0], first[:0], width)
    whole = np.bincount(member) > 1
    length = np.array([len(t) for t in place], np.int64)
    begin = np.cumsum(np.append(0, length + 1))[:-1]
    shard = np.full(int(length.sum()) + len(length), BETWEEN, np.int16)
    shard[np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)] = np.frombuffer(b"".join(place), np.uint8)
    order, lcp = sort_suffixes(shard, width, memory)
    twice = np.zeros(len(shard), bool)
    hit = np.flatnonzero(lcp >= width)
    twice[order[hit]] = twice[order[hit - 1]] = True
    starts = length - width + 1
    window = np.arange(starts.sum()) + np.repeat(begin - (np.cumsum(starts) - starts), starts)
    owner = np.repeat(np.arange(len(length)), starts)
    found = np.flatnonzero(twice[window] | whole[owner])
    # Back to every document that has the string.
    offset, owner = window[found] - begin[owner[found]], owner[found]
    count = np.bincount(owner, minlength=len(length))
    head = np.cumsum(count) - count
    reps = count[member]
    pick = np.arange(reps.sum()) + np.repeat(head[member] - (np.cumsum(reps) - reps), reps)
    row = np.repeat(np.array(keep), reps)
    return spans_of(id_[row], proof[row], first[row] + offset[pick].astype(np.int32), width)


def _shard(width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(repeated(list(group["packed"]), width))

    return run


def _kept(batches):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    for batch in batches:
        out = []
        for id_, text, spans in rows_of(batch):
            digest, at = hashlib.sha256(), 0
            view = memoryview(text)
            for begin, end in spans:
                digest.update(view[at:begin])
                at = end
            digest.update(view[at:])
            removed = sum(e - b for b, e in spans)
            out.append((None if id_ == NO_ID else id_, len(text), removed, len(spans), digest.hexdigest(), [{"begin": b, "end": e} for b, e in spans]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, probe: int = PROBE, per_shard: int = PER_SHARD) -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts anywhere else.

    Texts are dealt as super-k-mers, so that all copies of a string reach one shard of bounded size, and each
    shard's suffixes are sorted by induction with their common prefixes. Strings are judged on the input, may
    overlap and may repeat within one document; none crosses documents.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and spans (begin, end in
    bytes). Null text is empty; shorter texts keep all. Rows that repeat doc_id and text count as two documents.
    An empty table gives an empty result; other columns are ignored.
    """
    texts = identified(docs)
    packed, hot = dealt(texts, Kind(False, width, probe), per_shard)
    spans = packed.groupBy("bucket").applyInPandas(_shard(width), "id long, proof long, begin int, end int")
    out = by_document(texts, hot_spans(spans, hot, width, smaller=False))
    return in_python(out, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin int, end int>>")
