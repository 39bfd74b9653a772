"""Substring dedup over windows of words, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import NO_ID, in_python
from repolith.llm.superkmers import (
    Kind,
    by_document,
    chunk_of,
    dealt,
    hot_spans,
    identified,
    mix,
    rows_of,
    span_hash,
    spans_of,
    unpack,
    window_starts,
)

#: Words of a window; words of the pieces that minimisers are chosen from.
WIDTH, PROBE = 50, 4
#: Super-k-mers of a bucket, about 75 words each.
PER_BUCKET = 20_000


def word_numbers(chunk) -> np.ndarray:
    """A number for each distinct word, by its bytes."""
    ends = np.append(chunk.begin, len(chunk.buffer)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(chunk.begin), [None, pa.py_buffer(ends), pa.py_buffer(chunk.buffer)])
    return words.dictionary_encode().indices.to_numpy()


def equal_windows(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window that begins at ``at``; equal words give equal numbers, others never do.

    Windows are sorted by a hash and those of equal hash compared word by word; should two of them differ, all
    windows with that hash are sorted by their words.
    """
    with np.errstate(over="ignore"):
        value = span_hash(mix(words.astype(np.uint64) + np.uint64(1)), width, np.uint64(0xC2B2AE3D27D4EB4F))[at]
    order = np.argsort(value)
    new = np.append(True, value[order][1:] != value[order][:-1])
    again = np.flatnonzero(~new)
    a, b = at[order[again]], at[order[again - 1]]
    wrong = np.zeros(len(again), bool)
    for k in range(width):
        wrong |= words[a + k] != words[b + k]
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new)
    if wrong.any():
        odd = np.flatnonzero(np.isin(group, group[order[again[wrong]]]))
        _, exact = np.unique(words[at[odd][:, None] + np.arange(width)], axis=0, return_inverse=True)
        group[odd] = exact.reshape(-1) + len(at) + 1
    return group


def repeated(packed: list[bytes], kind: Kind) -> dict[str, np.ndarray]:
    """Spans of a bucket's windows that also start in a document with a smaller id."""
    columns, texts = [], []
    for p in packed:
        got, text = unpack(p)
        columns.append(got)
        ends = np.cumsum(np.abs(got[4])).tolist()
        texts += [text[a:b] for a, b in zip([0, *ends], ends)]
    key, id_, proof, first, _ = (np.concatenate(c) for c in zip(*columns))
    # Only a minimiser that two documents have can belong to a window that repeats.
    _, group = np.unique(key, return_inverse=True)
    low, high = np.full(group.max() + 1, NO_ID), np.full(group.max() + 1, -NO_ID - 1)
    np.minimum.at(low, group, id_)
    np.maximum.at(high, group, id_)
    keep = np.flatnonzero((low < high)[group])
    if not len(keep):
        return spans_of(id_[:0], proof[:0], first[:0], kind.width)
    chunk = chunk_of([texts[i] for i in keep], kind)
    at = window_starts(chunk.first, kind.width)
    run = np.searchsorted(chunk.first, at, "right") - 1
    ids, place = id_[keep][run], first[keep][run] + (at - chunk.first[run])
    group = equal_windows(word_numbers(chunk), at, kind.width)
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    new = np.concatenate(([True], group[1:] != group[:-1]))
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = order[ids > least]
    return spans_of(id_[keep][run[gone]], proof[keep][run[gone]], place[gone], kind.width)


def _bucket(kind: Kind):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(repeated(list(group["packed"]), kind))

    return run


def _kept(with_text: bool):
    def run(batches):
        for batch in batches:
            yield _rebuilt(batch, with_text)

    return run


def _rebuilt(batch: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    """Texts without the words of their spans."""
    out = []
    for id_, text, spans in rows_of(batch):
        words = text.split()
        n = len(words)
        for begin, end in reversed(spans):
            del words[begin:end]
        text = b" ".join(words)
        out.append((None if id_ == NO_ID else id_, n, n - len(words), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def removal_spans(texts: DataFrame, width: int, probe: int, per_bucket: int) -> DataFrame:
    kind = Kind(True, width, probe)
    packed, hot = dealt(texts, kind, per_bucket)
    spans = packed.groupBy("bucket").applyInPandas(_bucket(kind), "id long, proof long, begin int, end int")
    return hot_spans(spans, hot, width, smaller=True)


def dedup_windows(docs: DataFrame, width: int = WIDTH, probe: int = PROBE, per_bucket: int = PER_BUCKET, with_text: bool = True) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document with a smaller doc_id.

    Super-k-mers go to the bucket of their minimiser; there windows are sorted by
    a hash and compared word by word, so equality is exact (of hot minimisers, it is that of half a SHA-256). Windows are
    judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space; null
    if ``with_text`` is off).

    Null text has no words; texts shorter than a window keep all. A null doc_id is larger than any other and
    such documents do not remove each other's words; the same holds for rows that repeat a doc_id. An empty
    table gives an empty result; other columns are ignored.
    """
    texts = identified(docs)
    out = by_document(texts, removal_spans(texts, width, probe, per_bucket))
    return in_python(out, _kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
