"""SimHash near-dedup: fingerprints linked by a self-join over binary tries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import components, cut, in_python, tagged
from repolith.llm.superkmers import mix

#: Fingerprints that differ in at most BUDGET of 64 bits are linked. Of so many bits at most BUDGET // PARTS are in one of PARTS
#: equal parts, so as many tries, each with another part first, find every link.
BUDGET, PARTS = 3, 2
#: Near copies: words of a shingle, bits that differ in one of two fingerprints, parts, and bits that differ in both. Of
#: texts with a Jaccard similarity of 0.8, 15 % of the bits differ on average.
NEAR_WIDTH, NEAR_BUDGET, NEAR_PARTS, NEAR_BITS = 5, 7, 4, 24
#: Fingerprints of a trie that one task joins, on average, and those beyond which its trie is dealt to more tasks.
TRIE_SIZE, HOT_TRIE = 8192, 100_000
#: Node pairs with at most this many leaf pairs are compared directly.
LEAVES = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, space-joined; of the whole sequence if it is shorter."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([of(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    hashes = (of(joined[i:j], 42) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist()))
    return np.fromiter(hashes, np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        block = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    return majority(shingle_hashes(text or b"", width))


def _fingerprints(width: int, words: int):
    def run(batches):
        for batch in batches:
            marks = np.zeros((words, batch.num_rows), np.uint64)
            for i, t in enumerate(batch.column("text")):
                hashes = shingle_hashes(t.as_py() or b"", width)
                for k in range(words):
                    marks[k, i] = majority(mix(hashes + np.uint64(k)) if k else hashes)
            names = ["mark", "more"][:words]
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *(pa.array(m.view(np.int64)) for m in marks)], [*keep, *names])

    return run


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, proof, mark[, more]): fingerprints of 64 bits as signed longs; proof tells texts of one doc_id apart."""
    texts = tagged(docs.select("doc_id", "text"), "id", "proof")
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "id", "proof", F.col("text").cast("binary").alias("text"))
    return in_python(texts, _fingerprints(width, words), "doc_id long, id long, proof long, mark long" + ", more long" * (words - 1))


def _labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n items over links a-b."""
    label = np.arange(n) if start is None else start.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            return label
        label = new


def trie_join(marks, depth: int, used, parts: int = PARTS, budget: int = BUDGET, more=None, most_bits: int = 0) -> np.ndarray:
    """Labels (index of each item's representative) of the links among sorted ``marks``.

    The marks share their first ``depth`` bits, but for those with used = 1 (visitors), which differ from the
    others in one of them; two visitors are not compared. Pairs of trie nodes, each a range of the sorted array,
    are traversed together from the top. Each step goes down one bit to the child pairs and adds 1 where they
    differ; a pair is dropped when it exceeds the budget: its share in the first part, ``budget`` in all. Pairs whose
    leaves are all in one component already are dropped too. Where the items have ``more`` bits, leaves are linked only
    if at most ``most_bits`` of all their bits differ.
    """
    n, half = len(marks), 64 // parts
    more = np.zeros(n, np.uint64) if (exact := more is None) else more
    limits = (half, budget // parts, budget, 64 if exact else most_bits)
    sides = [np.flatnonzero(used == 0), np.flatnonzero(used == 1)]
    label = np.arange(n)
    home = marks[sides[0]]
    if exact and len(home) > 1:  # links of one bit first: they join dense groups cheaply
        a, b = [], []
        for bit in range(64 - depth):
            other = home ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(home, other), len(home) - 1)
            hit = np.flatnonzero((home[at] == other) & (home < other))
            a.append(sides[0][hit])
            b.append(sides[0][at[hit]])
        label = _labels(n, np.concatenate(a), np.concatenate(b))
    for second in (0, 1):
        left, right = sides[0], sides[second]
        if not len(left) or not len(right):
            continue
        # Visitors of one neighbouring bucket share a prefix: each such range is a root of its own.
        x, y = marks[left], marks[right]
        top = y >> np.uint64(64 - depth) if depth else np.zeros(len(y), np.uint64)
        first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        pairs = np.stack([np.zeros(len(first), np.int64), np.full(len(first), len(x)), first, np.append(first[1:], len(y)), np.full(len(first), second)])
        for bit in range(63 - depth, -1, -1):
            if not pairs.shape[1]:
                break
            most = budget // parts if bit >= 64 - half else budget
            pairs = _step(x, y, pairs, bit, most, second == 0)
            area = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
            few = (area <= LEAVES) | (bit == 0)
            label = _compare(x, y, left, right, pairs[:, few], label, more, limits)
            pairs = pairs[:, ~few]
            pairs = pairs[:, ~_joined(pairs, label[left], label[right])]
    return label


def _step(x, y, pairs, bit, most, same):
    """Child pairs one bit down."""
    alo, ahi, blo, bhi, err = pairs
    one = np.uint64(1 << bit)
    above = np.uint64((1 << 64) - (1 << bit + 1))
    amid = np.clip(np.searchsorted(x, (x[alo] & above) | one), alo, ahi)
    bmid = np.clip(np.searchsorted(y, (y[blo] & above) | one), blo, bhi)
    children = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid, ahi, blo, bmid, err + 1)]
    out = np.concatenate([np.stack(c) for c in children], axis=1)
    keep = (out[1] > out[0]) & (out[3] > out[2]) & (out[4] <= most)
    if same:
        keep &= out[0] <= out[2]
    return out[:, keep]


def _joined(pairs, xl, yl):
    """Pairs whose leaves all have one label."""
    run = lambda v: np.append(np.flatnonzero(v[1:] != v[:-1]) + 1, len(v))
    ends_x, ends_y = run(xl), run(yl)
    whole = (ends_x[np.searchsorted(ends_x, pairs[0], "right")] >= pairs[1]) & (ends_y[np.searchsorted(ends_y, pairs[2], "right")] >= pairs[3])
    return whole & (xl[pairs[0]] == yl[pairs[2]])


def _compare(x, y, left, right, pairs, label, more, limits, block=1 << 20):
    """Labels after the links among the leaf pairs of ``pairs``."""
    area = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
    cuts = np.searchsorted(np.cumsum(area), np.arange(block, area.sum() + block, block), "left") + 1
    for i, j in zip([0, *cuts], cuts):
        part, size = pairs[:, i:j], area[i:j]
        if not len(size):
            continue
        pair = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        width = (part[3] - part[2])[pair]
        a, b = part[0][pair] + k // width, part[2][pair] + k % width
        d, (half, first, budget, all_bits) = x[a] ^ y[b], limits
        bits = np.bitwise_count(d)
        hit = np.flatnonzero((bits <= budget) & (np.bitwise_count(d >> np.uint64(64 - half)) <= first))
        hit = hit[bits[hit] + np.bitwise_count(more[left[a[hit]]] ^ more[right[b[hit]]]) <= all_bits]
        label = _labels(len(label), left[a[hit]], right[b[hit]], label)
    return label


def _join_trie(depth: int, parts: int, budget: int, most_bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["id", "used"])
        marks, used, ids = group["mark"].to_numpy().view(np.uint64), group["used"].to_numpy(), group["id"].to_numpy()
        order = np.lexsort((marks, used))
        marks, used, ids = marks[order], used[order], ids[order]
        more = group["more"].to_numpy().view(np.uint64)[order] if most_bits else None
        label = trie_join(marks, depth, used, parts, budget, more, most_bits)
        linked = np.flatnonzero(ids[label] != ids)
        return pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    return run


def links(nodes: DataFrame, budget: int = BUDGET, parts: int = PARTS, most_bits: int = 0, trie_size: int = TRIE_SIZE, hot: int = HOT_TRIE) -> DataFrame:
    """Links (a, b) among fingerprints (id, mark[, more]) that connect all that are within the budget.

    The tries are over the bits as they are and with each other part of them first (and, with ``more``, over both
    fingerprints); ``budget // parts``, the errors in the first part, has to be one. A trie is dealt out by its top
    bits: each fingerprint goes to its own subtree and visits those whose prefix differs in one bit and is larger.
    Each task emits links to representatives (fewer than it has rows), not all pairs. A subtree with too many rows
    is dealt out once more in blocks, each pair of blocks to a task.
    """
    assert budget // parts == 1
    depth = min(64 // parts - 2, max(0, math.ceil(math.log2(max(1, nodes.count()) / trie_size))))
    words = ["mark", "more"] if most_bits else ["mark"]
    turn = lambda c, k: F.shiftleft(c, k).bitwiseOR(F.shiftrightunsigned(c, 64 - k)) if k else F.col(c)
    turns = [(turn(w, k * 64 // parts), F.col(words[-1 - i])) for i, w in enumerate(words) for k in range(parts)]
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), mark.alias("mark"), more.alias("more")) for i, (mark, more) in enumerate(turns)])
    rows = nodes.select("id", F.explode(turns).alias("r")).select("id", "r.*")
    prefix = F.shiftrightunsigned("mark", 64 - depth) if depth else F.lit(0).cast("long")
    visits = [F.when(prefix.bitwiseAND(F.lit(1 << i)) == 0, prefix.bitwiseOR(F.lit(1 << i))) for i in range(depth)]
    rows = rows.withColumn("to", F.array(F.struct(prefix.alias("tree"), F.lit(0).alias("used")), *[F.struct(v.cast("long").alias("tree"), F.lit(1).alias("used")) for v in visits]))
    rows = rows.select("turn", "id", "mark", *(["more"] if most_bits else []), F.explode("to").alias("to")).select("*", "to.*").drop("to").where("tree is not null")
    sizes = rows.groupBy("turn", "tree").count().where(F.col("count") > hot)
    sizes = sizes.select("turn", "tree", F.ceil(F.col("count") / hot * 2).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["turn", "tree"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "other", "blocks")
    return rows.groupBy("turn", "tree", "i", "j").applyInPandas(_join_trie(depth, parts, budget, most_bits), "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """Fingerprint, and component of near-duplicates, of each document: doc_id, mark, component_id.

    Equal fingerprints are one node, so groups of copies of any size cost one row each. A text without words
    (also null) has fingerprint zero and is linked like any other. component_id is the smallest doc_id
    reachable; a null doc_id takes part in links but names no component. Repeated rows share their component.
    An empty table gives an empty result; other columns are ignored.
    """
    marked = cut(fingerprints(docs, width).select("doc_id", "mark"))
    nodes = cut(marked.groupBy("mark").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(nodes.select(F.col("mark").alias("id"), "mark")), "a", "b")
    nodes = nodes.join(roots, nodes["mark"] == roots["node"], "left")
    nodes = nodes.select("mark", "doc_id", F.coalesce("root", "mark").alias("root"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return marked.join(nodes.join(least, "root").select("mark", "component_id"), "mark").select("doc_id", "mark", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """(id, proof, keep_id, keep_proof) of each document, tagged as by ``common.tagged``: the one of its group that stays.

    Groups are components of fingerprints of NEAR_WIDTH words that are within NEAR_BUDGET in one of two independent
    fingerprints and within NEAR_BITS in both. The smallest (id, proof) stays. Rows that repeat both are one document.
    """
    marked = cut(fingerprints(docs, NEAR_WIDTH, 2).drop("doc_id").distinct())
    nodes = marked.groupBy("mark", "more").agg(F.min(F.struct("id", "proof")).alias("first"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = links(nodes.select(F.col("node").alias("id"), "mark", "more"), NEAR_BUDGET, NEAR_PARTS, NEAR_BITS)
    roots = components(found, "a", "b").select("node", "root")
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("first").alias("keep"))
    nodes = nodes.join(least, "root").select("mark", "more", "keep")
    out = marked.join(nodes, ["mark", "more"])
    return out.select("id", "proof", F.col("keep.id").alias("keep_id"), F.col("keep.proof").alias("keep_proof"))
