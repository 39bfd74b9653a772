"""Ranked lexical search over all documents: MaxScore with bounds of term pairs.

Documents are counted once for the queries' terms into a forward table, a row a document. Tasks take the rows of a
partition in segments of bounded size, invert each, and search it for every query; the best of each query goes on to the
next segment as its threshold, and only k rows a query and task leave the task.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm.common import NO_ID, in_python, saved
from repolith.llm.merkle import ascii_folded

#: Terms are maximal runs of anything but ASCII signs, blanks and control characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a segment; terms of the queries that are searched for at once (more queries take more passes).
SEGMENT, QUERY_TERMS = 2_000_000, 1_000_000
#: Bytes of a text whose terms are held at once.
PIECE = 1 << 20
_PARTED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


@dataclass
class Queries:
    """Items by number: their identifiers and groups of terms. A group is a pair of terms or a single one; an item's terms
    are paired by ascending weight. weight: of each term; pairs: the distinct pairs of all items.
    """

    ids: list
    groups: list[list[tuple[int, ...]]]
    weight: np.ndarray
    pairs: list[tuple[int, int]]

    @staticmethod
    def of(items: list[tuple[object, list[int]]], weight: np.ndarray) -> Queries:
        groups = []
        for _, terms in items:
            terms = sorted(terms, key=lambda t: (weight[t], t))
            groups.append([tuple(terms[i : i + 2]) for i in range(0, len(terms), 2)])
        pairs = sorted({g for own in groups for g in own if len(g) == 2})
        return Queries([i for i, _ in items], groups, weight, pairs)


def _counts(shared):
    """(doc_id, n, terms, tfs) of (doc_id, text): the length in terms, and those of the vocabulary with their counts."""

    def run(batches):
        place = shared.value
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for t in batch.column(1):
                data, n, at, found = (t.as_py() or b"").translate(_PARTED), 0, 0, Counter()
                while at < len(data):
                    end = data.find(b" ", at + PIECE)
                    end = len(data) if end < 0 else end
                    words = data[at:end].split()
                    n += len(words)
                    found.update(filter(place.__contains__, words))
                    at = end
                lengths.append(n)
                terms.append([place[w] for w in found])
                tfs.append(list(found.values()))
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return run


class Segment:
    """Inverted lists of some documents, with the greatest impact of each term and of each pair.

    most: a term's greatest impact. joint: of a pair, the most that it can add to a document's score, which is the greatest
    sum over its intersection list, or of a document that has only one of the two. seed: the k-th best impact of a list
    (a term's or a pair's), which the k-th best score reaches at least.
    """

    def __init__(self, terms: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray, queries: Queries, k: int):
        order = np.argsort(terms, kind="stable")
        terms, self.doc, tf = terms[order], doc[order], tf[order]
        self.impact = queries.weight[terms] * ((10**9 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.begin = np.searchsorted(terms, np.arange(len(queries.weight) + 1))
        self.size, self.k = len(m), k
        self.most = np.zeros(len(queries.weight), np.int64)
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.begin[held])
        self.joint: dict[tuple[int, ...], int] = {}
        self.seed: dict[tuple[int, ...], int] = {}
        for pair in queries.pairs:
            both = self.intersection(*pair)
            self.joint[pair] = int(max(self.most[pair[0]], self.most[pair[1]], both.max(initial=0)))
            self.seed[pair] = self.kth(both)
        for t in held.tolist():
            self.seed[(t,)] = self.kth(self.impact[self.begin[t] : self.begin[t + 1]])

    def kth(self, values: np.ndarray) -> int:
        return int(np.partition(values, -self.k)[-self.k]) if len(values) >= self.k else 0

    def listed(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begin[term], self.begin[term + 1])
        return self.doc[part], self.impact[part]

    def impacts(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The term's impact in each of some documents, 0 where it is not."""
        own, impact = self.listed(term)
        if not len(own):
            return np.zeros(len(docs), np.int64)
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, impact[at], 0)

    def intersection(self, a: int, b: int) -> np.ndarray:
        """Sums of impacts of the documents that have both terms."""
        if self.begin[a + 1] - self.begin[a] > self.begin[b + 1] - self.begin[b]:
            a, b = b, a
        docs, impact = self.listed(a)
        other = self.impacts(b, docs)
        return (impact + other)[other > 0]

    def search(self, groups: list[tuple[int, ...]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and scores, that may be among the k best: all of those whose score is at least the k-th best.

        ``least``: the threshold so far. Groups whose bounds together stay below it are not looked through: a document
        that has no other term is out. For the rest of the documents these groups are looked up one by one, the
        largest bound first, while the threshold rises and bounds tell who can not reach it.
        """
        bound = np.array([self.joint[g] if len(g) == 2 else int(self.most[g[0]]) for g in groups], np.int64)
        order = np.argsort(bound, kind="stable")
        groups, bound = [groups[i] for i in order], bound[order]
        reach = np.cumsum(bound)
        least = max([least, *(self.seed.get(x, 0) for g in groups for x in (g, *((t,) for t in g)))])
        first = int(np.searchsorted(reach, least))
        score = np.zeros(self.size, np.int64)
        for g in groups[first:]:
            for t in g:
                docs, impact = self.listed(t)
                score[docs] += impact
        docs = np.flatnonzero(score)
        score = score[docs]
        for i in range(first - 1, -2, -1):
            least = max(least, self.kth(score))
            able = score + (reach[i] if i >= 0 else 0) >= least
            docs, score = docs[able], score[able]
            for t in groups[i] if i >= 0 else ():
                score = score + self.impacts(t, docs)
        return docs, score


def _search(shared, k: int):
    """(item, doc_id, score): the k best documents of a partition for each query. Rows: (doc_id, m, terms, tfs)."""

    def run(batches):
        queries = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2] * len(queries.groups)

        def look(rows: list[pa.RecordBatch]):
            ids, m, terms, tfs = ([b.column(i) for b in rows] for i in range(4))
            number = lambda parts: np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts])
            lengths = np.concatenate([p.value_lengths().to_numpy(zero_copy_only=False) for p in terms])
            ids = number(ids)
            doc = np.repeat(np.arange(len(ids)), lengths)
            part = Segment(number([p.flatten() for p in terms]), doc, number([p.flatten() for p in tfs]), number(m), queries, k)
            for i, groups in enumerate(queries.groups):
                known, scores = best[i]
                docs, score = part.search(groups, int(scores[-1]) if len(scores) == k else 1)
                if len(docs):
                    known, scores = np.append(known, ids[docs]), np.append(scores, score)
                    order = np.lexsort((known, -scores))[:k]
                    best[i] = known[order], scores[order]

        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += len(batch.column(2).flatten())
            if size >= SEGMENT:
                look(rows)
                rows, size = [], 0
        if rows:
            look(rows)
        for i, (ids, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item; rows of one item_id are one item."""
    found = F.regexp_extract_all(ascii_folded(F.col("text")), F.lit(TERM), F.lit(0))
    terms = items.where("text is not null").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(found))).alias("terms"))
    return terms.where("size(terms) > 0")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents for each item, equal scores by ascending doc_id.

    A term's weight w falls with the documents that hold it, a document's measure m grows with its length; a document
    scores the sum of w * (10**9 * tf div (1000 * tf + 8 * m)) over the item's terms, all in integers. Documents of score 0
    are not returned. The statistics are over all documents and whole texts. Items are searched for in blocks of about
    QUERY_TERMS terms, whose terms and weights are broadcast; documents are never shuffled.

    Null texts and texts without terms hold nothing and are not counted; null doc_ids come last among equal scores; rows
    that repeat a doc_id are ranked each; items without terms have no rows; other columns are ignored; an empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    terms = saved(query_terms(items), "items")
    blocks = 1 + (terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        place = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        found = _block(texts, [(r["item_id"], [place[t] for t in r["terms"]]) for r in rows], place, k)
        out = found if out is None else out.union(found)
    numbers = spark.createDataFrame([], "item_id long, doc_id long, score long") if out is None else out
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = numbers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kind = items.schema["item_id"].dataType
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def _block(texts: DataFrame, items: list[tuple[object, list[int]]], place: dict[str, int], k: int) -> DataFrame:
    """(item_id, doc_id, score) of the k best of each partition of the documents."""
    spark = texts.sparkSession
    words = spark.sparkContext.broadcast({t.encode(): i for t, i in place.items()})
    forward = saved(in_python(texts, _counts(words), "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0"), "forward")
    total = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    held = forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a row a query term
    weight = np.zeros(len(place), np.int64)
    for r in held:
        weight[r["t"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1)))
    queries = Queries.of([(n, own) for n, (_, own) in enumerate(items)], weight)
    m = F.expr(f"cast(10 + (cast(n as decimal(18,0)) * {90 * total['docs']}BD) div {total['terms'] or 1}BD as long)")
    rows = forward.where("size(terms) > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), m.alias("m"), "terms", "tfs")
    found = in_python(rows, _search(spark.sparkContext.broadcast(queries), k), "item int, doc_id long, score long")
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
