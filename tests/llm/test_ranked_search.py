import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from repolith.llm import ranked_search
from repolith.llm.ranked_search import Queries, search
from tests.llm.data import docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(pairs, items, k=10):
    held = [(i, t) for i, text in pairs if (t := terms(text))]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, own in wanted.items():
        scores = []
        for i, t in held:
            m = 10 + (90 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in own if x in t)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, rng):
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(n)]


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    pairs = corpus(900, rng)
    pairs += [(2000 + i, "the same words in every copy w1 w250") for i in range(400)]  # a group of equal scores
    pairs += [(None, "Éclair w1"), (None, None), (5000, ""), (5001, " .,;- "), (5002, "ÉCLAIR a1b2-c3_d4/éé"), (5003, "w250 " * 200_000), (5002, "éclair again"), (5004, "É" * 300_000)]
    items = [(i, pairs[i * 7][1]) for i in range(20)]
    items += [(100, "same copy W250"), (101, None), (102, ""), (103, "nowhere"), (104, "Éclair c3 d4"), (104, "Éclair w9"), (105, "w0 w1 w2"), (106, "w0"), (None, "w3 w4")]
    frame, bench = docs(spark, pairs).repartition(5), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = search(frame, bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(pairs, items)
    assert search(docs(spark, {}), bench).count() == 0
    assert search(frame, bench.where("false")).count() == 0


def test_segments_and_bounds():
    """Many small segments give what one gives, and most documents are never scored in full."""
    rng = random.Random(4)
    n, n_terms, k = 3000, 200, 10
    rows = [(i, 10 + rng.randrange(200), own, [rng.randrange(1, 5) for _ in own]) for i in range(n) if (own := sorted({int(rng.paretovariate(0.6)) % n_terms for _ in range(rng.randrange(1, 30))}))]
    df = np.bincount([t for r in rows for t in r[2]], minlength=n_terms)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df], np.int64)
    items = [(i, sorted(rng.sample(range(n_terms), 9))) for i in range(30)]
    queries = Queries.of(items, weight)
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["doc_id", "m", "terms", "tfs"])
    want = []
    for i, own in items:
        scores = [(-sum(int(weight[t]) * ((10**9 * tf) // (1000 * tf + 8 * m)) for t, tf in zip(ts, tfs) if t in own), d) for d, m, ts, tfs in rows]
        want += [(i, d, -s) for s, d in sorted(scores)[:k] if s < 0]
    run = ranked_search._search(SimpleNamespace(value=queries), k)
    for size in (10**9, 500):
        ranked_search.SEGMENT, kept = size, ranked_search.SEGMENT
        try:
            got = [tuple(r.values()) for b in run(iter([batch(rows[a : a + 100]) for a in range(0, len(rows), 100)])) for r in b.to_pylist()]
        finally:
            ranked_search.SEGMENT = kept
        assert got == want
    doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    flat = lambda j, kind: np.array([x for r in rows for x in r[j]], kind)
    part = ranked_search.Segment(flat(2, np.int32), doc, flat(3, np.int64), np.array([r[1] for r in rows]), queries, k)
    for pair in queries.pairs:
        assert part.joint[pair] <= part.most[pair[0]] + part.most[pair[1]]
    assert sum(part.joint[p] < part.most[p[0]] + part.most[p[1]] for p in queries.pairs) > len(queries.pairs) // 4
