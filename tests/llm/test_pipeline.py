import numpy as np

import __spark_entry__
import corpus_pipeline
from repolith.llm import simhash
from repolith.llm.common import cut, table
from repolith.llm.superkmers import mix
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_exact_simhash_mix import brute_targets
from tests.llm.test_lines import brute as brute_lines

SF = "/root/testdata/sf0.001"


def near_groups(texts):
    """The smallest doc_id of each group of near copies, by all pairs of fingerprints."""
    hashes = {i: simhash.shingle_hashes((t or "").encode(), simhash.NEAR_WIDTH) for i, t in texts.items()}
    marks = {i: (simhash.majority(h), simhash.majority(mix(h + np.uint64(1)))) for i, h in hashes.items()}
    root = {i: i for i in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, b) in marks.items():
        for j, (c, d) in marks.items():
            x, y = (a ^ c).bit_count(), (b ^ d).bit_count()
            if j < i and min(x, y) <= simhash.NEAR_BUDGET and x + y <= simhash.NEAR_BITS:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i): find(i) for i in marks}


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    steps = iter(corpus_pipeline.STAGES)

    def step(docs):
        name, f = next(steps)
        out = cut(f(spark, docs, SF))
        return out, out.collect()

    docs, rows = step(docs)  # every language of the table is known, so only text without letters may go
    assert docs.columns == columns
    assert {r["doc_id"] for r in rows} == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}

    pairs = [(r["doc_id"], r["text"]) for r in rows]
    docs, rows = step(docs)
    assert docs.columns == columns
    expected = {i: t for i, t in brute_lines(pairs) if t.split() or t == dict(pairs)[i]}
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(got.keys() ^ expected.keys()) <= 1 and sum(got[i] != expected[i] for i in got.keys() & expected.keys()) <= 2
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != before[r["doc_id"]]["text"])

    first = near_groups({r["doc_id"]: r["text"] for r in rows})
    docs, rows = step(docs)
    assert docs.columns == columns and sorted(r["doc_id"] for r in rows) == sorted(first.values())

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = {i for i, bad, _ in brute_leaks([(r["doc_id"], r["text"]) for r in rows], items) if not bad}
    docs, rows = step(docs)
    assert docs.columns == columns and {r["doc_id"] for r in rows} == clean

    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    targets, longest = brute_targets(sizes), max(len(r["text"].split()) for r in rows)
    mixed, rows = step(docs)
    assert mixed.columns[: len(columns)] == columns
    taken = {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 1 <= r["copies"] <= 3
    assert all(abs(taken.get(s, 0) - t) <= 2 * longest for s, t in targets.items())


def test_run_and_registration(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{n}_" for n in range(1, 14)} == {q[: q.index("_") + 1] for q in queries if q.startswith("op")}
    assert "pipeline" in queries and set(sql) <= set(queries)
    assert queries["pipeline"](spark, SF).count() > 100
