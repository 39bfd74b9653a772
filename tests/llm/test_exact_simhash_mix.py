import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash

from repolith.llm.exact_dedup import collapsed, exact_dedup, packed, pieces, unpacked, width
from repolith.llm.mixing import mix
import corpus_pipeline
from pyspark.sql import functions as F
from repolith.llm import simhash
from repolith.llm.common import components
from repolith.llm.simhash import fingerprint, links, simhash_dedup, trie_join
from tests.llm.data import docs, rows


SF = "/root/testdata/sf0.001"


def test_exact_dedup(spark):
    got = rows(exact_dedup(docs(spark, {1: "a", 2: "a", 3: None, 4: "", 5: "b", None: "b", 7: "x" * 100_000}), fan_in=2), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (None, 5, 2, False), (7, 7, 1, True)], key=repr)


def test_exact_dedup_repeated_rows_and_many_runs(spark):
    frame = docs(spark, [(i % 7, "t%d" % (i % 5)) for i in range(200)] + [(9, "same")] * 3).repartition(13)
    got = exact_dedup(frame, fan_in=3).collect()
    assert len(got) == 203
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
    assert hashlib.sha256(b"same").hexdigest() in by
    assert rows(exact_dedup(docs(spark, {1: "a", 2: "a"}), keep="smallest"), "doc_id", "kept") == [(1, True), (2, False)]
    assert exact_dedup(docs(spark, {})).count() == 0


def test_exact_dedup_in_pieces(spark):
    """Any fan-in and size of pieces, a text that a third of all rows share, and identifiers of any type."""
    pairs = [(i, "hot" if i % 3 == 0 else f"text {i % 211}" if i % 3 == 1 else f"own {i}") for i in range(1500)] + [(None, "hot"), (None, None), (7, "")]
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        want = {t: best(g, key=lambda i: (i is not None, i or 0)) for t, g in groups.items()}
        expected = sorted([(i, want[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs], key=repr)
        for fan_in, piece in ((2, 10), (4, 100), (16, 20_000)):
            got = exact_dedup(docs(spark, pairs).repartition(11), keep=keep, fan_in=fan_in, piece=piece).cache()
            assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == expected
            assert got.where("kept").count() == len(groups) and got.where("kept and not doc_id <=> keep_id").count() == 0
    named = docs(spark, pairs[:90]).selectExpr("concat('d', doc_id) as doc_id", "text", "1 as run", "2 as n")
    got = {r["text_sha256"]: r["keep_id"] for r in exact_dedup(named).collect()}
    assert got[hashlib.sha256(b"hot").hexdigest()] == "d9"


def test_runs_are_sorted_and_merged():
    """Pieces are cut at digests' leading bits; a merge keeps the order and one entry a key."""
    entry = lambda h, i, n=1: ((h * 64, 1, 0), i, i or 0, n)
    assert list(collapsed([entry("0", 1), entry("0", 5, 2), entry("0", None), entry("f", None)], True)) == [entry("0", 5, 4), entry("f", None)]
    assert [e[1] for e in collapsed([entry("0", 1), entry("0", None), entry("f", 2), entry("f", 1)], False)] == [None, 1]
    run = [entry(h, i) for i, h in enumerate("0123789abf")]
    assert [(b, len(p)) for _, b, p in pieces(3, run, 2)] == [(0, 4), (1, 1), (2, 4), (3, 1)]
    assert [(b, len(p)) for _, b, p in pieces(3, run, 0)] == [(0, 10)]
    batches = list(packed(pieces(3, run, 2), pa.int64(), 4))
    assert [e for b in batches for p in b.column("entries") for e in unpacked(p.values)] == run
    assert [width(n, 100) for n in (0, 1, 100, 101, 200, 201, 400, 401)] == [0, 0, 0, 1, 1, 2, 2, 3]


def brute_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = text.translate(table).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ["", " \n", "One", "a B", "a b c", "the cat sat on the mat the cat sat", "É é\x85x\xa0y " * 30, "w " * 9000]:
        assert fingerprint(text.encode()) == brute_fingerprint(text)
    assert fingerprint(None) == 0


def brute_components(values, budget=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near(seed, centres, members, flips):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(members):
            out.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, flips))))
    return sorted(out)


def test_trie_join_against_brute_force():
    for seed, shape in enumerate([(40, 12, 4), (1, 300, 3), (300, 1, 0), (5, 60, 9), (1, 1, 0)]):
        values = near(seed, *shape)
        expected = brute_components(values)
        a = np.array(values, np.uint64)
        turned = np.sort((a << np.uint64(32)) | (a >> np.uint64(32)))
        one, two = trie_join(a, 0, np.zeros(len(a), int)), trie_join(turned, 0, np.zeros(len(a), int))
        back = lambda v: int(v) >> 32 | (int(v) & 0xFFFFFFFF) << 32
        pairs = [(int(a[i]), int(a[j])) for i, j in enumerate(one)] + [(back(turned[i]), back(turned[j])) for i, j in enumerate(two)]
        root = {v: v for v in values}
        for _ in range(len(values)):
            before = dict(root)
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
            if before == root:
                break
        assert root == expected


def test_links_dealt_out(spark):
    values = near(9, 60, 8, 4) + near(10, 1, 200, 3)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from repolith.llm.common import components

    for trie_size, hot in ((16, 10_000), (16, 40)):
        edges = links(spark.createDataFrame([(v, v) for v in set(signed)], "id long, mark long"), trie_size=trie_size, hot=hot)
        got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(edges, "a", "b").collect()}
        groups, expected = {}, {}
        for v, r in brute_components(sorted(set(values))).items():
            expected.setdefault(r, set()).add(v)
        for v in values:
            groups.setdefault(got.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_dedup(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    got = rows(simhash_dedup(docs(spark, {5: text, 3: text.replace("w77 ", "v "), 9: None, 8: "", 1: "other words here now", None: "  "})), "doc_id", "component_id")
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (1, 1), (None, 8)], key=repr)
    assert simhash_dedup(docs(spark, {})).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    r = random.Random(5)
    data = [(i, None if i == 7 else "w " * r.randint(0, 40), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(600)]
    data += [(1000 + i, "tiny", "é") for i in range(3)] + [(2000, "", "zero")]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix(frame).collect()
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    assert len(got) == len(data)
    taken = {}
    for x in got:
        assert x["taken"] == x["copies"] * x["size"] <= 3 * x["size"] and x["source_size"] == sizes[x["source"]]
        assert abs(x["target"] - target[x["source"]]) < 1e-6
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - target[s]) <= 80 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    again = mix(frame.repartition(7)).collect()
    assert rows_of(again) == rows_of(got)
    assert mix(frame.where("false")).count() == 0
    assert [tuple(x) for x in mix(frame.where("doc_id = 2000")).select("size", "target", "taken").collect()] == [(0, 0.0, 0)]


def rows_of(got):
    return sorted((x["doc_id"], x["taken"]) for x in got)


def test_links_of_two_fingerprints(spark):
    """Near copies: within the budget in one of two fingerprints and within all bits in both."""
    r = random.Random(31)
    flip = lambda v, n: v ^ sum(1 << b for b in r.sample(range(64), n))
    nodes = []
    for _ in range(60):
        a, b = r.getrandbits(64), r.getrandbits(64)
        nodes += [(a, b)] + [(flip(a, r.randint(0, 10)), flip(b, r.randint(0, 14))) for _ in range(3)]
    nodes += [(0, 0), (0, (1 << 64) - 1), (0, 7)]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, b) in enumerate(nodes):
        for j, (c, d) in enumerate(nodes[:i]):
            x, y = (a ^ c).bit_count(), (b ^ d).bit_count()
            if min(x, y) <= simhash.NEAR_BUDGET and x + y <= simhash.NEAR_BITS:
                root[max(find(i), find(j))] = min(find(i), find(j))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(nodes)], "id long, mark long, more long")
    for trie_size, hot in ((8192, 100_000), (16, 10_000), (16, 60)):
        edges = simhash.links(frame, simhash.NEAR_BUDGET, simhash.NEAR_PARTS, simhash.NEAR_BITS, trie_size, hot)
        got = {x["node"]: x["root"] for x in components(edges, "a", "b").collect()}
        assert [got.get(i, i) for i in range(len(nodes))] == [find(i) for i in range(len(nodes))]


def test_near_copies_and_mix_of_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(300))
    pairs = [(5, "another text that is not near any"), (5, text), (3, text), (3, text), (9, text.replace("word7 ", "other ")), (None, text), (None, None), (8, ""), (7, "x")]
    frame = docs(spark, pairs).withColumn("_id", F.lit("mine"))
    kept = corpus_pipeline.dedup_near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert rows == sorted([(5, pairs[0][1]), (3, text), (7, "x"), (8, "")], key=repr)
    assert corpus_pipeline.dedup_near_copies(spark, frame.where("false"), "").count() == 0
    clash = frame.withColumnsRenamed({"row": "target"})
    mixed = corpus_pipeline.mix_sources(spark, clash, "")
    assert mixed.columns == [*clash.columns, "_size", "source_size", "_target", "copies", "taken"]
    taken = mixed.collect()
    assert len({(r["doc_id"], r["text"]) for r in taken}) == len(taken) >= 6
    assert corpus_pipeline.mix_sources(spark, clash.where("false"), "").count() == 0
    assert corpus_pipeline.dedup_document_lines(spark, clash, "").columns == clash.columns
    assert corpus_pipeline.decontaminate(spark, clash, SF).columns == clash.columns
    assert corpus_pipeline.identify_language(spark, clash.withColumn("score", F.lit(1)), SF).columns == [*clash.columns, "score"]
