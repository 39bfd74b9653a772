"""Searches, components and interval operators against brute force."""

import random
import time
from collections import deque

from pyspark.sql import functions as F

from repolith.functions import dims
from repolith.operators import builders, graph, metrics
from repolith.operators.lineage import running
from repolith.plans.queries import QUERIES

EDGES = "src string, dst string, certainty string, seq long"


def random_edges(n, nodes, seed):
    r = random.Random(seed)
    return [(f"n{r.randrange(nodes):03d}", f"n{r.randrange(nodes):03d}", r.choice(dims.CERTAINTIES), i) for i in range(n)]


def all_shortest(edges, source, most=10):
    """node -> [(seqs, nodes, weakest rank)] of all shortest paths, in breadth-first order."""
    out, level, depth = {source: [((), (source,), 4)]}, {source: [((), (source,), 4)]}, 0
    by = {}
    for a, b, c, s in edges:
        by.setdefault(a, []).append((s, b, dims.CERTAINTIES.index(c)))
    while level and depth < most:
        after = {}
        for node, paths in level.items():
            for seqs, nodes, rank in paths:
                for s, b, c in sorted(by.get(node, [])):
                    if b not in out:
                        after.setdefault(b, []).append(((*seqs, s), (*nodes, b), min(rank, c)))
        out |= {b: sorted(p) for b, p in after.items()}
        level, depth = after, depth + 1
    return out


def test_labels_first_paths_and_path_graph(spark):
    rows = random_edges(160, 40, 2)
    e, sources = spark.createDataFrame(rows, EDGES), [f"n{i:03d}" for i in range(12)]
    want = {s: all_shortest(rows, s, 6) for s in sources}
    ids = spark.createDataFrame([(s,) for s in sources], "id string")
    got = {(r["source"], r["node"]): r for r in graph.labels(e, ids, 6).collect()}
    assert set(got) == {(s, n) for s in sources for n in want[s]}
    for (s, n), r in got.items():
        paths = want[s][n]
        assert (r["depth"], int(r["paths"])) == (len(paths[0][0]), len(paths))
        assert (r["strongest"], r["weakest"]) == (max(p[2] for p in paths), min(p[2] for p in paths))
        assert (tuple(r["first"]["seqs"]), r["first"]["rank"]) == (paths[0][0], paths[0][2])
    plain = graph.labels(e, ids, 6, first=False).where("first is not null").count()
    assert plain == 0
    targets = [f"n{i:03d}" for i in range(20, 40)]
    first = graph.first_paths(e, ids, spark.createDataFrame([(t,) for t in targets], "id string"), 6).collect()
    assert {(r["source"], r["target"]): (tuple(r["seqs"]), tuple(r["nodes"])) for r in first} == {(s, t): want[s][t][0][:2] for s in sources for t in targets if t in want[s]}
    pairs = [(s, t) for s in sources for t in targets]
    asked = spark.createDataFrame(pairs, "source string, target string")
    written = graph.shortest_paths(e, asked, 6).collect()
    assert sorted((r["source"], tuple(r["seqs"])) for r in written) == sorted((s, p[0]) for s, t in pairs for p in want[s].get(t, []))
    used = {(r["source"], r["target"], r["seq"]) for r in graph.path_graph(e, asked, 6).collect()}
    assert used == {(s, t, q) for s, t in pairs for p in want[s].get(t, []) for q in p[0]}
    through = graph.paths_between(e, ids, spark.createDataFrame([(t,) for t in targets], "id string"), 6)
    assert through.count() == len(written)


def test_dense_layers_are_counted_not_written(spark):
    rows = [("s", f"0.{j}") for j in range(6)] + [(f"{i}.{j}", f"{i + 1}.{k}") for i in range(6) for j in range(6) for k in range(6)] + [(f"6.{j}", "t") for j in range(6)]
    e = spark.createDataFrame([(a, b, "direct", i) for i, (a, b) in enumerate(rows)], EDGES)
    found = graph.labels(e, spark.createDataFrame([("s",)], "id string"))
    assert found.count() == 44
    assert found.where("node = 't'").select("depth", F.col("paths").cast("long")).collect() == [(8, 6**7)]
    pair = spark.createDataFrame([("s", "t")], "source string, target string")
    assert graph.path_graph(e, pair).count() == len(rows)


def brute_components(rows):
    reach = {}
    for a in {x for r in rows for x in r[:2]}:
        seen, queue = set(), deque([a])
        while queue:
            x = queue.popleft()
            for s, d, *_ in rows:
                if s == x and d not in seen:
                    seen.add(d)
                    queue.append(d)
        reach[a] = seen
    groups = {a: min([b for b in reach if b in reach[a] and a in reach[b]] + [a]) for a in reach}
    sizes = list(groups.values())
    return {a: g for a, g in groups.items() if sizes.count(g) > 1}


def test_strong_components_and_cycles(spark):
    r = random.Random(4)
    rows = [(f"r{k}.{i}", f"r{k}.{(i + 1) % 4}", "direct", 0) for k in range(3) for i in range(4)]  # rings
    rows += [(f"r{k}.0", f"r{k + 1}.3", "direct", 0) for k in range(2)]  # joined by bridges
    rows += [(f"r{r.randrange(3)}.{r.randrange(4)}", f"x{r.randrange(8)}", "direct", 0) for _ in range(8)]
    rows += [(f"x{i}", f"x{i + r.randrange(1, 4)}", "direct", 0) for i in range(8)] + [("x3", "x3", "direct", 0), ("r0.2", "r0.0", "direct", 0)]
    rows = [(a, b, c, i) for i, (a, b, c, _) in enumerate(dict.fromkeys(rows))]
    e = spark.createDataFrame(rows, EDGES)
    assert {x["node"]: x["component"] for x in graph.strong_components(e).collect()} == brute_components(rows)
    assert graph.strong_components(e, most_rounds=1) is None
    want = {}
    for a, b, _, s in rows:
        back = [("", (a,))] if a == b else [(p[0][0], p[0][1]) for p in [all_shortest(rows, b).get(a)] if p]
        for _, nodes in back:
            cycle = (a,) if a == b else (a, *nodes[:-1])
            want.setdefault("|".join(sorted(set(cycle))), (cycle, s))
    for few in (0, 10**6):
        assert {x["key"]: (tuple(x["nodes"]), x["seq"]) for x in graph.cycles(e, few_edges=few).collect()} == want


def test_running_over_ranges(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 50}", i, r.randrange(9), None if i % 4 else f"v{i}") for i in range(3000)] + [(None, 5000 + i, 1, None) for i in range(20)]
    got = running(spark.createDataFrame(rows, "k string, at int, n int, v string"), ["k"], ["at"], {"total": F.col("n")}, {"latest": F.col("v")}).where("k is not null").collect()
    want = {}
    for k, at, n, v in sorted((x for x in rows if x[0]), key=lambda x: (x[0], x[1])):
        total, latest = want.get((k, "now"), (0, None))
        want[(k, "now")] = want[(k, at)] = (total + n, v or latest)
    assert {(x["k"], x["at"]): (x["total"], x["latest"]) for x in got} == {q: v for q, v in want.items() if q[1] != "now"}


def spans_of(r, n, deep, least=0, most=10**6):
    """Nested spans as code has them, some equal."""
    out = []
    cuts = sorted(r.sample(range(least, most), min(2 * n, most - least)))
    for a, b in zip(cuts[::2], cuts[1::2]):
        out += [(a, b)] * (2 if r.random() < 0.1 else 1)
        if deep and b - a > 20:
            out += spans_of(r, r.randrange(0, 4), deep - 1, a, b)
    return out


def test_parents_and_metrics(spark):
    r = random.Random(8)
    spans = [("m", a, b) for a, b in spans_of(r, 60, 4)] + [("n", 0, 10), ("n", 10, 20), ("n", 10, 10), ("n", 12, 20), ("n", 12, 12), ("o", 1, 1)]
    frame = spark.createDataFrame([(f"f{i}", *s, 0, 5, i) for i, s in enumerate(spans)], "id string, module_id string, start int, end int, start_line int, end_line int, seq long")

    def above(m, a, b):
        held = {(x, y) for k, x, y in spans if k == m and x <= a and y >= b and (x, y) != (a, b) and not (a == b == y)}
        return min(held, key=lambda s: (s[1] - s[0], -s[0]), default=None), len(held) + 1

    got = {(x["module_id"], x["start"], x["end"]): (x["parent"] and tuple(x["parent"]), x["depth"], x["n"]) for x in metrics.parents(frame, "module_id").collect()}
    assert got == {s: (*above(*s), spans.count(s)) for s in spans}
    nested = {x["id"]: x["nested"] for x in metrics.function_metrics(frame).collect()}
    assert nested == {f"f{i}": sum(above(k, *t)[0] == (a, b) for k, *t in spans if k == m) for i, (m, a, b) in enumerate(spans)}
    big = spark.range(100_000).select((F.col("id") % 2).alias("module_id"), F.col("id").alias("start"), (400_000 - F.col("id")).alias("end"))
    assert metrics.parents(big, "module_id").agg(F.max("depth")).first()[0] == 50_000


def test_holders_and_direct_nesting(spark):
    r = random.Random(3)
    spans = [("hot", r.randrange(60), r.randrange(40)) for _ in range(400)] + [(f"g{i % 20}", r.randrange(9), r.randrange(9)) for i in range(60)]
    spans = [(g, a, a + n) for g, a, n in spans]
    frame = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "id int, owner string, start int, end int")
    inside = lambda x, y: x[0] == y[0] and y[1] >= x[1] and y[2] <= x[2] and x[1:] != y[1:]
    got = {(x["owner"], x["start"], x["end"]): (x["n"], x["holders"]) for x in metrics.holders(frame, "owner").collect()}
    assert got == {s: (spans.count(s), sum(inside(x, s) for x in spans)) for s in spans}
    pairs = {(i, j) for i, x in enumerate(spans) for j, y in enumerate(spans) if inside(x, y)}
    direct = {(i, j) for i, j in pairs if not any((i, k) in pairs and (k, j) in pairs for k in range(len(spans)))}
    assert {(x["outer"], x["inner"]) for x in metrics.direct_nesting(frame, "owner").collect()} == direct
    ring = spark.range(100_000).select(F.lit("o").alias("owner"), F.col("id").alias("start"), (400_000 - F.col("id")).alias("end"))
    assert metrics.holders(ring, "owner").agg(F.sum(F.col("n") * F.col("holders"))).first()[0] == 100_000 * 99_999 // 2


def test_callbacks_by_bins(spark):
    r = random.Random(5)
    sites = [(i, "hot" if i % 2 else f"m{i % 7}", a := r.randrange(5000), a + r.choice([0, 3, 60, 700])) for i in range(150)] + [(900, "hot", None, 5)]
    inner = [(f"f{i}", "hot" if i % 2 else f"m{i % 7}", a := r.randrange(5000), a + r.choice([0, 1, 20, 300]), i) for i in range(300)] + [("same", sites[1][1], sites[1][2], sites[1][3], 999)]
    got = builders.callbacks(spark.createDataFrame(sites, "site int, module_id string, start int, end int"), spark.createDataFrame(inner, "id string, module_id string, start int, end int, seq long"))
    want = {(s, f) for s, m, a, b in sites if a is not None for f, k, x, y, _ in inner if k == m and x >= a and y <= b and (x > a or y < b)}
    found = [(x["site"], x["callback"]) for x in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_paths_over_shared_keys_are_those_over_pairs(spark):
    """Counts of several rounds and components, more sources than a word has bits, nulls and repeated rows."""
    r = random.Random(21)
    held = [(k, node) for k in range(150) for node in r.sample(range(-40, 60), r.choice((1, 2, 3)))]
    held += [(1000 + k, 200 + k + i) for k in range(14) for i in (0, 1)] + [(None, 5), (3, None), *held[:9]]
    own = spark.createDataFrame(held, "key long, node long")
    sources = spark.createDataFrame([(i,) for i in [*range(-40, 60), 200, 200, 999, None]], "id long")
    got = [tuple(x) for x in graph.meeting_paths(own, sources).select("source", "node", "depth", F.col("paths").cast("long")).collect()]
    other = own.withColumnRenamed("node", "dst")
    pairs = own.withColumnRenamed("node", "src").join(other, "key").where("src <> dst").select("src", "dst", F.lit(0).alias("seq"), F.lit("direct").alias("certainty")).distinct()
    near = graph.labels(pairs, sources.where("id is not null"), first=False).where("depth > 0")
    assert sorted(got) == sorted(tuple(x) for x in near.select("source", "node", "depth", F.col("paths").cast("long")).collect())
    assert max(x[2] for x in got) == 10 and max(x[3] for x in got) > 3 and (200, 210, 10, 1) in got and not any(x[:2] == (200, 211) for x in got)


def test_supply_paths_makes_no_pairs(spark, tmp_path):
    """One part that 20,000 suppliers ship would be 400 million pairs."""
    spark.range(20_000).selectExpr("id as l_suppkey", "1L as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20_000).selectExpr("id as s_suppkey", "if(id < 3, 7, 8) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.monotonic()
    found = QUERIES["supply_paths"](spark, str(tmp_path))
    assert [tuple(x) for x in found.groupBy("depth", "paths").count().collect()] == [(1, 1, 3 * 19_999)]
    assert time.monotonic() - began < 60
