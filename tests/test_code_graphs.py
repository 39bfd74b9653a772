"""Builders and rules over entity rows modelled on small repositories."""

import json
import threading
import time
from pathlib import Path

import pytest

from pyspark.sql import functions as F
from repolith.operators.lineage import numbered
from repolith.operators import metrics
from repolith.operators import builders, graph
from repolith.plans.engine import Engine, Registry, ScanCancelled
from repolith.plans.queries import QUERIES
from repolith.plans.rules import RULES, Context, Rule
from repolith.sources import sinks

IMPORTS = "module_id string, pos int, specifier string, kind string, imported_name string, local_name string"
FUNCTIONS = (
    "id string, module_id string, owner_class_id string, name string, flavor string, "
    "parameters array<struct<name string, type_text string>>, return_type_text string, is_exported boolean, "
    "start int, end int, start_line int, end_line int, seq long"
)
CLASSES = "id string, symbol_id string, module_id string, name string, is_exported boolean, extends_symbol_id string, implements_symbol_ids array<string>, seq long"
SITES = (
    "function_id string, site_pos int, callee_kind string, callee_name string, receiver_text string, "
    "call_apply_bind_kind string, is_new boolean, has_function_argument boolean, start int, end int, path string, line int, col int"
)


def modules(spark, *paths):
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "id string, seq long")


def imports(spark, *rows):
    return spark.createDataFrame([(m, i, s, k, n, ln) for i, (m, s, k, n, ln) in enumerate(rows)], IMPORTS)


def functions(spark, *rows):
    out = []
    for i, (ident, module, owner, start, end) in enumerate(rows):
        name = ident.split(".")[-1]
        out.append((ident, module, owner, name, "function", [("a", "number")], None, False, start, end, start // 10, end // 10, i))
    return spark.createDataFrame(out, FUNCTIONS)


def sites(spark, *rows):
    out = []
    for i, (fn, kind, name, recv, start, end, *flags) in enumerate(rows):
        out.append((fn, i, kind, name, recv, "call" if kind == "call-apply-bind" else None, "new" in flags, "callback" in flags, start, end, "p", i, 0))
    return spark.createDataFrame(out, SITES)


def test_import_resolution(spark):
    m = modules(spark, "main.ts", "math.ts", "utils/index.ts", "pkg/index.ts", "pkg/user.ts", "pkg/nested/child.ts", "c/main.js", "c/helper.js")
    asked = [
        ("main.ts", "./math.js", "math.ts"), ("main.ts", "./utils", "utils/index.ts"), ("main.ts", "left-pad", None),
        ("main.ts", "./does-not-exist.js", None), ("pkg/user.ts", ".", "pkg/index.ts"), ("pkg/nested/child.ts", "..", "pkg/index.ts"),
        ("c/main.js", "./helper.js", "c/helper.js"), ("pkg/user.ts", "../math", "math.ts"), ("main.ts", "./math", "math.ts"),
    ]
    found = builders.resolve_imports(imports(spark, *[(a, s, "named", None, None) for a, s, _ in asked]), m).orderBy("pos").collect()
    assert [r["target"] for r in found] == [t for _, _, t in asked]


def edges(spark, *pairs):
    return spark.createDataFrame([(f"E:{a}->{b}", "IMPORTS", a, b, "resolved", i) for i, (a, b) in enumerate(pairs)], "id string, type string, src string, dst string, certainty string, seq long")


def paths(spark, e, a, b, **kw):
    pairs = spark.createDataFrame([(a, b)], "source string, target string")
    return sorted("".join(r["nodes"]) for r in graph.shortest_paths(e, pairs, **kw).collect())


def test_paths_and_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "e"), ("e", "f"), ("f", "d"), ("d", "a"), ("x", "x"))
    assert paths(spark, e, "a", "d") == ["abd", "acd"]
    assert paths(spark, e, "a", "a") == ["a"]
    assert paths(spark, e, "a", "d", max_depth=1) == [] and paths(spark, e, "a", "nowhere") == []
    got = {r["key"]: "".join(r["nodes"]) for r in graph.cycles(e).collect()}
    assert got == {"a|b|d": "abd", "a|c|d": "acd", "a|d|e|f": "aefd", "x": "x"}
    pairs = spark.createDataFrame([("a", "d")], "source string, target string")
    assert "".join(graph.first_paths(e, pairs.select(F.col("source").alias("id")), pairs.select(F.col("target").alias("id"))).first()["nodes"]) == "abd"


def test_dense_graph_terminates(spark):
    pairs = [("s", f"0.{j}") for j in range(6)] + [(f"{i}.{j}", f"{i + 1}.{k}") for i in range(6) for j in range(6) for k in range(6)]
    assert paths(spark, edges(spark, *pairs), "s", "unreachable") == []


def calls(spark, m, i, f, c, s):
    _, e = builders.call_graph(m, i, f, c, s)
    return sorted((r["src"].split(":", 1)[1], r["dst"], r["certainty"]) for r in e.collect())


def test_call_resolution(spark):
    m = modules(spark, "a.ts", "b.ts")
    i = imports(spark, ("a.ts", "./b.js", "named", "far", "far"), ("a.ts", "./b.js", "named", "Base", "Base"))
    f = functions(spark, ("main", "a.ts", None, 0, 900), ("near", "a.ts", None, 1000, 1100), ("far", "b.ts", None, 0, 50), ("K.m", "a.ts", "K", 2000, 2100),
                  ("K.n", "a.ts", "K", 2100, 2200), ("P.p", "a.ts", "P", 3000, 3100), ("cb", "a.ts", None, 505, 520))
    c = spark.createDataFrame([("K", "sK", "a.ts", "K", False, "sP", [], 0), ("P", "sP", "a.ts", "P", False, None, [], 1)], CLASSES)
    s = sites(
        spark, ("main", "identifier", "near", None, 1, 2), ("main", "identifier", "far", None, 3, 4), ("main", "identifier", "external", None, 5, 6),
        ("main", "computed-member", None, "obj", 7, 8), ("main", "call-apply-bind", "call", "near", 9, 10), ("main", "member", "map", "items", 500, 530, "callback"),
        ("K.m", "member", "n", "this", 2001, 2002), ("K.m", "member", "p", "this", 2003, 2004), ("K.m", "member", "nope", "this", 2005, 2006), ("main", "identifier", "K", None, 11, 12, "new"),
    )
    got = calls(spark, m, i, f, c, s)
    assert got == sorted([
        ("main", "function:near", "direct"), ("main", "function:far", "resolved"), ("main", "call-site:main:p:3:0", "dynamic"),
        ("main", "call-site:main:p:5:0", "unknown"), ("main", "function:cb", "unknown"), ("K.m", "function:K.n", "direct"),
        ("K.m", "function:P.p", "inferred"), ("K.m", "symbol:sP", "unknown"), ("main", "class:K", "direct"),
    ])
    nodes, e = builders.call_graph(m, i, f, c, s)
    assert graph.dangling(nodes, e).count() == 0


def flows(spark, f, s):
    m = modules(spark, "a.ts")
    i = imports(spark).limit(0)
    _, e = builders.call_graph(m, i, f, spark.createDataFrame([], CLASSES), s)
    _, t = builders.taint_graph(f, s, e)
    return t


def test_taint(spark):
    f = functions(spark, ("h", "a.ts", None, 0, 100), ("q", "a.ts", None, 200, 300), ("clean", "a.ts", None, 400, 500))
    read = ("h", "member", "toString", "req.query.id", 20, 30)
    direct = flows(spark, f, sites(spark, read, ("h", "member", "query", "db", 40, 50))).collect()
    assert [(r["src"], r["dst"], r["certainty"], r["data"]["sink_kind"], r["data"]["sanitized"]) for r in direct] == [("function:h", "function:h", "direct", "sql", False)]
    wrapped = flows(spark, f, sites(spark, read, ("h", "identifier", "parseInt", None, 10, 35), ("h", "member", "query", "db", 40, 50))).first()
    assert wrapped["data"]["sanitized"]
    before = flows(spark, f, sites(spark, ("h", "identifier", "parseInt", None, 1, 5), read, ("h", "member", "query", "db", 40, 50))).first()
    assert not before["data"]["sanitized"]
    across = flows(spark, f, sites(spark, read, ("h", "identifier", "clean", None, 51, 60), ("clean", "identifier", "q", None, 401, 402), ("clean", "member", "escape", "mysql", 403, 404), ("q", "member", "query", "pool", 210, 220))).collect()
    assert [(r["src"], r["dst"], r["data"]["sanitized"]) for r in across] == [("function:h", "function:q", True)]
    assert flows(spark, f, sites(spark, ("h", "member", "query", "db", 40, 50), ("h", "member", "log", "console", 60, 70))).count() == 0


@pytest.fixture(scope="module")
def ctx(spark):
    m = modules(spark, "a.ts", "b.ts", "lib.ts", "index.ts")
    i = imports(spark, ("a.ts", "./b.js", "named", "x", "x"), ("b.ts", "./a.js", "named", "y", "y"), ("a.ts", "./does-not-exist.js", "named", None, None), ("a.ts", "react", "named", None, None))
    rows = [
        ("big", "a.ts", None, "big", "function", [(c, None) for c in "abcdef"], None, False, 0, 9000, 0, 119, 0),
        ("d1", "a.ts", None, "d1", "function", [("a", "number")], "number", False, 9100, 9200, 130, 133, 1),
        ("d2", "b.ts", None, "d2", "function", [("b", "number")], "number", False, 0, 90, 0, 3, 2),
        ("used", "lib.ts", None, "used", "function", [], None, True, 0, 10, 0, 0, 3),
        ("entry", "index.ts", None, "entry", "function", [], None, True, 0, 10, 0, 0, 4),
    ]
    f = spark.createDataFrame(rows, FUNCTIONS)
    c = spark.createDataFrame([], CLASSES)
    s = sites(spark, ("d1", "member", "toString", "req.query.id", 9110, 9120), ("d1", "member", "query", "db", 9130, 9140))
    symbols = spark.createDataFrame([], "id string, module_id string, exported boolean, seq long")
    files = spark.createDataFrame([("a.ts", 25_000, 0), ("b.ts", 10, 1)], "path string, size_bytes long, seq long")
    exports = spark.createDataFrame([("lib.ts",)] * 16, "module_id string")
    texts = spark.createDataFrame([("s.ts", "k = 'AKIA" + "A1" * 8 + "'; t = 'ghp_" + "a" * 36 + "'"), ("ok.ts", "AKIA123 ghp_short sk_test_" + "a" * 30)], "path string, text string")
    tables = {"modules": m, "imports": i, "functions": f, "classes": c, "symbols": symbols, "files": files, "exports": exports, "texts": texts}
    _, e = call = builders.call_graph(m, i, f, c, s)
    return Context(tables, {"module": builders.module_graph(m, i), "call": call, "taint": builders.taint_graph(f, s, e)})


def test_rules_and_engine(spark, ctx, tmp_path):
    seen = []
    result = Engine(listeners=[lambda kind, data: seen.append(kind)]).scan(ctx, profile="full")
    found = {}
    for r in result.findings.collect():
        found.setdefault(r["rule_id"], []).append(r)
    assert {k: len(v) for k, v in found.items()} == {
        "architecture/circular-import": 1, "architecture/unresolved-import": 1, "quality/unused-export": 1,
        "quality/cyclomatic-complexity": 1, "quality/maintainability-index": 1, "quality/duplication": 1,
        "quality/lint-style-rules": 3, "secrets/aws-access-key-id": 1, "secrets/github-token": 1, "security/sql-injection": 1,
    }
    sql = found["security/sql-injection"][0]
    assert (sql["severity"], sql["confidence"], sql["cwe"], sql["owasp"], len(sql["evidence_ids"])) == ("critical", 0.85, "CWE-89", "A03:2021", 2)
    assert found["quality/unused-export"][0]["path"] == "lib.ts" and result.analyzers_run == [r.id for r in RULES]
    assert seen[0] == "scan:started" and seen[-1] == "scan:completed"
    ids = {e for r in result.findings.collect() for e in r["evidence_ids"]}
    assert ids == {r["id"] for r in result.evidence.collect()}
    total = {(r["severity"], r["category"]): r["n"] for r in result.summary.collect()}
    assert total[(None, None)] == sum(map(len, found.values()))
    whole = lambda lines: "\n".join(r["value"] for r in lines.orderBy("part", "at").collect())
    sarif = json.loads(whole(sinks.to_sarif(result.findings)))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == total[(None, None)]
    document = json.loads(whole(sinks.to_json(result.findings, result.evidence)))
    assert document["summary"]["findingsBySeverity"]["critical"] == 1 and len(document["findings"]) == total[(None, None)] == document["summary"]["totalFindings"]
    assert all(f["description"] and f["remediation"] for f in document["findings"])
    sinks.write(sinks.to_json(result.findings, result.evidence), str(tmp_path / "report"))
    assert {r["id"] for r in sinks.read_findings(spark, str(tmp_path / "report")).collect()} == {f["id"] for f in document["findings"]}
    none = result.findings.where("false")
    assert json.loads(whole(sinks.to_json(none, result.evidence.where("false"))))["findings"] == []
    cycle = found["architecture/circular-import"][0]
    assert len(cycle["evidence_ids"]) == cycle["title"].count(" -> ") + 1
    assert [r["code"] for r in result.diagnostics.collect()] == ["SCAN_SCOPE"]
    page = whole(sinks.to_html(result.findings, result.evidence))
    assert 'data-group="rule_id"' in page
    assert "&#39;" in sinks.escape("'") and page.startswith("<!doctype html>") and "SQL sink" in page
    assert sinks.search(result.findings, "LIB.TS", severity="low").count() == 2


def test_profiles_ids_and_cancelling(spark, ctx):
    registry = Registry()
    assert {r.category for r in registry.chosen("minimal")} == {"architecture"}
    assert {r.category for r in registry.chosen("security")} == {"security", "secrets"}
    assert [r.id for r in registry.chosen("minimal", ["security/sql-injection", "unknown"])] == ["security/sql-injection"]
    few = Engine().scan(Context({"texts": ctx.tables["texts"]}), "full")
    assert few.analyzers_run == ["secrets/pattern-scan"]
    engine = Engine()
    engine.cancelled.set()
    with pytest.raises(ScanCancelled):
        engine.scan(ctx)


def test_cancelling_a_running_job(spark, ctx):
    """A job that would run for hours is stopped, by another thread and by the timeout; the session goes on."""

    def endless(ctx):
        ctx.tables["texts"].crossJoin(spark.range(10**11)).agg(F.sum(F.hash("text", "id"))).collect()

    registry = Registry([Rule("slow", "security", ("texts",), endless), *RULES])
    for how in ("thread", "timeout"):
        seen = []
        engine = Engine(registry, [lambda kind, data: seen.append(kind)], timeout=2 if how == "timeout" else None)
        if how == "thread":
            threading.Timer(2, engine.cancel).start()
        began = time.time()
        with pytest.raises(ScanCancelled):
            engine.scan(ctx, ids=["slow", "secrets/pattern-scan"])
        assert time.time() - began < 30 and seen[-1] == "scan:cancelled" and "analyzer:completed" not in seen
    assert Engine(timeout=300).scan(ctx, ids=["secrets/pattern-scan"]).findings.count() == 2


def test_numbered_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit(0).alias("seq")).repartition(7)
    got = numbered(rows, F.col("v").desc()).collect()
    assert len(got) == 5000 and all(r["seq"] == 4999 - r["v"] for r in got)
    assert numbered(rows.where("false"), "v").count() == 0


def test_report_groups_and_maps(spark):
    rows = [("r1", "high", "a", "f1"), ("r1", "low", "a", "f2"), ("r2", "low", "b", None)]
    findings = spark.createDataFrame(rows, "rule_id string, severity string, category string, path string")
    maps = metrics.count_maps(findings).first()
    assert (maps["by_severity"], maps["by_category"], maps["total"]) == ({"high": 1, "low": 2}, {"a": 2, "b": 1}, 3)
    assert [tuple(r) for r in metrics.grouped(findings, "rule_id", "-").collect()] == [("r1", 2, "high"), ("r2", 1, "low")]
    assert [r["group"] for r in metrics.grouped(findings, "path", "(unlocated)").collect()] == ["(unlocated)", "f1", "f2"]


def test_calls_of_methods_shuffle_little(spark, tmp_path):
    """A call is shuffled twice or three times, as numbers, and is not checkpointed."""
    n = 60_000
    spark.range(n).selectExpr("id div 4 as l_orderkey", "int(id % 4) as l_linenumber", "pmod(hash(id), 2000L) as l_partkey", "pmod(hash(id, 1), 100L) as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id as s_suppkey", "id % 25 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p: p.stat().st_size for d in folders for p in d.rglob("shuffle_*.data")}
    before = files()
    QUERIES["member_call_edges"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert sum(size for p, size in files().items() if p not in before) < 150 * n
