"""The nine rules. Each takes the entity tables and graphs and returns (findings, evidence).

A rule's rows come from ``_emit``: one finding a row, in the order given, with its positional id. ``diagnostics`` tells
what a scan of a context leaves out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import dims
from repolith.functions.columns import by_name, is_relative, place, round_half_up
from repolith.operators import metrics
from repolith.operators.builders import import_bindings, resolve_imports
from repolith.operators.graph import cycles
from repolith.operators.lineage import cut, numbered

MAX_COMPLEXITY, LEAST_MI, MAX_PARAMETERS, MAX_BYTES, MAX_EXPORTS, LEAST_LINES = 10, 65.0, 5, 20_000, 15, 3


#: What a finding of each category means, and what to do about it.
ADVICE = {
    "architecture": ("Modules depend on each other in a way that the project cannot honour.", "Change the imports so that every one has a target and none leads back."),
    "quality": ("Code that is hard to read, to test or to change.", "Split, remove or simplify it."),
    "security": ("Data from outside reaches a place that trusts it.", "Check it or bind it as a parameter before it gets there."),
    "secrets": ("A text looks like a credential.", "Revoke it and keep it outside the repository."),
}


@dataclass
class Context:
    """Entity tables by name, and graphs by name as (nodes, edges)."""

    tables: dict[str, DataFrame]
    graphs: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def has(self, *names: str) -> bool:
        return all(n in self.tables or n in self.graphs for n in names)


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    needs: tuple[str, ...]
    run: object

    def supports(self, ctx: Context) -> bool:
        return ctx.has(*self.needs)


def _emit(rows: DataFrame, rule: str, category: str, severity, confidence, title: Column, path, order: list, evidence: list[Column] | Column, cwe=None, owasp=None, status="detected", locations: Column | None = None) -> tuple[DataFrame, DataFrame]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rule_id = lit(rule)
    facts = (F.array(*evidence) if isinstance(evidence, list) else evidence).cast("array<string>")
    located = F.filter(F.array(place(lit(path).cast("string"))), lambda p: p["path"].isNotNull()) if locations is None else locations
    columns = {"_at": located, "_e": facts, "_title": title, "_path": lit(path).cast("string"), "_rule": rule_id, "_severity": lit(severity), "_confidence": lit(confidence).cast("double")}
    rows = numbered(rows.withColumns(columns), *order).withColumn("id", F.concat("_rule", F.lit("-"), F.col("seq").cast("string")))
    description, remedy = ADVICE[category]
    ids = F.transform("_e", lambda _, i: F.concat(F.col("id"), F.lit("-e"), i.cast("string")))
    findings = rows.select(
        "id", F.col("_rule").alias("rule_id"), F.lit(category).alias("category"), F.col("_severity").alias("severity"),
        F.col("_confidence").alias("confidence"), F.lit(status).alias("status"), F.col("_title").alias("title"),
        F.lit(description).alias("description"), F.lit(remedy).alias("remediation"),
        F.col("_path").alias("path"), F.col("_at").alias("locations"), ids.alias("evidence_ids"), lit(cwe).cast("string").alias("cwe"),
        lit(owasp).cast("string").alias("owasp"), F.array().cast("array<string>").alias("correlated_ids"), F.col("seq").cast("long").alias("seq"),
    )
    facts = rows.select("id", F.posexplode("_e").alias("n", "summary"))
    facts = facts.select(F.concat("id", F.lit("-e"), F.col("n").cast("string")).alias("id"), "summary", F.col("id").alias("finding_id"))
    return findings, facts


def known(frame: DataFrame, column: str) -> Column:
    return F.col(column) if column in frame.columns else F.lit(None)


def circular_import(ctx: Context):
    """Each import of a cycle is a fact, located at its first binding where the context has imports and modules.

    A cycle of which no import has a location is then not reported. Cycles are as long as searches are deep, at most.
    """
    _, edges = ctx.graphs["module"]
    found = cycles(edges).withColumn("modules", F.transform("nodes", lambda n: F.regexp_replace(n, "^module:", "")))
    name, fact = F.array_join("modules", " -> "), lambda p: F.concat(p["a"], F.lit(" imports "), p["b"])
    after = F.concat(F.slice("modules", 2, F.size("modules")), F.slice("modules", 1, 1))  # one fact for each import, the last leads back
    steps, locations = F.arrays_zip(F.col("modules").alias("a"), after.alias("b")), None
    if ctx.has("imports", "modules"):
        found = cut(found)
        each = found.select("seq", F.posexplode(steps).alias("n", "p")).select("seq", "n", F.col("p.a").alias("src"), F.col("p.b").alias("dst"))
        bound = each.join(import_bindings(ctx.tables["imports"], ctx.tables["modules"]), ["src", "dst"])
        bound = bound.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("n", F.col("src").alias("a"), F.col("dst").alias("b"), "line", "col"))).alias("bound"))
        found, steps, locations = found.join(bound, "seq"), F.col("bound"), F.transform("bound", lambda p: place(p["a"], p["line"], p["col"]))
    return _emit(found, "architecture/circular-import", "architecture", "medium", 0.9, F.concat(F.lit("Import cycle: "), name), F.col("modules")[0], ["seq"], F.transform(steps, fact), locations=locations)


def unresolved_import(ctx: Context):
    asked = resolve_imports(ctx.tables["imports"], ctx.tables["modules"]).where(is_relative(F.col("specifier")) & F.col("target").isNull())
    asked = asked.join(ctx.tables["modules"].select(F.col("id").alias("module_id"), F.col("seq").alias("module_seq")), "module_id")
    title = F.concat(F.col("module_id"), F.lit(" imports what no module provides: "), F.col("specifier"))
    places = F.array(place(F.col("module_id"), known(asked, "line"), known(asked, "col")))
    return _emit(asked, "architecture/unresolved-import", "architecture", "medium", 0.85, title, F.col("module_id"), ["module_seq", "pos"], [title], locations=places)


def unused_export(ctx: Context):
    t, (_, edges) = ctx.tables, ctx.graphs["module"]
    exported = t["symbols"].where("exported").select("module_id")
    exported = exported.union(t["functions"].where("is_exported").select("module_id")).union(t["classes"].where("is_exported").select("module_id"))
    exported = exported.groupBy("module_id").agg(F.count("*").alias("n")).where(~F.col("module_id").rlike(dims.ENTRY_POINT))
    used = edges.where("type = 'IMPORTS'").select(F.regexp_replace("dst", "^module:", "").alias("module_id")).distinct()
    rows = exported.join(used, "module_id", "left_anti").join(t["modules"].select(F.col("id").alias("module_id"), F.col("seq").alias("module_seq")), "module_id")
    title = F.concat(F.lit("No module of this project imports "), F.col("module_id"))
    fact = F.concat(F.col("module_id"), F.lit(" exports "), F.col("n").cast("string"), F.lit(" declarations that nothing imports"))
    return _emit(rows, "quality/unused-export", "quality", "low", 0.35, title, F.col("module_id"), ["module_seq"], [fact])


def complexity(ctx: Context):
    rows = metrics.function_metrics(ctx.tables["functions"]).where(F.col("complexity") > MAX_COMPLEXITY)
    severity = F.when(F.col("complexity") > 2 * MAX_COMPLEXITY, "medium").otherwise("low")
    title = F.concat(F.col("name"), F.lit(" has an estimated complexity of "), F.col("complexity").cast("string"))
    return _emit(rows.drop("seq").withColumn("at", F.col("start")), "quality/cyclomatic-complexity", "quality", severity, 0.45, title, F.col("module_id"), ["module_id", "at"], [title], locations=F.array(place(F.col("module_id"), F.col("start_line"))))


def maintainability(ctx: Context):
    rows = metrics.function_metrics(ctx.tables["functions"]).where(F.col("mi") < LEAST_MI)
    severity = F.when(F.col("mi") < LEAST_MI / 2, "medium").otherwise("low")
    title = F.concat(F.col("name"), F.lit(" has a maintainability index of "), F.col("mi").cast("string"))
    return _emit(rows.drop("seq").withColumn("at", F.col("start")), "quality/maintainability-index", "quality", severity, 0.4, title, F.col("module_id"), ["module_id", "at"], [title], locations=F.array(place(F.col("module_id"), F.col("start_line"))))


def duplication(ctx: Context):
    rows = metrics.with_lines(ctx.tables["functions"]).where(F.col("lines") >= LEAST_LINES)
    types = F.array_join(F.transform("parameters", lambda p: F.coalesce(p["type_text"], F.lit("unknown"))), ",")
    bucket = (round_half_up(F.col("lines") / 5.0) * 5).cast("long").cast("string")
    signature = F.concat_ws("|", "flavor", F.size("parameters").cast("string"), types, F.coalesce("return_type_text", F.lit("unknown")), bucket)
    groups = metrics.structural_duplicates(rows, signature, "module_id", "name", ["seq"])
    title = F.concat(F.lit("Functions of one shape in "), F.col("modules").cast("string"), F.lit(" modules: "), F.array_join("names", ", "))
    return _emit(groups, "quality/duplication", "quality", "low", 0.3, title, None, ["signature"], [F.col("signature")])


def lint(ctx: Context):
    t = ctx.tables
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])
    a = t["functions"].where(F.size("parameters") > MAX_PARAMETERS).select(F.lit(0).alias("part"), F.col("seq").alias("at"), F.col("module_id").alias("path"), text("$name", " takes many parameters").alias("t"), F.lit(0.7).alias("c"), F.col("start_line").cast("int").alias("l"))
    b = t["files"].where(F.col("size_bytes") > MAX_BYTES).select(F.lit(1), F.col("seq"), "path", text("$path", " is large: ", "$size_bytes", " bytes"), F.lit(0.6), F.lit(None).cast("int"))
    n = t["exports"].groupBy("module_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_EXPORTS).join(t["modules"].select(F.col("id").alias("module_id"), "seq"), "module_id")
    c = n.select(F.lit(2), F.col("seq"), "module_id", text("$module_id", " exports ", "$n", " names"), F.lit(0.5), F.lit(None).cast("int"))
    return _emit(a.union(b).union(c), "quality/lint-style-rules", "quality", "low", F.col("c"), F.col("t"), F.col("path"), ["part", "at"], [F.col("t")], locations=F.array(place(F.col("path"), F.col("l"))))


def secrets(ctx: Context):
    """texts: (path, text). Severity is our choice: high; the evidence never quotes the secret.

    One alternation of all patterns, read once over each text, tells which texts have any; only those are searched for
    each pattern.
    """
    either = "|".join(f"(?:{pattern})" for _, _, pattern, _ in dims.SECRET_PATTERNS)
    each = [
        F.struct(F.lit(n).alias("p"), F.lit(ident).alias("rule"), F.lit(name).alias("name"), F.lit(confidence).alias("c"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"))
        for n, (ident, name, pattern, confidence) in enumerate(dims.SECRET_PATTERNS)
    ]
    rows = ctx.tables["texts"].where(F.col("text").rlike(either)).select("path", F.inline(F.array(*each)))
    rows = rows.select("path", "p", "rule", "name", "c", F.posexplode("hits").alias("at", "hit")).drop("hit")
    title = F.concat(F.col("name"), F.lit(" in "), F.col("path"))
    return _emit(rows, F.col("rule"), "secrets", "high", F.col("c"), title, F.col("path"), ["path", "p", "at"], [title], cwe="CWE-798")


def sql_injection(ctx: Context):
    _, edges = ctx.graphs["taint"]
    rows = edges.where("type = 'FLOWS_TO' and data.sink_kind = 'sql'")
    fn = ctx.tables["functions"].select(F.concat(F.lit("function:"), "id").alias("node"), "name", "module_id", known(ctx.tables["functions"], "start_line").cast("int").alias("start_line"))
    side = lambda c, p: fn.select(F.col("node").alias(c), F.col("name").alias(f"{p}_name"), F.col("module_id").alias(f"{p}_path"), F.col("start_line").alias(f"{p}_line"))
    rows = rows.join(side("src", "source"), "src").join(side("dst", "sink"), "dst")
    base = by_name(F.col("certainty"), dims.CERTAINTY_CONFIDENCE)
    clean = F.col("data.sanitized")
    confidence = F.when(clean, F.greatest(F.lit(0.0), base - 0.5)).otherwise(base)
    title = F.concat(F.when(clean, "Sanitized flow").otherwise("Flow"), F.lit(" into a SQL sink: "), F.col("source_name"), F.lit(" -> "), F.col("sink_name"))
    facts = [F.concat(F.lit("source "), F.array_join("data.source_signatures", ", "), F.lit(" in "), F.col("source_name")), F.concat(F.lit("sink "), F.array_join("data.sink_signatures", ", "), F.lit(" in "), F.col("sink_name"))]
    places = F.array(place(F.col("source_path"), F.col("source_line")), place(F.col("sink_path"), F.col("sink_line")))
    return _emit(rows, "security/sql-injection", "security", F.when(clean, "low").otherwise("critical"), confidence, title, F.col("sink_path"), ["seq"], facts, cwe="CWE-89", owasp="A03:2021", locations=places)


RULES = [
    Rule("architecture/circular-import", "architecture", ("module",), circular_import),
    Rule("architecture/unresolved-import", "architecture", ("imports", "modules"), unresolved_import),
    Rule("quality/unused-export", "quality", ("module", "symbols", "functions", "classes", "modules"), unused_export),
    Rule("secrets/pattern-scan", "secrets", ("texts",), secrets),
    Rule("quality/cyclomatic-complexity", "quality", ("functions",), complexity),
    Rule("quality/duplication", "quality", ("functions",), duplication),
    Rule("quality/maintainability-index", "quality", ("functions",), maintainability),
    Rule("quality/lint-style-rules", "quality", ("functions", "files", "exports", "modules"), lint),
    Rule("security/sql-injection", "security", ("taint", "functions"), sql_injection),
]


def diagnostics(ctx: Context, chosen: list[Rule]) -> DataFrame | None:
    """(code, severity, message, source): rules without their tables, and the reach of the SQL rule; None without a table."""
    frames = [*ctx.tables.values(), *(edges for _, edges in ctx.graphs.values())]
    if not frames:
        return None
    rows = [("RULE_UNSUPPORTED", "info", f"{r.id} needs {', '.join(n for n in r.needs if not ctx.has(n))}", r.id) for r in chosen if not r.supports(ctx)]
    rows += [("SCAN_SCOPE", "info", "flows are followed between functions along calls, not through values", r.id) for r in chosen if r.run is sql_injection and r.supports(ctx)]
    return frames[0].sparkSession.createDataFrame(rows, "code string, severity string, message string, source string")
