"""Exporters of a scan as lines in order: JSON, SARIF 2.1.0 and HTML. ``write`` stores them as text, in parts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import dims
from repolith.functions.columns import by_name, place, severity_ordinal
from repolith.operators import metrics
from repolith.operators.lineage import numbered


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, title): of the first finding of each rule."""
    return findings.groupBy("rule_id").agg(F.min_by("title", "seq").alias("title"))


def sarif_results(findings: DataFrame) -> DataFrame:
    places = F.col("locations") if "locations" in findings.columns else F.filter(F.array(place(F.col("path"))), lambda p: p["path"].isNotNull())
    return findings.select("id", "rule_id", "title", "path", by_name(F.col("severity"), dims.SARIF_LEVEL).alias("level"), places.alias("locations"), "seq")


def sarif_result(results: DataFrame) -> Column:
    """The JSON of a row of ``sarif_results``. Regions count lines and columns from 1; places without a line have none."""
    region = lambda p: F.when(p["line"].isNotNull(), F.struct((p["line"] + 1).alias("startLine"), (p["col"] + 1).alias("startColumn")))
    physical = lambda p: F.struct(F.struct(F.struct(p["path"].alias("uri")).alias("artifactLocation"), region(p).alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("title").alias("text")).alias("message"), F.transform("locations", physical).alias("locations")))


def _listed(rows: DataFrame, part: int, order: list, value: Column, comma: bool = True) -> DataFrame:
    """(part, at, value): one line a row in the given order, with a comma before all but the first."""
    rows = numbered(rows.select(value.alias("value"), *[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]), *[f"o{i}" for i in range(len(order))])
    line = F.when(F.col("seq") > 0, F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")) if comma else F.col("value")
    return rows.select(F.lit(part).alias("part"), F.col("seq").alias("at"), line.alias("value"))


def _one(frame: DataFrame, part: int, text: str) -> DataFrame:
    return frame.sparkSession.createDataFrame([(part, 0, text)], "part int, at long, value string")


def to_json(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The lines, (part, at, value), of one JSON document with all findings, evidence and the summary."""
    maps = metrics.count_maps(findings).select(F.struct(F.col("total").alias("totalFindings"), F.col("by_severity").alias("findingsBySeverity"), F.col("by_category").alias("findingsByCategory")).alias("s"))
    out = _one(findings, 0, '{"schemaVersion": "0.1.0", "findings": [').union(_listed(findings, 1, ["rule_id", "seq"], F.to_json(F.struct(*findings.columns))))
    out = out.union(_one(findings, 2, '], "evidence": [')).union(_listed(evidence, 3, ["id"], F.to_json(F.struct(*evidence.columns))))
    return out.union(maps.select(F.lit(4), F.lit(0).cast("long"), F.concat(F.lit('], "summary": '), F.to_json("s"), F.lit("}"))))


def to_sarif(findings: DataFrame, tool: str = "repolith") -> DataFrame:
    """The lines, (part, at, value), of one SARIF document."""
    head = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}
    results = sarif_results(findings)
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription")))
    out = _one(findings, 0, json.dumps(head)[:-1] + f', "runs": [{{"tool": {{"driver": {{"name": {json.dumps(tool)}, "rules": [')
    out = out.union(_listed(sarif_rules(findings), 1, ["rule_id"], rule)).union(_one(findings, 2, ']}}, "results": ['))
    return out.union(_listed(results, 3, ["rule_id", "seq"], sarif_result(results))).union(_one(findings, 4, "]}]}"))


def escape(text) -> Column | str:
    """Text, or a column of text, for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b)) if isinstance(text, Column) else str(text).replace(a, b)
    return text


def to_html(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The lines, (part, at, value), of a self-contained report: score, gate, severities, groups by rule, category and
    file, riskiest files and all findings with their evidence.
    """
    report = metrics.report(findings, []).first() if not findings.isEmpty() else None
    score, grade, gate = (report["score"], report["grade"], report["gate"]) if report else (100.0, "A", "passed")
    counts = {r["severity"]: (r["n"], r["pct_round"]) for r in metrics.shares(findings, "severity").collect()}  # five rows at most
    located = findings.withColumn("path", F.coalesce("path", F.lit("(unlocated)")))
    head = ["<!doctype html><meta charset=utf-8><title>Report</title>", f"<h1>Score {score:.0f} ({grade}), gate: {escape(gate)}</h1>"]
    head += [f"<p>{s}: {counts.get(s, (0, 0))[0]} ({counts.get(s, (0, 0))[1]} %)</p>" for s in dims.SEVERITIES]
    out = _one(findings, 0, "\n".join(head))
    risky = metrics.riskiest(located, "path").withColumn("n", -F.col("weight"))
    out = out.union(_listed(risky, 1, ["n", "first_seq"], F.concat(F.lit("<li>"), escape(F.col("path")), F.lit(": "), F.col("weight").cast("string"), F.lit("</li>")), False))
    for part, key in ((2, "rule_id"), (3, "category"), (4, "path")):
        groups = metrics.grouped(located, key, "(none)").withColumn("n_", -F.col("n"))
        line = F.concat(F.lit(f'<p data-group="{key}">'), escape(F.col("group")), F.lit(": "), F.col("n").cast("string"), F.lit("</p>"))
        out = out.union(_listed(groups, part, ["n_", "group"], line, False))
    facts = evidence.groupBy(F.col("finding_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "summary"))).alias("facts"))
    facts = F.transform(F.coalesce("facts", F.array()), lambda x: F.concat(F.lit("<li>"), escape(x["summary"]), F.lit("</li>"))), located.join(facts, "id", "left")
    search = escape(F.lower(F.concat_ws(" ", "title", "path")))
    article = F.concat(
        F.lit('<article data-severity="'), F.col("severity"), F.lit('" data-category="'), F.col("category"), F.lit('" data-search="'), search, F.lit('"><h2>'),
        escape(F.col("title")), F.lit("</h2><p>"), escape(F.col("path")), F.lit("</p>"), F.array_join(facts[0], ""), F.lit("</article>"),
    )
    return out.union(_listed(facts[1], 5, [severity_ordinal(F.col("severity")), "rule_id", "seq"], article, False))


def write(lines: DataFrame, path: str) -> None:
    """Store lines as text: the parts of the folder, in order of name, make up the document."""
    lines.orderBy("part", "at").select("value").write.text(path)


#: Lines of a snippet on either side of its line; bytes of the largest file that has snippets.
SNIPPET_LINES, SNIPPET_BYTES = 2, 2_000_000


def snippets(locations: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, line, start_line, highlight, lines): the lines around each distinct (path, line) of ``locations``.

    ``line`` counts from 0, ``start_line`` and ``highlight`` from 1. texts: (path, text). Locations without a line
    and those in a missing or too large file have no snippet; beyond the end of a file ``lines`` is empty. Each text
    is joined and split once, however many locations it has.
    """
    wanted = locations.where("line >= 0").groupBy("path").agg(F.collect_set(F.col("line").cast("int")).alias("at"))
    found = texts.where(F.octet_length("text") <= SNIPPET_BYTES).select("path", "text").join(wanted, "path")
    found = found.select("path", F.split("text", r"\r?\n").alias("all"), F.explode("at").alias("line"))
    start = F.greatest(F.col("line") - SNIPPET_LINES, F.lit(0))
    end = F.least(F.size("all"), F.col("line") + SNIPPET_LINES + 1)
    lines = F.slice("all", start + 1, F.greatest(end - start, F.lit(0)))
    return found.select("path", "line", (start + 1).alias("start_line"), (F.col("line") + 1).alias("highlight"), lines.alias("lines"))


def location_text(path: Column, start_line: Column) -> Column:
    """``path:line`` with the line counted from 1; the path alone where no line is known."""
    return F.concat(path, F.coalesce(F.concat(F.lit(":"), (start_line + 1).cast("string")), F.lit("")))


def search(findings: DataFrame, term: str = "", **facets) -> DataFrame:
    """Findings that meet all facets and hold ``term`` in title or path, whatever the case."""
    for column, value in facets.items():
        findings = findings.where(F.col(column) == value)
    return findings.where(F.lower(F.concat_ws(" ", "title", "path")).contains(term.lower()))


def positional(rows: DataFrame, prefix: str, order: list) -> DataFrame:
    """rows with id: the prefix and the place in a total order, from 0."""
    return numbered(rows, *order, name="id").withColumn("id", F.concat(F.lit(f"{prefix}-"), F.col("id").cast("string")))


#: The columns of findings and evidence in a document that ``write`` stored.
FINDING = (
    "id string, rule_id string, category string, severity string, confidence double, status string, title string, description string, remediation string, path string, "
    "locations array<struct<path: string, line: int, col: int>>, evidence_ids array<string>, cwe string, owasp string, correlated_ids array<string>, seq long"
)
EVIDENCE = "id string, summary string, finding_id string"
SUMMARY = "totalFindings long, findingsBySeverity map<string, long>, findingsByCategory map<string, long>"
_ID = r'"id":"(?:[^"\\]|\\.)*"'


def read_scan(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Findings, evidence and summary of a document that ``write`` stored from ``to_json``; its lines are read in parallel."""
    lines = spark.read.text(path)
    kept = lambda pattern, text, shape: lines.where(F.col("value").rlike(pattern)).select(F.from_json(F.regexp_extract("value", text, 1), shape).alias("r")).select("r.*")
    return {
        "findings": kept(rf"^,?\{{{_ID},\"rule_id\":", "^,?(.*)$", FINDING),
        "evidence": kept(rf"^,?\{{{_ID},\"summary\":", "^,?(.*)$", EVIDENCE),
        "summary": kept(r'^\], "summary": ', r'^\], "summary": (.*)\}$', SUMMARY),
    }


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a document that ``write`` stored from ``to_json``, one row each."""
    return read_scan(spark, path)["findings"]


_PLACES = "array<struct<path: string, range: struct<start: struct<line: int, column: int>>>>"
#: A scan's result as one JSON document with the names of its fields in camel case.
RESULT = (
    "findings array<struct<id: string, ruleId: string, category: string, severity: string, confidence: double, status: string, title: string, description: string, "
    f"locations: {_PLACES}, evidenceIds: array<string>, remediation: struct<summary: string>, cwe: string, owasp: string, correlatedFindingIds: array<string>>>, "
    "evidence array<struct<id: string, summary: string>>"
)


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Findings and evidence of JSON documents in camel case, one document a file, with the file in ``source``.

    Fields are not validated, missing ones are null; a file that is no JSON fails. A document is one record of one task,
    its findings are dealt from there.
    """
    whole = spark.read.schema(RESULT).json(path, multiLine=True, mode="FAILFAST").withColumn("source", F.input_file_name())
    each = whole.select("source", F.posexplode("findings").alias("seq", "f"))
    places = F.transform("f.locations", lambda p: place(p["path"], p["range"]["start"]["line"], p["range"]["start"]["column"]))
    findings = each.select(
        "source", "f.id", F.col("f.ruleId").alias("rule_id"), "f.category", "f.severity", "f.confidence", "f.status", "f.title", "f.description",
        F.col("f.remediation.summary").alias("remediation"), F.try_element_at(places, F.lit(1))["path"].alias("path"), places.alias("locations"),
        F.col("f.evidenceIds").alias("evidence_ids"), "f.cwe", "f.owasp", F.col("f.correlatedFindingIds").alias("correlated_ids"), F.col("seq").cast("long").alias("seq"),
    )
    owners = findings.select("source", F.col("id").alias("finding_id"), F.explode("evidence_ids").alias("id"))
    facts = whole.select("source", F.inline("evidence"))
    return {"findings": findings, "evidence": facts.join(owners, ["source", "id"], "left").select("source", "id", "summary", "finding_id")}
