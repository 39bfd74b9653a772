"""Coverage reports: lcov, istanbul and coverage.py, as (path, line, hits) and (path, line, branch_id, taken)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_format(path: str, text: str) -> str:
    if not path.endswith(".json"):
        return "lcov"
    return "coverage-py" if '"files"' in text else "istanbul"


def lcov(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reports: (text)."""
    records = reports.select(F.explode(F.split("text", r"end_of_record\r?\n?")).alias("r"))
    records = records.select(F.regexp_extract("r", r"(?m)^SF:(.*?)\r?$", 1).alias("path"), "r").where("path <> ''")
    each = lambda pattern: F.explode(F.regexp_extract_all("r", F.lit(pattern), F.lit(0))).alias("x")
    field = lambda pattern, n: F.regexp_extract("x", pattern, n)
    da, br = r"(?m)^DA:(\d+),(\d+)", r"(?m)^BRDA:(\d+),(\d+),(\d+),(\d+|-)"
    lines = records.select("path", each(da)).select("path", field(da, 1).cast("int").alias("line"), field(da, 2).cast("long").alias("hits"))
    branches = records.select("path", each(br)).select("path", field(br, 1).cast("int").alias("line"), F.concat_ws(":", field(br, 2), field(br, 3)).alias("branch_id"), (~field(br, 4).isin("-", "0")).alias("taken"))
    return lines, branches


def istanbul(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    place = "struct<start: struct<line: int>>"
    shape = f"map<string, struct<path: string, statementMap: map<string, {place}>, s: map<string, long>, branchMap: map<string, struct<loc: {place}, line: int>>, b: map<string, array<long>>>>"
    files = reports.select(F.explode(F.from_json("text", shape)).alias("key", "f")).select(F.coalesce("f.path", "key").alias("path"), "f")
    lines = files.select("path", "f", F.explode("f.s").alias("k", "hits"))
    lines = lines.select("path", F.expr("f.statementMap[k].start.line").alias("line"), "hits").groupBy("path", "line").agg(F.max("hits").alias("hits"))
    branches = files.select("path", "f", F.explode("f.b").alias("k", "counts")).select("path", "f", "k", F.posexplode("counts").alias("n", "count"))
    line = F.expr("coalesce(f.branchMap[k].line, f.branchMap[k].loc.start.line)")
    return lines, branches.select("path", line.alias("line"), F.concat_ws(":", "k", F.col("n").cast("string")).alias("branch_id"), (F.col("count") > 0).alias("taken"))


def coverage_py(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    shape = "struct<files: map<string, struct<executed_lines: array<int>, missing_lines: array<int>, executed_branches: array<array<int>>, missing_branches: array<array<int>>>>>"
    files = reports.select(F.explode(F.from_json("text", shape)["files"]).alias("path", "f"))
    part = lambda c, hits: files.select("path", F.explode(f"f.{c}").alias("line"), F.lit(hits).cast("long").alias("hits"))
    jump = lambda c, taken: files.select("path", F.explode(f"f.{c}").alias("b")).select("path", F.col("b")[0].alias("line"), F.array_join(F.col("b").cast("array<string>"), ":").alias("branch_id"), F.lit(taken).alias("taken"))
    return part("executed_lines", 1).union(part("missing_lines", 0)), jump("executed_branches", True).union(jump("missing_branches", False))


READERS = {"lcov": lcov, "istanbul": istanbul, "coverage-py": coverage_py}


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def map_files(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with file_id, diagnostics): a report's path is a file's path, or ends in exactly one file's path.

    What can not be mapped is dropped and reported, never guessed.
    """
    paths = rows.select("path").distinct().withColumn("clean", _clean(F.col("path")))
    tails = paths.withColumn("tail", F.explode(F.expr("transform(sequence(0, size(split(clean, '/')) - 1), i -> array_join(slice(split(clean, '/'), i + 1, size(split(clean, '/')) - i), '/'))")))
    hits = tails.join(files.select(F.col("path").alias("tail"), "id"), "tail")
    hits = hits.groupBy("path", "clean").agg(F.countDistinct("id").alias("n"), F.max(F.when(F.col("tail") == F.col("clean"), F.col("id"))).alias("exact"), F.max("id").alias("id"))
    known = hits.where("exact is not null or n = 1").select("path", F.coalesce("exact", "id").alias("file_id"))
    missing = paths.join(known, "path", "left_anti")
    said = missing.select(F.lit("COVERAGE_UNMAPPED_FILE").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("no project file is "), "path").alias("message"), F.lit("coverage").alias("source"), F.col("path").alias("file_path"))
    return rows.join(known, "path"), said
