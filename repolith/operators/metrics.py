"""Containment, complexity, duplication, classification counts and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import dims
from repolith.functions.columns import by_name, grade, maintainability_index, risk_score, round_half_up
from repolith.operators.lineage import cut, numbered, running


def containment(spans: DataFrame, group: str, strict: bool = True) -> DataFrame:
    """(group, outer, inner): pairs of spans (id, group, start, end) of one group in which one holds the other.

    As many rows as there are pairs; ``holders`` counts them without making them.
    """
    a = spans.select(group, F.col("id").alias("outer"), F.col("start").alias("os"), F.col("end").alias("oe"))
    b = spans.select(group, F.col("id").alias("inner"), F.col("start").alias("is"), F.col("end").alias("ie"))
    inside = F.expr("`is` >= os and ie <= oe and outer <> inner")
    if strict:
        inside = inside & F.expr("`is` > os or ie < oe")
    return a.join(b, group).where(inside).select(group, "outer", "inner", "os", "oe")


def holders(spans: DataFrame, group: str) -> DataFrame:
    """(group, start, end, n, holders): the distinct spans of each group, how many rows each has, and how many rows of its
    group strictly hold it. No pair is made.

    Spans are numbered by start, the longer first, so one that holds another comes before it. Two numbers differ first in
    one binary digit; for each digit, spans with a 1 count those with a 0 that agree in the higher digits and do not end
    before them. That is a running sum by falling end, over n log n narrow rows that are dealt by ranges.
    """
    one = spans.groupBy(group, "start", "end").agg(F.count("*").alias("n"))
    one = cut(numbered(one, group, "start", F.desc("end"), name="_p"))
    own = one.groupBy(group).agg(F.min("_p").alias("_first"), F.count("*").alias("_size"))
    placed = one.join(own, group).withColumn("_q", F.col("_p") - F.col("_first"))
    digits = F.when(F.col("_size") > 1, F.length(F.bin(F.col("_size") - 1))).otherwise(0)
    rows = placed.where("_size > 1").select(group, "start", "end", "n", "_q", F.explode(F.sequence(F.lit(0), digits - 1)).alias("_digit"))
    rows = rows.withColumns({"_block": F.expr("shiftright(_q, _digit + 1)"), "_side": F.expr("shiftright(_q, _digit) & 1")})
    before = F.when(F.col("_side") == 0, F.col("n")).otherwise(0)
    counted = running(rows, [group, "_digit", "_block"], [F.desc("end"), F.col("_side"), F.col("_q")], {"_held": before})
    found = counted.where("_side = 1").groupBy(group, "start", "end").agg(F.sum("_held").alias("holders"))
    return one.drop("_p").join(found, [group, "start", "end"], "left").withColumn("holders", F.coalesce("holders", F.lit(0)))


def direct_nesting(spans: DataFrame, group: str) -> DataFrame:
    """Containment pairs without another span between.

    Of the spans that hold one, those are direct that end first among all that start where they do or later, and start
    last among all that end where they do: windows over the pairs, no second join.
    """
    pairs = containment(spans, group)
    own = Window.partitionBy(group, "inner")
    nearer = F.min("oe").over(own.orderBy(F.desc("os")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    alike = F.max("os").over(own.partitionBy(group, "inner", "oe"))
    return pairs.withColumns({"_end": nearer, "_start": alike}).where("oe = _end and os = _start").select(group, "outer", "inner")


def parents(spans: DataFrame, group: str) -> DataFrame:
    """(group, start, end, n, depth, parent): the distinct spans of each group, and the least one that strictly holds each,
    as a struct of start and end (null at depth 1).

    For spans of one group that nest or lie apart, as those of code do; an empty span belongs to what starts with it, not
    to what ends there. One running sum over the spans' ends gives depths; the last span before, and one level above, is
    the parent. Both go over ranges of places, so the work is linear and no group is in one task.
    """
    one = cut(spans.groupBy(group, "start", "end").agg(F.count("*").alias("n")))
    empty = F.col("start") == F.col("end")
    opens = one.select(group, F.col("start").alias("_at"), F.lit(1).alias("_kind"), (-F.col("end")).alias("_rest"), F.lit(1).alias("_delta"), "start", "end", "n")
    closes = one.select(group, F.col("end"), F.when(empty, 2).otherwise(0), F.lit(0), F.lit(-1), "start", "end", "n")
    deep = running(opens.union(closes), [group], ["_at", "_kind", "_rest", "start"], {"depth": F.col("_delta")}).where("_kind = 1")
    deep = cut(deep.select(group, "start", "end", "n", "depth", (-F.col("end")).alias("_rest")))
    asks = deep.select("*", (F.col("depth") - 1).alias("_level"), F.lit(1).alias("_ask"), F.lit(None).cast(f"struct<start: {dict(deep.dtypes)['start']}, end: {dict(deep.dtypes)['end']}>").alias("_span"))
    tells = deep.select("*", F.col("depth").alias("_level"), F.lit(0).alias("_ask"), F.struct("start", "end").alias("_span"))
    found = running(tells.union(asks), [group, "_level"], ["start", "_rest", "_ask"], {}, {"parent": F.col("_span")})
    return found.where("_ask = 1").select(group, "start", "end", "n", "depth", "parent")


def with_lines(functions: DataFrame) -> DataFrame:
    return functions.withColumn("lines", F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(1)))


def function_metrics(functions: DataFrame) -> DataFrame:
    """functions (id, module_id, start, end, start_line, end_line) with lines, nested, complexity and mi."""
    spans = parents(functions.where("start is not null and end is not null"), "module_id").where("parent is not null")
    nested = spans.groupBy("module_id", F.col("parent.start").alias("start"), F.col("parent.end").alias("end")).agg(F.sum("n").alias("nested"))
    out = with_lines(functions.join(nested, ["module_id", "start", "end"], "left").withColumn("nested", F.coalesce("nested", F.lit(0))))
    out = out.withColumn("complexity", (1 + F.col("nested") + F.floor(F.col("lines") / 10)).cast("long"))
    return out.withColumn("mi", maintainability_index(F.col("complexity"), F.col("lines")))


def structural_duplicates(rows: DataFrame, signature: Column, module: str, name: str, order: list[str]) -> DataFrame:
    """(signature, n, modules, names): rows of one signature in at least two modules."""
    marked = rows.withColumn("signature", signature)
    out = marked.groupBy("signature").agg(
        F.count("*").alias("n"), F.countDistinct(module).alias("modules"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.col(name).alias("_n")))), lambda x: x["_n"])).alias("names"),
    )
    return out.where("modules >= 2")


def shares(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, pct, pct_round): counts and their share of the total."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"))
    ratio = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return out.withColumns({"pct": round_half_up(ratio, 6), "pct_round": round_half_up(ratio).cast("long")})


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, by category and in all, as grouping sets: (severity, category, n)."""
    severity, category = F.col("severity"), F.col("category")
    return findings.groupingSets([[severity], [category], []], severity, category).agg(F.count("*").alias("n")).select("severity", "category", "n")


def count_maps(findings: DataFrame) -> DataFrame:
    """One row: by_severity and by_category, maps of counts, and total."""
    counts = summary(findings)
    as_map = lambda key: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, "n"))))).alias(f"by_{key}")
    total = F.sum(F.when(F.col("severity").isNull() & F.col("category").isNull(), F.col("n"))).alias("total")
    return counts.agg(as_map("severity"), as_map("category"), total)


def grouped(findings: DataFrame, key: str, none: str) -> DataFrame:
    """(group, n, worst): findings by rule, category or primary file, the largest groups first, then by name.

    worst is the most severe of a group; findings without the key form the group ``none``.
    """
    rank = F.array_position(F.array(*map(F.lit, dims.SEVERITIES)), F.col("severity"))
    out = findings.groupBy(F.coalesce(key, F.lit(none)).alias("group")).agg(F.count("*").alias("n"), F.min_by("severity", rank).alias("worst"))
    return out.orderBy(F.desc("n"), "group")


def report(findings: DataFrame, group: list[str]) -> DataFrame:
    """Risk score, grade and quality gate of each group of findings (severity)."""
    weight = by_name(F.col("severity"), dims.SEVERITY_WEIGHT)
    n = lambda s: F.count_if(F.col("severity") == s)
    out = findings.groupBy(*group).agg(F.sum(weight).alias("w"), n("critical").alias("critical"), n("high").alias("high"))
    score = risk_score(F.col("w"))
    gate = F.when(F.col("critical") > 0, "critical findings").when(F.col("high") > 0, "high findings").otherwise("passed")
    return out.select(*group, score.alias("score"), grade(score).alias("grade"), gate.alias("gate"))


def riskiest(findings: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The ``limit`` keys of greatest weight: each finding weighs 50 (critical) to 10 (info)."""
    weight = (F.lit(5) - F.array_position(F.array(*map(F.lit, dims.SEVERITIES)), F.col("severity")) + 1) * 10
    out = findings.groupBy(key).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return out.orderBy(F.desc("weight"), F.desc("n"), "first_seq", key).limit(limit)


def coverage_status(lines: DataFrame, key: str, hit: Column) -> DataFrame:
    """(key, status): covered if all lines are hit, uncovered if none is, else partially-covered."""
    out = lines.groupBy(key).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    status = F.when(F.col("hits") == F.col("n"), "covered").when(F.col("hits") == 0, "uncovered").otherwise("partially-covered")
    return out.select(key, status.alias("status"))
