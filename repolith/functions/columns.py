"""Column functions for paths, classification, scores and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolith.functions import dims


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half rounds toward plus infinity, on doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the base name; a name that begins with its only dot has none."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def normalise_path(path: Column) -> Column:
    """Collapse ., .. and empty segments; leading .. of a relative path stay."""
    up, here = F.lit(".."), F.array().cast("array<string>")

    def fold(out: Column, segment: Column) -> Column:
        can_pop = (F.size(out) > 0) & (F.element_at(F.concat(F.array(F.lit("x")), out), -1) != up)
        popped = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(segment.isin("", "."), out).when((segment == up) & can_pop, popped).otherwise(F.concat(out, F.array(segment)))

    return F.array_join(F.aggregate(F.split(path, "/"), here, fold), "/")


def is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"^\.\.?(/|$)")


def language(path: Column) -> Column:
    base, ext = F.lower(basename(path)), F.lower(extension(path))
    out = F.when((base == "dockerfile") | base.startswith("dockerfile."), "dockerfile")
    for name, lang in dims.LANGUAGE_BY_EXTENSION.items():
        out = out.when(ext == name, lang)
    return out.otherwise("unknown")


def classification(path: Column) -> Column:
    """Role of a file; the first that applies of generated, vendored, infrastructure, test, configuration,
    documentation, asset, configuration by pattern, source, infrastructure by name, unknown."""
    base, ext, segments = F.lower(basename(path)), F.lower(extension(path)), F.split(path, "/")
    among = lambda names: F.exists(segments, lambda s: F.lower(s).isin(*names))
    return (
        F.when(among(dims.GENERATED_SEGMENTS) | base.rlike(dims.GENERATED_NAME), "generated")
        .when(among(dims.VENDORED_SEGMENTS), "vendored")
        .when(among(dims.INFRASTRUCTURE_SEGMENTS) | base.isin(*dims.INFRASTRUCTURE_FILES), "infrastructure")
        .when(among(dims.TEST_SEGMENTS) | base.rlike(dims.TEST_NAME) | base.rlike(dims.PYTHON_TEST_NAME), "test")
        .when(base.isin(*dims.CONFIG_FILES), "config")
        .when(ext.isin(*dims.DOCUMENTATION_EXTENSIONS) | (base == "license") | base.startswith("license."), "documentation")
        .when(ext.isin(*dims.ASSET_EXTENSIONS), "asset")
        .when(base.rlike(dims.CONFIG_NAME) | ext.isin(".yml", ".yaml"), "config")
        .when(language(path).isin("javascript", "typescript", "python", "sql"), "source")
        .when(language(path) == "dockerfile", "infrastructure")
        .otherwise("unknown")
    )


def is_binary(path: Column, content: Column) -> Column:
    return F.lower(extension(path)).isin(*dims.BINARY_EXTENSIONS) | F.hex(F.substring(content, 1, 8000)).rlike("^(..)*?00")


def certainty_rank(certainty: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, dims.CERTAINTIES)), certainty).cast("int") - 1


def certainty_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, dims.CERTAINTIES)), rank.cast("int") + 1)


def severity_ordinal(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, dims.SEVERITIES)), severity).cast("int") - 1


def by_name(column: Column, values: dict) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(column == name, F.lit(value)) if out is None else out.when(column == name, F.lit(value))
    return out


def maintainability_index(complexity: Column, lines: Column) -> Column:
    raw = (171.0 - 0.23 * complexity - 16.2 * F.log(F.greatest(lines, F.lit(1)).cast("double"))) * 100.0 / 171.0
    return round_half_up(F.greatest(F.lit(0.0), raw), 1)


def risk_score(weighted: Column) -> Column:
    return F.greatest(F.lit(0.0), round_half_up(100.0 - weighted))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 55, "C").when(score >= 30, "D").otherwise("E")


def matches_signature(site: str, signature: str) -> Column:
    """A call site (struct column) against a signature (struct column): null fields of the signature match anything."""
    s, m = (lambda c: F.col(f"{site}.{c}")), (lambda c: F.col(f"{signature}.{c}"))
    receiver = F.coalesce(s("receiver_text"), F.lit(None).cast("string"))
    ends = F.exists(m("receiver_ends"), lambda e: receiver.endswith(e))
    tests = [
        m("callee_kind").isNull() | s("callee_kind").eqNullSafe(m("callee_kind")),
        m("callee_names").isNull() | F.coalesce(F.array_contains(m("callee_names"), s("callee_name")), F.lit(False)),
        m("receiver").isNull() | receiver.eqNullSafe(m("receiver")),
        m("receiver_starts").isNull() | F.coalesce(receiver.startswith(m("receiver_starts")), F.lit(False)),
        m("receiver_ends").isNull() | F.coalesce(ends, F.lit(False)),
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def place(path: Column, line: Column | None = None, col: Column | None = None) -> Column:
    """A location: (path, line, col), both counted from 0 and null where they are not known."""
    number = lambda c: (F.lit(None) if c is None else c).cast("int")
    return F.struct(path.alias("path"), number(line).alias("line"), number(col).alias("col"))


def badge(severity: Column) -> Column:
    """The badge of a diagnostic: that of a finding's severity."""
    return F.when(severity == "error", "high").when(severity == "warning", "medium").otherwise("info")
