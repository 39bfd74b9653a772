"""Repositories as tables: a walk on the driver lists paths, executors read and describe the files."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import dims
from repolith.functions.columns import classification, is_binary, language

MAX_PARSED = 5 << 20


def ignored(patterns: list[str], path: str, folder: bool) -> bool:
    """Whether the last matching pattern, in the manner of .gitignore, excludes a path."""
    out = False
    for raw in patterns:
        p = raw.rstrip()
        if not p or p.startswith("#"):
            continue
        negated, p = p.startswith("!"), p.lstrip("!")
        only_folder, p = p.endswith("/"), p.rstrip("/")
        if only_folder and not folder:
            continue
        anchored, p = "/" in p, p.lstrip("/")
        hit = fnmatch.fnmatch(path, p) if anchored else any(fnmatch.fnmatch(s, p) for s in path.split("/"))
        if hit:
            out = not negated
    return out


def walk(root: str, patterns: list[str] = (), respect_gitignore: bool = True) -> list[str]:
    """Sorted relative paths, without .git, node_modules, links and what is ignored."""
    rules = list(patterns)
    if respect_gitignore and os.path.isfile(f"{root}/.gitignore"):
        rules = open(f"{root}/.gitignore", encoding="utf-8").read().splitlines() + rules
    out = []
    for folder, folders, names in os.walk(root):
        here = os.path.relpath(folder, root)
        at = (lambda n: n) if here == "." else (lambda n: f"{here}/{n}")
        folders[:] = [d for d in folders if d not in (".git", "node_modules") and not os.path.islink(f"{folder}/{d}") and not ignored(rules, at(d), True)]
        out += [at(n) for n in names if not os.path.islink(f"{folder}/{n}") and not ignored(rules, at(n), False)]
    return sorted(out)


def inside(root: str, path: str) -> bool:
    """Whether a relative path stays within ``root``, with links followed."""
    top = os.path.realpath(root)
    return os.path.commonpath([top, os.path.realpath(os.path.join(top, path))]) == top


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, content, seq): read by tasks, a few hundred paths each. ``root`` must be reachable from executors.

    Paths that lead out of ``root`` are left out.
    """

    def read(batches):
        for b in batches:
            b = b.filter(pa.array([inside(root, p) for p in b.column(0).to_pylist()], pa.bool_()))
            data = [open(os.path.join(root, p), "rb").read() for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), b.column(1)], ["path", "content", "seq"])

    listed = spark.createDataFrame(list(zip(paths, range(len(paths)))), "path string, seq long")
    return listed.repartition(max(1, len(paths) // 256), "path").mapInArrow(read, "path string, content binary, seq long")


def files(contents: DataFrame) -> DataFrame:
    """File rows of (path, content, seq)."""
    return contents.select(
        F.col("path").alias("id"), "path", language(F.col("path")).alias("language"), classification(F.col("path")).alias("classification"),
        F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"),
        F.when(is_binary(F.col("path"), F.col("content")), "binary").otherwise("utf-8").alias("encoding"), "seq",
    )


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, status): added, changed, removed or unchanged between two scans, by content hash.

    now, before: (path, content_hash), one row a path; two null hashes are equal. Rescans read the added and changed.
    """
    old = before.select("path", F.col("content_hash").alias("_old"), F.lit(True).alias("_was"))
    both = now.select("path", "content_hash", F.lit(True).alias("_is")).join(old, "path", "full_outer")
    same = F.col("content_hash").eqNullSafe(F.col("_old"))
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def parseable(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to parse, diagnostics of those skipped for their size)."""
    wanted = described.where("encoding <> 'binary' and classification not in ('generated', 'vendored', 'asset')")
    big = wanted.where(F.col("size_bytes") > MAX_PARSED)
    said = big.select(F.lit("FILE_SKIPPED_SIZE_LIMIT").alias("code"), F.lit("warning").alias("severity"), F.concat("path", F.lit(" is too large to parse")).alias("message"), F.lit("parser").alias("source"), F.col("path").alias("file_path"))
    return wanted.where(F.col("size_bytes") <= MAX_PARSED), said


def package_json(text: str | None) -> dict | None:
    try:
        got = json.loads(text or "")
        return got if isinstance(got, dict) else None
    except ValueError:
        return None


def package_manager(paths: set[str]) -> str:
    for name, kind in dims.LOCKFILES:
        if name in paths:
            return kind
    for name, kind in (("package.json", "npm"), ("pyproject.toml", "poetry"), ("requirements.txt", "pip")):
        if name in paths:
            return kind
    return "unknown"


def pnpm_globs(text: str) -> list[str]:
    """The packages list of a pnpm workspace file; blank lines and comments in it are passed over."""
    out, inside = [], False
    for line in text.splitlines():
        bare = line.strip()
        if re.match(r"^packages:\s*$", line):
            inside = True
        elif inside and bare.startswith("- "):
            out.append(bare[2:].strip().strip("'\""))
        elif inside and bare and not bare.startswith("#"):
            break
    return out


def frameworks(manifests: DataFrame) -> DataFrame:
    """(ord, framework) of package.json texts: node if there is any, then those whose package is depended on."""
    spark = manifests.sparkSession
    shape = "struct<dependencies: map<string, string>, devDependencies: map<string, string>>"
    read = manifests.select(F.from_json("text", shape).alias("j")).where("j is not null")
    maps = F.concat(F.coalesce(F.map_keys("j.dependencies"), F.array()), F.coalesce(F.map_keys("j.devDependencies"), F.array()))
    names = read.select(F.explode(maps).alias("package")).distinct()
    dim = spark.createDataFrame([(i + 1, k, v) for i, (k, v) in enumerate(dims.FRAMEWORK_PACKAGES.items())], "ord int, framework string, package string")
    node = read.limit(1).select(F.lit(0).alias("ord"), F.lit("node").alias("framework"))
    return node.union(F.broadcast(dim).join(names, "package", "left_semi").select("ord", "framework")).orderBy("ord")


#: Bytes of the largest text that rules read.
MAX_TEXT = 5 << 20


def texts(files: DataFrame) -> DataFrame:
    """(path, text, skipped) of files (path, content): why a text is left out (unreadable, too-large, binary), or null."""
    size = F.octet_length("content")
    skipped = F.when(F.col("content").isNull(), "unreadable").when(size > MAX_TEXT, "too-large").when(F.contains(F.col("content"), F.lit(b"\x00")), "binary")
    skipped = F.coalesce(skipped, F.when(~F.is_valid_utf8("content"), "binary")) if hasattr(F, "is_valid_utf8") else skipped
    return files.select("path", F.when(skipped.isNull(), F.col("content").cast("string")).alias("text"), skipped.alias("skipped"))


def workspace_packages(manifests: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, name): the manifests (path, text) of packages in folders that a workspace's globs (glob) name.

    ``*`` is one folder, ``**`` any. The globs are those of one manifest, a few.
    """
    folder = F.regexp_replace("path", "/?package\\.json$", "")
    plain = F.regexp_replace(F.regexp_replace("glob", "/+$", ""), r"([.+^$(){}\[\]|])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.replace(plain, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]+")), F.lit("\x01"), F.lit(".+")), F.lit("$"))
    found = manifests.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("folder", folder)
    named = found.join(F.broadcast(globs.select(pattern.alias("pattern")).distinct()), F.expr("folder rlike pattern"), "left_semi")
    return named.select("path", F.get_json_object("text", "$.name").alias("name"))


def package_managers(files: DataFrame) -> DataFrame:
    """(root, manager) of repositories' files (root, path, text): by the first lock file known, else by the manifest."""
    names = [*dims.LOCKFILES, ("package.json", "npm"), ("pyproject.toml", "poetry"), ("requirements.txt", "pip")]
    known = F.create_map(*[F.lit(x) for n, (name, kind) in reversed([*enumerate(names)]) for x in (name, f"{n:02d}{kind}")])
    rank = F.when((F.col("path") != "package.json") | is_object(F.col("text")), F.try_element_at(known, F.col("path")))
    best = files.groupBy("root").agg(F.min(rank).alias("best"))
    return best.select("root", F.coalesce(F.substring("best", 3, 20), F.lit("unknown")).alias("manager"))


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.get_json_object(text, "$").startswith("{"), F.lit(False))


def packages(files: DataFrame) -> DataFrame:
    """(root, path, name, manifest, manager) of the packages of repositories, given their files (root, path, text).

    The globs of a pnpm workspace file come before those of the root's package.json. ``dir/*`` names the folders in
    ``dir``, anything else one folder; a folder that two globs name comes twice. Without globs the root is the one
    package, of its package.json or, by manager, of pyproject.toml or requirements.txt. Packages are found by equality
    of folder and glob, so repositories of any number and size are spread by root and folder.
    """
    item = r"""(?m)^\s*-\s*["']?([^"'#\r\n]+?)["']?[^\S\n]*(?:#.*)?$"""
    block = F.regexp_extract("text", r"(?m)^packages:[^\S\n]*\n((?:[^\S\n]*(?:[-#][^\n]*)?(?:\n|\z))*+)", 1)
    pnpm = files.where("path = 'pnpm-workspace.yaml'").select("root", F.transform(F.regexp_extract_all(block, F.lit(item), F.lit(1)), F.trim).alias("pnpm"))
    valid = files.where(F.col("path").rlike(r"(^|/)package\.json$") & is_object(F.col("text")))
    spaces = F.get_json_object("text", "$.workspaces")
    npm = F.when(spaces.startswith("["), F.from_json(spaces, "array<string>")).when(spaces.startswith("{"), F.from_json(spaces, "struct<packages: array<string>>")["packages"])
    own = valid.where("path = 'package.json'").select("root", F.get_json_object("text", "$.name").alias("own_name"), npm.alias("npm"), F.lit(True).alias("own"))
    roots = package_managers(files).join(pnpm, "root", "left").join(own, "root", "left").withColumn("globs", F.coalesce("pnpm", "npm"))
    has = files.where("path in ('pyproject.toml', 'requirements.txt')").groupBy("root").agg(F.collect_set("path").alias("python"))  # two at most
    single = F.when(F.col("own"), "package.json").when((F.col("manager") == "poetry") & F.array_contains("python", "pyproject.toml"), "pyproject.toml")
    single = single.when((F.col("manager") == "pip") & F.array_contains("python", "requirements.txt"), "requirements.txt")
    alone = roots.where("globs is null").join(has, "root", "left").withColumn("manifest", single).where("manifest is not null")
    alone = alone.select("root", F.lit(".").alias("path"), F.coalesce("own_name", F.substring_index(F.rtrim(F.col("root"), F.lit("/")), "/", -1)).alias("name"), "manifest", "manager")
    plain = F.rtrim(F.regexp_replace("glob", r"^\./(?!\*$)", ""), F.lit("/"))
    wanted = roots.where("globs is not null").select("root", "manager", F.explode("globs").alias("glob")).withColumn("key", plain)
    folder = F.regexp_replace("path", r"/?package\.json$", "")
    inside = F.when(folder.contains("/"), F.concat(F.regexp_replace(folder, "/[^/]*$", ""), F.lit("/*"))).when(folder != "", "./*")
    found = valid.select("root", F.when(folder == "", ".").otherwise(folder).alias("path"), F.get_json_object("text", "$.name").alias("name"), F.col("path").alias("manifest"), F.explode(F.array_compact(F.array(F.when(folder == "", ".").otherwise(folder), inside))).alias("key"))
    return alone.union(found.join(wanted, ["root", "key"]).select("root", "path", F.coalesce("name", "path").alias("name"), "manifest", "manager"))
