"""Python data sources: ``lcov`` to read coverage reports by byte ranges, ``sarif`` to write one document in parts.

    register(spark)
    spark.read.format("lcov").load("reports/")
    sarif_rows(findings).write.format("sarif").mode("overwrite").save("report.sarif/")

Paths are opened by pyarrow's file systems, so they are URIs or paths that driver and executors share.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from repolith.sources import sinks

#: Bytes of a report that a task reads, and rows of a batch that it hands on, unless a record has more.
SPLIT_BYTES, BATCH_ROWS = 32 << 20, 10_000
#: The line that ends a record, and those of lines and branches.
END, HIT, BRANCH = b"end_of_record", re.compile(rb"DA:(\d+),(\d+)"), re.compile(rb"BRDA:(\d+),(\d+),(\d+),(\d+|-)")
LCOV = pa.schema([("path", pa.string()), ("line", pa.int32()), ("hits", pa.int64()), ("branch_id", pa.string()), ("taken", pa.bool_())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class LcovReader(DataSourceReader):
    """A range owns the records that begin in it; the last of them may end beyond it."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        return [Range(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)]

    def records(self, part: Range) -> Iterator[list[bytes]]:
        with located(self.path)[0].open_input_file(part.path) as raw:
            file = io.BufferedReader(raw)
            at = max(0, part.start - len(END) - 3)  # a line break before, the ending line and its own break
            file.seek(at)
            if at:
                at += len(file.readline())
            own, lines = part.start == 0, []
            for line in file:
                at += len(line)
                ends = line.rstrip(b"\r\n") == END
                if own:
                    lines.append(line)
                if ends and own:
                    yield lines
                    lines = []
                if ends and at >= part.end:
                    return
                own = own or (ends and at >= part.start)
            if lines:
                yield lines

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = []
        for lines in self.records(partition):
            path = next((x[3:].rstrip(b"\r\n").decode("utf-8", "replace") for x in lines if x.startswith(b"SF:")), "")
            for line in lines if path else ():
                if hit := HIT.match(line):
                    rows.append((path, int(hit[1]), int(hit[2]), None, None))
                elif way := BRANCH.match(line):
                    rows.append((path, int(way[1]), None, f"{way[2].decode()}:{way[3].decode()}", way[4] not in (b"-", b"0")))
            if len(rows) >= BATCH_ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), LCOV.types)], schema=LCOV)


class LcovSource(DataSource):
    """Lines (path, line, hits) and branches (path, line, branch_id, taken) of a report or a folder of reports.

    A row is of one kind, with nulls in the columns of the other. Option ``splitBytes``: bytes of a range.
    """

    @classmethod
    def name(cls) -> str:
        return "lcov"

    def schema(self) -> str:
        return "path string, line int, hits long, branch_id string, taken boolean"

    def reader(self, schema) -> LcovReader:
        return LcovReader(self.options)


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its place, its first result, the file of the others, and of each rule (order, title) of the first."""

    place: int
    file: str
    first: str | None
    rules: dict[str, tuple] = field(default_factory=dict)


class SarifWriter(DataSourceArrowWriter):
    """Tasks write their results, each with a comma before it, but for the first; the commit, which knows which tasks
    have any, writes those first ones, the head with the rules, and the end. Rules are one entry each, a few.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.tool, self.overwrite = options["path"], options.get("tool", "repolith"), overwrite
        self.staging = f"_staging-{uuid4().hex}"
        system, path = located(self.path)
        if not overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} exists, and a document cannot be appended to")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        place = TaskContext.get().partitionId()
        system, path = located(self.path)
        system.create_dir(f"{path}/{self.staging}", recursive=True)
        part = Part(place, f"{self.staging}/{place}-{uuid4().hex}", None)  # its own name: the task may run twice
        with system.open_output_stream(f"{path}/{part.file}") as out:
            for rows in iterator:
                for r in rows.to_pylist():
                    key = (r["seq"], r["title"])
                    part.rules[r["rule_id"]] = min(part.rules.get(r["rule_id"], key), key)
                    if part.first is None:
                        part.first = r["result"]
                    else:
                        out.write(f",{r['result']}\n".encode())
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, path = located(self.path)
        parts = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.place)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    system.delete_file(old.path)
        rules = {}
        for rule, key in (x for m in parts for x in m.rules.items()):
            rules[rule] = min(rules.get(rule, key), key)
        listed = [{"id": rule, "shortDescription": {"text": title}} for rule, (_, title) in sorted(rules.items())]
        head = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}
        driver = json.dumps({"name": self.tool, "rules": listed})
        self.put(system, f"{path}/part-000000-0", f'{json.dumps(head)[:-1]}, "runs": [{{"tool": {{"driver": {driver}}}, "results": [\n')
        for n, m in enumerate(parts, 1):
            self.put(system, f"{path}/part-{n:06d}-0", f"{',' if n > 1 else ''}{m.first}\n")
            system.move(f"{path}/{m.file}", f"{path}/part-{n:06d}-1")
        self.put(system, f"{path}/part-{len(parts) + 1:06d}-0", "]}]}\n")
        self.clear(system, path)

    def abort(self, messages: list[Part | None]) -> None:
        self.clear(*located(self.path))

    def clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staging}")

    @staticmethod
    def put(system: fs.FileSystem, path: str, text: str) -> None:
        with system.open_output_stream(path) as out:
            out.write(text.encode())


class SarifSink(DataSource):
    """One SARIF document of (rule_id, title, seq, result) rows: the files ``part-*`` in order of name make it up.

    Results come in the order of the rows. Option ``tool``: the tool's name. Modes: overwrite, or append to a new path.
    """

    @classmethod
    def name(cls) -> str:
        return "sarif"

    def writer(self, schema, overwrite: bool) -> SarifWriter:
        return SarifWriter(self.options, overwrite)


def sarif_rows(findings: DataFrame) -> DataFrame:
    """(rule_id, title, seq, result) in the order of a report: what the ``sarif`` format takes."""
    rows = sinks.sarif_results(findings).orderBy("rule_id", "seq")
    return rows.select("rule_id", "title", F.col("seq").cast("long").alias("seq"), sinks.sarif_result(rows).alias("result"))


def register(spark: SparkSession) -> None:
    for source in (LcovSource, SarifSink):
        spark.dataSource.register(source)
