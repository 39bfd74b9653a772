"""Registry, profiles and scans: rules chosen by profile or by id run over a context, with events along the way."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame

from repolith.functions import dims
from repolith.operators import metrics
from repolith.plans.rules import RULES, Context, Rule, diagnostics


class ScanCancelled(Exception):
    pass


class Registry:
    """Rules by id; registering an id again replaces its rule in place."""

    def __init__(self, rules: list[Rule] = RULES):
        self.rules = {r.id: r for r in rules}

    def register(self, rule: Rule) -> None:
        self.rules[rule.id] = rule

    def chosen(self, profile: str = "standard", ids: list[str] | None = None) -> list[Rule]:
        """By id in the order asked for, unknown ids left out; else by the profile's categories."""
        if ids is not None:
            return [self.rules[i] for i in ids if i in self.rules]
        return [r for r in self.rules.values() if r.category in dims.PROFILES[profile]]


@dataclass
class ScanResult:
    findings: DataFrame | None
    evidence: DataFrame | None
    analyzers_run: list[str]
    summary: DataFrame | None
    diagnostics: DataFrame | None = None


@dataclass
class Engine:
    registry: Registry = field(default_factory=Registry)
    listeners: list[Callable[[str, dict], None]] = field(default_factory=list)
    cancelled: threading.Event = field(default_factory=threading.Event)
    #: Seconds after which a scan cancels itself.
    timeout: float | None = None
    tag: str = field(default_factory=lambda: f"scan-{uuid4().hex}")
    context: object = None

    def emit(self, kind: str, **data) -> None:
        for listener in self.listeners:
            listener(kind, data)

    def cancel(self) -> None:
        """Stop the scan, from any thread: no further rule begins, and the jobs of the one at work are cancelled."""
        self.cancelled.set()
        if self.context is not None:
            self.context.cancelJobsWithTag(self.tag)

    def scan(self, ctx: Context, profile: str = "standard", ids: list[str] | None = None) -> ScanResult:
        """Findings of all rules that support the context, with diagnostics of those that do not.

        The Spark jobs that rules start carry the engine's tag, by which ``cancel`` and the timeout find them.
        """
        self.emit("scan:started")
        findings = evidence = None
        ran = []
        frames = [*ctx.tables.values(), *(edges for _, edges in ctx.graphs.values())]
        self.context = frames[0].sparkSession.sparkContext if frames else None
        timer = threading.Timer(self.timeout, self.cancel) if self.timeout else None
        try:
            if timer:
                timer.start()
            if self.context is not None:
                self.context.addJobTag(self.tag)
            self.emit("stage:started", stage="analyze")
            for rule in self.registry.chosen(profile, ids):
                if self.cancelled.is_set():
                    raise ScanCancelled
                if not rule.supports(ctx):
                    continue
                self.emit("analyzer:started", id=rule.id)
                f, e = rule.run(ctx)
                findings = f if findings is None else findings.unionByName(f)
                evidence = e if evidence is None else evidence.unionByName(e)
                ran.append(rule.id)
                self.emit("analyzer:completed", id=rule.id)
            if self.cancelled.is_set():
                raise ScanCancelled
            self.emit("stage:completed", stage="analyze")
        except Exception as e:
            if self.cancelled.is_set():  # what a cancelled job raises, too
                self.emit("scan:cancelled")
                raise ScanCancelled from e
            self.emit("scan:failed", error=str(e))
            raise
        finally:
            if timer:
                timer.cancel()
            if self.context is not None:
                self.context.removeJobTag(self.tag)
        self.emit("scan:completed")
        return ScanResult(findings, evidence, ran, metrics.summary(findings) if findings is not None else None, diagnostics(ctx, self.registry.chosen(profile, ids)))
