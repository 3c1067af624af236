"""Rules as plug-ins: named plans from a context of tables to findings, selected by metadata and run as one union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.operators.findings import SEVERITIES

Context = dict[str, DataFrame]
COLUMNS = ["path", "line", "content", "confidence"]


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str = "general"
    tags: tuple[str, ...] = ()
    check: Callable[[Context], DataFrame] = field(default=lambda context: None, compare=False)


class RuleSet:
    """A registry. A rule gives ``(path, line, content, confidence)``; the set adds id, severity, category and tags."""

    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}

    def rule(self, id: str, severity: str, category: str = "general", tags: tuple[str, ...] = ()) -> Callable:
        if severity not in SEVERITIES:
            raise ValueError(f"{severity} is no severity")

        def add(check: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
            self.rules[id] = Rule(id, severity, category, tags, check)
            return check

        return add

    def enabled(self, categories: set[str] | None = None, tags: set[str] | None = None, least: str = "info", disabled: set[str] = frozenset()) -> list[Rule]:
        rank = SEVERITIES.index(least)
        return [
            r for r in self.rules.values()
            if r.id not in disabled and SEVERITIES.index(r.severity) >= rank and (not categories or r.category in categories) and (not tags or tags & set(r.tags))
        ]

    def run(self, context: Context, **selection) -> DataFrame | None:
        """Findings of all enabled rules; None if none is."""
        parts = [
            r.check(context).select(*COLUMNS).withColumns({"rule_id": F.lit(r.id), "severity": F.lit(r.severity), "category": F.lit(r.category), "tags": F.array(*[F.lit(t) for t in r.tags]).cast("array<string>")})
            for r in self.enabled(**selection)
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None
