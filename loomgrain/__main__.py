"""Command line: run a registered query over a folder of tables and report, filter or compare its rows."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from loomgrain.operators import findings as X
from loomgrain.session import build_session


@dataclass
class Options:
    """What the command line may set."""

    query: str = "pattern_findings"
    tables: str = "."
    out: str = ""
    format: str = "show"
    min_confidence: float = 0.0
    severity: str = ""
    tags: str = ""
    rules: str = ""
    scope: str = "all"
    baseline: str = ""
    disable: str = ""
    limit: int = 50
    list: bool = False


def parsed(argv: list[str] | None = None) -> Options:
    parser = argparse.ArgumentParser(prog="loomgrain", description=__doc__)
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(flag, action="store_true")
        else:
            parser.add_argument(flag, type=type(f.default), default=f.default)
    return Options(**vars(parser.parse_args(argv)))


def selected(rows: DataFrame, o: Options) -> DataFrame:
    """Rows after the filters for which they have the columns."""
    have = set(rows.columns)
    if "confidence" in have and o.min_confidence > 0:
        rows = rows.where(f"confidence >= {o.min_confidence}")
    if "severity" in have and o.severity:
        rows = X.at_least(rows, o.severity)
    if "rule_id" in have and o.rules:
        rows = rows.where(rows.rule_id.isin(o.rules.split(",")))
    if "rule_id" in have and o.disable:
        rows = rows.where(~rows.rule_id.isin(o.disable.split(",")))
    if "tags" in have:
        rows = X.fix_scope(rows, o.scope)
    return rows


def main(argv: list[str] | None = None, spark=None) -> int:
    from loomgrain.plans import catalog

    o = parsed(argv)
    if o.list:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if o.query not in catalog.QUERIES:
        print(f"unknown query {o.query}", file=sys.stderr)
        return 2
    spark = spark or build_session("loomgrain")
    rows = selected(catalog.QUERIES[o.query](spark, o.tables), o)
    if o.baseline:
        from loomgrain.sources import readers

        rows = X.without_known(rows, readers.read_baseline(spark, o.baseline))
    if o.format == "show":
        rows.show(o.limit, truncate=False)
    else:
        rows.write.format(o.format).mode("overwrite").save(o.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
