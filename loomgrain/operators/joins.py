"""Joins on ranges and on names, cut into equi-joins over buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.session import cut_lineage


def enclosing_span(points: DataFrame, spans: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Each point with the tightest span of its keys that holds it (ties: the later start, then the least id).

    ``points(*keys, point)`` plus any columns; ``spans(*keys, span_id, start, end)``. A span is listed in each bucket
    of ``width`` positions that it touches, so the join is on equality and only neighbours are compared.
    """
    bucketed = spans.where("start <= end").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    marked = points.withColumn("_b", F.floor(F.col("point") / width))
    ids = [c for c in points.columns]
    met = marked.join(bucketed, [*keys, "_b"], "left").where("span_id is null or (point between start and end)")
    inside = met.where("span_id is not null").groupBy(*ids).agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), (-F.col("start")).alias("s"), "span_id")).alias("best"))
    return inside.select(*ids, F.col("best.span_id").alias("span_id"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at_left: str, at_right: str, reach: int) -> DataFrame:
    """Pairs of equal keys whose positions differ by at most ``reach``.

    The left side visits its bucket and both neighbours, the right side stays in its own.
    """
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(at_left) / reach) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_b", F.floor(F.col(at_right) / reach))
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col(at_left) - F.col(at_right)) <= reach).drop("_b")


def resolve_names(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol each used name means: one of the same file, else one that is unique in all files, else none.

    ``uses(use_id, file, name)``, ``symbols(symbol_id, file, name)``; of several in the same file the least id.
    """
    here = symbols.groupBy("file", "name").agg(F.min("symbol_id").alias("here"))
    anywhere = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("only")).where("n = 1").select("name", "only")
    met = uses.join(here, ["file", "name"], "left").join(anywhere, "name", "left")
    return met.select("use_id", F.coalesce("here", "only").alias("symbol_id"))


def resolve_packages(calls: DataFrame, imports: DataFrame, categories: DataFrame) -> DataFrame:
    """``(file_id, name, package, category)``: the package behind a call's receiver and what the call does there.

    ``calls(file_id, name)``, ``imports(file_id, local, package)``, ``categories(package, method, category)``; a call whose
    receiver is not imported has no package, one that the table does not name no category.
    """
    parts = calls.select("file_id", "name", F.substring_index(F.replace("name", F.lit("::"), F.lit(".")), ".", 1).alias("local"), F.regexp_extract("name", r"([^.:]*)!?$", 1).alias("method")).distinct()
    named = parts.join(imports.select("file_id", "local", "package").distinct(), ["file_id", "local"], "left")
    return named.join(categories, ["package", "method"], "left").select("file_id", "name", "package", "category")


def resolve_aliases(assignments: DataFrame, rounds: int = 8) -> DataFrame:
    """``(fn, var, target)``: what each plain alias ``var = other`` stands for in the end, per function.

    ``assignments(fn, var, value)``; a name assigned more than once is no alias. Targets jump to their targets, so chains
    of 2^rounds are followed; a cycle keeps some name of itself.
    """
    plain = assignments.groupBy("fn", "var").agg(F.count("*").alias("n"), F.min("value").alias("target")).where("n = 1").where(F.col("target").rlike(r"^[A-Za-z_$][\w$]*$")).select("fn", "var", "target")
    for _ in range(rounds):
        far = plain.select("fn", F.col("var").alias("target"), F.col("target").alias("far"))
        step = plain.join(far, ["fn", "target"], "left").select("fn", "var", F.coalesce("far", "target").alias("target"), (F.col("far").isNotNull() & (F.col("far") != F.col("target"))).alias("moved"))
        step = cut_lineage(step)
        plain = step.select("fn", "var", "target")
        if step.where("moved").isEmpty():
            break
    return plain


def vulnerable_dependencies(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies ``(path, package, version)`` with an advisory ``(package, below, severity, title)``: a lower version, or a null ``below``.

    Versions compare by their leading numbers; one that has none is taken as affected.
    """
    number = lambda c: F.transform(F.slice(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), 1, 3), lambda x: x.cast("int"))
    met = dependencies.join(advisories, "package")
    have, limit = number("version"), number("below")
    return met.where(F.col("below").isNull() | (F.size(have) == 0) | (have < limit)).select("path", "package", "version", "below", "severity", "title")
