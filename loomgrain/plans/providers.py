"""Semantic providers: how a language's files become functions and how names in them are classified. One is chosen per file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.operators import frontend, registry, roles
from loomgrain.sources.readers import import_table


def _no_imports(files: DataFrame) -> DataFrame:
    return files.limit(0).select("file_id", F.lit("").alias("local"), F.lit("").alias("package"))


@dataclass(frozen=True)
class Provider:
    """``functions`` and ``imports`` turn files into tables; the others are column expressions over their rows."""

    name: str
    extensions: tuple[str, ...]
    functions: Callable[[DataFrame], DataFrame] = frontend.extract_functions
    imports: Callable[[DataFrame], DataFrame] = _no_imports
    classify_sink: Callable[[Column], Column] = registry.sink_category
    classify_param: Callable[[Column], Column] = field(default=lambda name: F.when(F.lower(name).isin(roles.REQUEST_PARAMS), "request"))
    is_handler: Callable[[], Column] = field(default=lambda: roles.function_role() == "handler")


class Providers:
    """A registry. A file goes to the first provider that knows its extension; files of none are left out."""

    def __init__(self, known: list[Provider] | None = None) -> None:
        self.known = list(known or [])

    def add(self, provider: Provider) -> Provider:
        self.known.append(provider)
        return provider

    def chosen(self, path: Column) -> Column:
        extension = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.(\w+)$", 1))
        out = F.lit(None).cast("string")
        for p in reversed(self.known):
            out = F.when(extension.isin(*p.extensions), p.name).otherwise(out)
        return out

    def _each(self, files: DataFrame, of: Callable[[Provider, DataFrame], DataFrame]) -> DataFrame:
        named = files.withColumn("_provider", self.chosen(F.col("file_path")))
        parts = [of(p, named.where(F.col("_provider") == p.name).drop("_provider")).withColumn("provider", F.lit(p.name)) for p in self.known]
        if not parts:
            raise ValueError("no provider is registered")
        return reduce(DataFrame.unionByName, parts)

    def functions(self, files: DataFrame) -> DataFrame:
        """Functions of all files with ``provider`` and ``is_handler``."""
        return self._each(files, lambda p, f: p.functions(f).withColumn("is_handler", F.coalesce(p.is_handler(), F.lit(False))))

    def sinks(self, files: DataFrame) -> DataFrame:
        """``(file_id, name, call, category, provider)``: calls that a provider takes for sinks."""

        def of(p: Provider, f: DataFrame) -> DataFrame:
            calls = p.functions(f).select("file_id", "name", F.explode("calls.name").alias("call"))
            return calls.withColumn("category", p.classify_sink(F.col("call"))).where("category is not null and category != 'unknown'")

        return self._each(files, of)

    def imports(self, files: DataFrame) -> DataFrame:
        return self._each(files, lambda p, f: p.imports(f))

    def resolve(self, files: DataFrame, names: DataFrame) -> DataFrame:
        """``names(file_id, local)`` with the package that the file imports the name from."""
        met = self.imports(files).select("file_id", "local", "package")
        return names.join(met, ["file_id", "local"], "left")


def standard() -> Providers:
    """The three that come with the package."""
    return Providers([
        Provider("script", ("ts", "tsx", "js", "jsx"), imports=lambda f: import_table(f)),
        Provider("rust", ("rs",)),
        Provider("python", ("py",)),
    ])
