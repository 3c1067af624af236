"""Per-file and per-function features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import text as T

# Extensions, folders that are not scanned, and words of paths and texts that tell a file's context.
EXTENSION_LANGUAGE = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "rs": "rust", "py": "python"}
SKIPPED_FOLDERS = "target node_modules dist build vendor out .next .nuxt .cache coverage cypress playwright storybook-static frontend".split()
SKIPPED_SUFFIXES = ".min.js .bundle.js .chunk.js .debug.js".split()
MOST_BYTES = 500_000
TEST_SUFFIXES = ".test.ts .test.tsx .test.js .test.jsx .spec.ts .spec.tsx .spec.js .spec.jsx _test.rs .test.rs".split()
TEST_FOLDERS = ["/tests/", "/test/", "__tests__/", "/__mocks__/", "/mocks/"]
TEST_PATHS = ["test", "spec", "cypress", "__tests__", "tests/"]
TEST_TEXTS = [
    "describe(", " it(", "\nit(", "test(", "#[test]", "#[tokio::test]", "cfg(test)", "func test", "testing.t", "@test", "[test]", "[fact]", "test_f(", "expect_eq(", "assert_eq(",
]
ROUTE_PATHS = ["route", "controller", "handler", "endpoint", "api/"]
ROUTE_TEXTS = [
    "(req, res)", "(req, res,", "(req, res ", "req: request", "request, response", "app.get(", "app.post(", "app.put(", "app.delete(", "app.patch(",
    "router.", "res.send", "res.json", "res.redirect", "res.render", "res.status", "c.req", "http.responsewriter", "*http.request", "http.handlefunc",
    "gin.context", "echo.context", "c.json", "#[get(", "#[post(", "actix_web", "rocket::", "axum::", "httpresponse", "impl responder", "@getmapping",
    "@postmapping", "@requestmapping", "httpservletrequest", "responseentity", "[httpget]", "[httppost]", "[route(", "controllerbase", "iactionresult",
]
MOCK_PATHS, CONFIG_PATHS, UTILITY_PATHS = ["mock", "stub"], ["config", "settings"], ["lib", "util", "helper"]
SENSITIVE = {
    "high": ["password", "secret", "jwt", "token", "creditcard", "apikey"],
    "medium": ["email", "user", "profile"],
    "low": ["version", "metric", "telemetry"],
}


def any_of(c: Column, words: list[str]) -> Column:
    """Whether ``c`` contains any of the words (a built-in search per word, no pattern)."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for e, lang in EXTENSION_LANGUAGE.items():
        out = out.when(ext == e, lang)
    return out.otherwise("unknown")


def scanned(path: Column, size: Column) -> Column:
    """Whether a directory scan takes the file: no skipped or hidden folder, not too large, no bundle."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    skipped = F.exists(folders, lambda f: f.isin(SKIPPED_FOLDERS) | f.startswith("."))
    bundle = reduce(lambda a, b: a | b, [path.endswith(s) for s in SKIPPED_SUFFIXES])
    return ~skipped & ~bundle & (size <= MOST_BYTES)


def is_test_file(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    suffix = reduce(lambda a, b: a | b, [name.endswith(s) for s in TEST_SUFFIXES])
    return suffix | any_of(path, TEST_FOLDERS) | stem.startswith("mock") | F.lower(stem).endswith(".mock")


def environment(path: Column, content: Column) -> Column:
    """test, mock, config, route_handler, utility or unknown; the first that fits."""
    p, c = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    return (
        F.when(any_of(p, TEST_PATHS) | any_of(c, TEST_TEXTS), "test")
        .when(any_of(p, MOCK_PATHS), "mock")
        .when(any_of(p, CONFIG_PATHS), "config")
        .when(any_of(p, ROUTE_PATHS) | any_of(c, ROUTE_TEXTS), "route_handler")
        .when(any_of(p, UTILITY_PATHS), "utility")
        .otherwise("unknown")
    )


def sensitivity(content: Column) -> Column:
    c = F.lower(F.coalesce(content, F.lit("")))
    out = None
    for level, words in SENSITIVE.items():
        out = (F.when if out is None else out.when)(any_of(c, words), level)
    return out.otherwise("unknown")


def frameworks(content: Column) -> Column:
    c = F.lower(F.coalesce(content, F.lit("")))
    tests = {
        "Express": c.contains("express") | (c.contains("req") & c.contains("res")),
        "React": c.contains("react") | c.contains("jsx"),
        "GoWeb": c.contains("gin") | c.contains("echo"),
        "RustWeb": any_of(c, ["actix", "rocket", "axum"]),
        "Spring": c.contains("spring") | c.contains("controller"),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


def token_features(files: DataFrame, window: int = 5) -> DataFrame:
    """Counts of tokens, of control words by family and of distinct token windows (plain, positional, normalised)."""
    toks, norm = T.tokens(F.col("content")), T.normalized_tokens(F.col("content"))
    rows = files.select("file_id", toks.alias("toks"), norm.alias("norm"))

    def equal_to(name: str):
        return lambda t: t == name

    families = [F.size(F.filter("norm", equal_to(name))).cast("long").alias(f"{name}_tokens") for name in T.TOKEN_FAMILIES]
    return rows.select(
        "file_id", F.size("toks").cast("long").alias("tokens"), *families,
        F.size(T.ngram_hashes(F.col("norm"), window)).cast("long").alias("ngrams"),
        F.size(T.positional_ngram_hashes(F.col("norm"), window)).cast("long").alias("positional_ngrams"),
        F.element_at(F.concat(T.ngram_hashes(F.col("norm"), window), F.array(F.lit(-1).cast("long"))), 1).alias("least_hash"),
    )


def snippets(files: DataFrame, marks: DataFrame, around: int = 5) -> DataFrame:
    """The lines around a mark ``(file_id, line)``, numbered, the marked one with an arrow.

    Slices the line array of the marked file: no row per line is ever made.
    """
    lines = F.split("content", "\n")
    joined = marks.join(files.select("file_id", lines.alias("lines")), "file_id").where(F.col("line").between(1, F.size("lines")))
    first = F.greatest(F.col("line") - around, F.lit(1)).cast("int")
    count = (F.least(F.col("line") + around, F.size("lines")) - first + 1).cast("int")
    text = F.transform(F.slice("lines", first, count), lambda x, i: F.concat(F.when(first + i == F.col("line"), "> ").otherwise("  "), (first + i).cast("string"), F.lit(": "), x))
    return joined.select("file_id", "line", F.array_join(text, "\n").alias("snippet"))


def suppressed_lines(files: DataFrame, marker: str = "lint:ignore") -> DataFrame:
    """Lines ``(file_id, line)`` that a marker comment on the same or one of the two lines before switches off."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    w = Window.partitionBy("file_id").orderBy("pos").rowsBetween(-2, 0)
    marked = lines.withColumn("off", F.max(F.col("text").contains(marker)).over(w)).where("off")
    return marked.select("file_id", (F.col("pos") + 1).cast("long").alias("line"))
