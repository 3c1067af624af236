"""Readers: source trees, example libraries, reports, configuration and manifests. All with explicit schemas."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import features as X

FINDING_SCHEMA = (
    "rule_id string, severity string, path string, line long, column long, symbol string, content string, observation string, impact string, improvement string, "
    "confidence double, tags array<string>, requires_human boolean, auto_fixable boolean, fingerprint string"
)
LABEL_SCHEMA = "id string, file string, line long, cwe string, owasp string, type string"
CALIBRATION_SCHEMA = "scope string, key string, a double, b double, n_samples long, accuracy double"


def scan_directory(spark: SparkSession, root: str, extensions: list[str] | None = None, tests: bool = False) -> DataFrame:
    """``(path, content, ext, language, size_bytes, content_sha)`` of the source files below ``root``.

    Sizes and names are filtered before any content is decoded; skipped folders, large files, bundles, files in no
    known language and (unless ``tests``) test files are left out. Paths are relative to ``root``.
    """
    base = F.regexp_replace("path", r"^\w+:/*", "/")
    prefix = str(Path(root).resolve()).rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.withColumn("path", F.replace(base, F.lit(prefix), F.lit("")))
    path = F.col("path")
    wanted = X.scanned(path, F.col("length")) & (X.language_of(path) != "unknown")
    if not tests:
        wanted = wanted & ~X.is_test_file(path)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    if extensions:
        wanted = wanted & ext.isin(extensions)
    return rows.where(wanted).select(path, F.decode("content", "UTF-8").alias("content"), ext.alias("ext"), X.language_of(path).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_sha"))


def listed_files(files: DataFrame, paths: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """The files of an explicit list ``(path)``, without those whose content the manifest ``(path, content_sha)`` has."""
    kept = files.join(paths.select("path").distinct(), "path", "left_semi")
    return kept if manifest is None else kept.join(manifest.select("path", "content_sha"), ["path", "content_sha"], "left_anti")


def paths_of_diff(diff: DataFrame) -> DataFrame:
    """``(path)`` of the files that unified diffs ``(value: one line a row)`` leave behind, deleted ones not among them."""
    name = F.regexp_extract("value", r"^\+\+\+ (?:b/)?([^\t\r]+)", 1)
    return diff.select(name.alias("path")).where("path not in ('', '/dev/null')").distinct()


def single_file(spark: SparkSession, path: str, content: str) -> DataFrame:
    """One virtual file, as a scan would give it."""
    rows = spark.createDataFrame([(path, content)], "path string, content string")
    return rows.select("path", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), X.language_of(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("content_sha"))


def example_files(files: DataFrame, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labelled examples from file names ``<id>_positive.<ext>`` and ``<id>_negative[2-9].<ext>``, and the patterns left out.

    Numbered positives belong to their pattern, unless ``strict_compat``, where only the bare suffix does. Returns
    ``(pattern_id, polarity, path, ext, content)`` and warnings ``(pattern_id, message)`` for one-sided patterns.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    shape = r"^(.+)_(positive|negative)[2-9]?$" if not strict_compat else r"^(.+)_(positive(?![2-9])|negative)[2-9]?$"
    named = files.withColumns({"pattern_id": F.regexp_extract(stem, shape, 1), "polarity": F.regexp_extract(stem, shape, 2)}).where("pattern_id != ''")
    sides = named.groupBy("pattern_id").agg(F.countDistinct("polarity").alias("n"), F.min("polarity").alias("only"))
    kept = named.join(sides.where("n = 2").select("pattern_id"), "pattern_id", "left_semi")
    warnings = sides.where("n = 1").select("pattern_id", F.concat(F.lit("has only "), "only", F.lit(" examples")).alias("message"))
    return kept.select("pattern_id", "polarity", "path", "ext", "content"), warnings


def advisory_fields(content: Column, tag: str = "advisory") -> Column:
    """Map of ``key: value`` lines in the comment block that a ``[tag]`` line opens; the block ends at the first other line."""
    block = F.regexp_extract(content, r"(?m)^\s*(?://|#|\*)\s*\[" + re.escape(tag) + r"\]\s*\n((?:\s*(?://|#|\*)[^\n]*\n?)*)", 1)
    lines = F.regexp_extract_all(block, F.lit(r"(?:^|\n)\s*(?://|#|\*)\s*(\w+:[^\n]*)"), 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^\w+:", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p.v != ""))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON array or of JSON lines."""
    return spark.read.schema(FINDING_SCHEMA).option("multiLine", "true").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).option("multiLine", "true").json(path)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """``(rule_id, path, line, level)`` of the results of SARIF logs."""
    region = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: long>>>"
    schema = f"runs array<struct<results: array<struct<ruleId: string, level: string, locations: array<{region}>>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    results = rows.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.try_element_at("r.locations", F.lit(1)).physicalLocation
    return results.select(F.col("r.ruleId").alias("rule_id"), place.artifactLocation.uri.alias("path"), place.region.startLine.alias("line"), "r.level")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Usable calibration rows: some samples, some accuracy."""
    return spark.read.schema(CALIBRATION_SCHEMA).option("multiLine", "true").json(path).where("n_samples > 0 and accuracy > 0")


def dependencies(files: DataFrame) -> DataFrame:
    """``(path, package, version)`` from package.json, Cargo.toml and Cargo.lock rows of ``files(path, content)``."""
    name = F.substring_index("path", "/", -1)
    kinds = "struct<dependencies: map<string,string>, devDependencies: map<string,string>, peerDependencies: map<string,string>>"
    doc = F.from_json("content", kinds)
    none = F.create_map().cast("map<string,string>")
    node = None
    for k in ("dependencies", "devDependencies", "peerDependencies"):
        part = files.where(name == "package.json").select("path", F.explode(F.coalesce(doc[k], none)).alias("package", "version"))
        node = part if node is None else node.unionByName(part)
    toml = F.regexp_extract(F.coalesce("content", F.lit("")), r"(?s)\[dependencies\]\n(.*?)(?:\n\[|\z)", 1)
    lines = F.regexp_extract_all(toml, F.lit(r'(?m)^([\w-]+\s*=\s*[^\n]*)$'), 1)
    cargo = files.where(name == "Cargo.toml").select("path", F.explode(lines).alias("l")).select("path", F.trim(F.substring_index("l", "=", 1)).alias("package"), F.regexp_extract("l", r'"([^"]*)"', 1).alias("version"))
    entries = F.regexp_extract_all("content", F.lit(r'(name = "[^"]+"\nversion = "[^"]+")'), 1)
    lock = files.where(name == "Cargo.lock").select("path", F.explode(entries).alias("e")).select("path", F.regexp_extract("e", r'name = "([^"]+)"', 1).alias("package"), F.regexp_extract("e", r'version = "([^"]+)"', 1).alias("version"))
    return node.unionByName(cargo).unionByName(lock).distinct()


def unknown_imports(imports: DataFrame, declared: DataFrame, builtin: list[str]) -> DataFrame:
    """Imports ``(file_id, package)`` of packages that are neither declared, built in nor relative; a scoped or sub-path import counts as its package."""
    base = F.when(F.col("package").startswith("@"), F.regexp_extract("package", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index("package", "/", 1))
    rows = imports.where(~F.col("package").rlike(r"^[./]")).withColumn("_base", base).where(~F.col("_base").isin(builtin))
    return rows.join(declared.select(F.col("package").alias("_base")).distinct(), "_base", "left_anti").drop("_base")


def read_config(path: str) -> dict:
    """Project settings: ``disabled_rules``, ``severity_override``, ``suppressions`` (rule, glob). A missing file has none.

    JSON, or the plain subset of YAML that such files use: keys, lists of scalars or of small maps.
    """
    p = Path(path)
    if not p.exists():
        return {}
    text = p.read_text()
    try:
        return json.loads(text)
    except ValueError:
        return _plain_yaml(text)


def read_sidecar(path: str) -> dict:
    """Overrides of a pattern beside its examples, in TOML; a missing file has none."""
    p = Path(path)
    return tomllib.loads(p.read_text()) if p.exists() else {}


def union_libraries(spark: SparkSession, roots: list[str], strict_compat: bool = False) -> DataFrame:
    """Examples of several folders; of a pattern that more than one has, all count."""
    frames = [example_files(scan_directory(spark, r, tests=True), strict_compat)[0] for r in roots]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def import_table(files: DataFrame) -> DataFrame:
    """``(file_id, local, package)`` of default, namespace and named imports and of requires in script files ``(file_id, content)``."""
    text = F.coalesce("content", F.lit(""))
    es = F.regexp_extract_all(text, F.lit(r"""(import\s+[^;'"]+\s+from\s+['"][^'"]+['"])"""), 1)
    cjs = F.regexp_extract_all(text, F.lit(r"""((?:const|let|var)\s+[\w${},\s]+=\s*require\(\s*['"][^'"]+['"]\s*\))"""), 1)
    rows = files.select("file_id", F.explode(F.array_union(es, cjs)).alias("s"))
    package = F.regexp_extract("s", r"""['"]([^'"]+)['"]\s*\)?$""", 1)
    names = F.regexp_replace(F.regexp_extract("s", r"^(?:import|const|let|var)\s+(?:type\s+)?(.+?)\s*(?:from|=)\s*", 1), r"[{}]|\*\s+as\s+", " ")
    parts = F.split(names, ",")
    return rows.select("file_id", package.alias("package"), F.explode(parts).alias("p")).select("file_id", F.regexp_extract("p", r"([\w$]+)\s*$", 1).alias("local"), "package").where("local != ''").distinct()


def _plain_yaml(text: str) -> dict:
    out, key, item = {}, None, None
    scalar = lambda s: s.strip().strip("'\"")
    for line in text.split("\n"):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent, word = len(body) - len(body.lstrip()), body.strip()
        if indent == 0 and not word.startswith("-"):
            key, _, value = word.partition(":")
            out[key], item = (scalar(value) if value.strip() else None), None
        elif word.startswith("-"):
            if not isinstance(out.get(key), list):
                out[key] = []
            k, sep, v = word[1:].strip().partition(":")
            item = {k.strip(): scalar(v)} if sep else None
            out[key].append(item if sep else scalar(word[1:]))
        else:
            k, _, v = word.partition(":")
            if item is not None:
                item[k.strip()] = scalar(v)
            else:
                if not isinstance(out.get(key), dict):
                    out[key] = {}
                out[key][k.strip()] = scalar(v)
    return out


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a baseline: JSON, or a plain YAML list of findings where the text is no JSON."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None or text.value.lstrip()[:1] in ("", "[", "{"):
        return read_findings(spark, path)
    rows = [{k: int(v) if str(v).isdigit() else v for k, v in r.items()} for r in _plain_yaml("rows:\n" + "\n".join("  " + line for line in text.value.split("\n"))).get("rows") or []]
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.from_json("value", FINDING_SCHEMA, {"primitivesAsString": "false"}).alias("f")).select("f.*")


def write_profile(profile: DataFrame, path: str) -> None:
    """A learned profile as Parquet by language."""
    profile.write.mode("overwrite").partitionBy("language").parquet(path)


def read_profile(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """A learned profile; with ``languages`` only their folders are read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("language").isin(languages)) if languages else rows


# Packages known to be unsafe where no audit report is at hand, by the first version that is safe.
KNOWN_UNSAFE = [
    ("lodash", "4.17.21", "npm"), ("minimist", "1.2.6", "npm"), ("node-fetch", "2.6.7", "npm"), ("axios", "0.21.2", "npm"), ("jsonwebtoken", "9.0.0", "npm"), ("express", "4.17.3", "npm"),
    ("time", "0.2.23", "cargo"), ("chrono", "0.4.20", "cargo"), ("hyper", "0.14.10", "cargo"), ("tokio", "1.8.4", "cargo"),
]


def advisory_table(spark: SparkSession) -> DataFrame:
    """``(package, below, severity, title)`` of the built-in list, to join where no audit report was read."""
    rows = [(package, below, "unknown", f"{source} package before {below}") for package, below, source in KNOWN_UNSAFE]
    return spark.createDataFrame(rows, "package string, below string, severity string, title string")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """``(package, severity, source)`` of audit reports in JSON, in the form of either package manager."""
    text = spark.read.text(path, wholetext=True)
    node = F.from_json("value", "struct<vulnerabilities: map<string, struct<severity: string>>>")
    npm = text.select(F.explode(node.vulnerabilities).alias("package", "v")).select("package", F.col("v.severity").alias("severity"), F.lit("npm").alias("source"))
    crate = F.from_json("value", "struct<vulnerabilities: struct<list: array<struct<advisory: struct<package: string, severity: string>>>>>")
    cargo = text.select(F.explode(crate.vulnerabilities.list).alias("v")).select(F.col("v.advisory.package").alias("package"), F.col("v.advisory.severity").alias("severity"), F.lit("cargo").alias("source"))
    return npm.unionByName(cargo).where("package is not null").distinct()


def workspace_dependencies(files: DataFrame) -> DataFrame:
    """``(path, package, version, inherited)``: dependencies of every manifest, and those of the manifests above it, the nearest one's version first.

    A manifest sees those of all folders it lies in. Folders are matched by equality on each of its ancestors.
    """
    own = dependencies(files)
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    at = files.where(F.substring_index("path", "/", -1).isin("package.json", "Cargo.toml")).select("path", folder("path").alias("folder"))
    parts = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = at.select("path", "folder", F.explode(F.array_distinct(chain)).alias("up"))
    met = above.join(own.select(folder("path").alias("up"), "package", "version"), "up")
    best = met.groupBy("path", "folder", "package").agg(F.max_by(F.struct("version", "up"), F.length("up")).alias("b"))
    return best.select("path", "package", F.col("b.version").alias("version"), (F.col("b.up") != F.col("folder")).alias("inherited"))
