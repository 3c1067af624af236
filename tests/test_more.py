import pytest
from pyspark.sql import functions as F

from loomgrain.functions import scores as S
from loomgrain.functions import similarity as M
from loomgrain.functions import text as T
from loomgrain.operators import findings as N
from loomgrain.operators import joins, matching, sequence
from loomgrain.plans import catalog
from loomgrain.plans.rules import RuleSet
from loomgrain.sources import readers
from loomgrain.streaming import pipelines
from loomgrain.tables import latest_by_key


def test_more_text_functions(spark):
    html = "<form><input type='hidden' value='abc' name=\"_csrf\"></form>"
    r = spark.range(1).select(
        T.base_type_name(F.lit(": express.Request<A, B>")).alias("a"), T.base_type_name(F.lit("&mut Vec<String>")).alias("b"), T.injection_points(F.lit("req.body.id + req.query.q + req.body.id")).alias("p"),
        T.form_token(F.lit(html)).alias("t"), T.form_token(F.lit("<p>")).alias("n"), S.profile_boost(F.lit(0.8), F.lit(3), F.lit(10)).alias("s"),
    ).first()
    assert (r.a, r.b, r.p, r.t, r.n) == ("Request", "Vec", ["body.id", "query.q"], "abc", None) and (r.s.steady, r.s.diversity) == (pytest.approx(0.6), 0.5)


def test_skeleton_distance(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([], []), ([1], None)], "a array<bigint>, b array<bigint>")
    assert [r.d for r in df.select(M.skeleton_distance("a", "b").alias("d")).collect()] == pytest.approx([1 / 3, 0.0, 1.0])


def test_sequence_rule_table(spark):
    events = spark.createDataFrame([("u", 1, "lock"), ("u", 2, "unlock"), ("v", 1, "lock"), ("w", 1, "unlock"), ("w", 2, "lock"), ("u", 3, "fund")], "scope string, i int, t string")
    rules = spark.createDataFrame([("R1", "lock", "unlock"), ("R2", "fund", "entry")], "rule_id string, first string, second string")
    assert {(r.rule_id, r.scope) for r in sequence.broken_pairs(events, rules, ["scope"], ["i"], "t").collect()} == {("R1", "v"), ("R1", "w"), ("R2", "u")}
    calls = spark.createDataFrame([("m.lock",), ("m.unlock",), ("x",), ("Mutex::acquire",)], "name string")
    assert [r.event_type for r in sequence.resource_events(calls).collect()] == ["acquire", "release", "call", "acquire"]


def test_packages_aliases_and_advisories(spark):
    files = spark.createDataFrame([(1, "import fs, { exec as run, spawn } from 'child_process';\nimport * as p from 'path';\nconst axios = require('axios');\n"), (2, None)], "file_id long, content string")
    imports = readers.import_table(files)
    assert {(r.local, r.package) for r in imports.collect()} == {("fs", "child_process"), ("run", "child_process"), ("spawn", "child_process"), ("p", "path"), ("axios", "axios")}
    calls = spark.createDataFrame([(1, "axios.get"), (1, "x.y")], "file_id long, name string")
    categories = spark.createDataFrame([("axios", "get", "fetch")], "package string, method string, category string")
    assert {(r["name"], r.package, r.category) for r in joins.resolve_packages(calls, imports, categories).collect()} == {("axios.get", "axios", "fetch"), ("x.y", None, None)}
    assigned = spark.createDataFrame([("f", "a", "b"), ("f", "b", "c"), ("f", "c", "d"), ("f", "e", "g(1)"), ("f", "h", "i"), ("f", "h", "j")], "fn string, var string, value string")
    assert {(r["var"], r.target) for r in joins.resolve_aliases(assigned).collect()} == {("a", "d"), ("b", "d"), ("c", "d")}
    deps = spark.createDataFrame([("p", "lodash", "^4.17.10"), ("p", "lodash", "4.18.0"), ("p", "left", "1")], "path string, package string, version string")
    advisories = spark.createDataFrame([("lodash", "4.17.21", "critical", "t")], "package string, below string, severity string, title string")
    assert [r.version for r in joins.vulnerable_dependencies(deps, advisories).collect()] == ["^4.17.10"]


def test_known_findings_and_bands(spark):
    f = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None), ("d", "y")], "rule_id string, fingerprint string")
    base = spark.createDataFrame([("x",), ("",)], "fingerprint string")
    assert sorted(r.rule_id for r in N.without_known(f, base).collect()) == ["b", "c", "d"]
    assert sorted(r.rule_id for r in N.without_known(f, base, strict_compat=True).collect()) == ["d"]
    assert matching.effective_bands(120, 40, 12, strict_compat=True) == 10 and matching.effective_bands(24, 8, 3) == 8
    with pytest.raises(ValueError):
        matching.effective_bands(120, 40, 12)


def test_diff_paths_and_correlation(spark, tmp_path):
    lines = ["--- a/x.ts", "+++ b/x.ts", "@@ -1 +1 @@", "-a", "+b", "--- a/y.ts", "+++ /dev/null"]
    assert [r.path for r in readers.paths_of_diff(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == ["x.ts"]
    sent = spark.sql("select 'p' || id probe_id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) sent_at from range(3)")
    got = spark.sql("select * from values ('p0', timestamp '2024-01-01 00:00:00.3'), ('p1', timestamp '2024-01-01 00:00:05'), ('zz', timestamp '2024-01-01 00:00:01') t(payload_id, received_at)")
    for name, df in (("sent", sent), ("got", got)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    q = pipelines.correlate(*[pipelines.file_stream(spark, str(tmp_path / n), df.schema) for n, df in (("sent", sent), ("got", got))]).writeStream.outputMode("append").format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.probe_id for r in spark.sql("select probe_id from hits").collect()] == ["p0"]


def test_sidecars_and_several_libraries(spark, tmp_path):
    (tmp_path / "p.toml").write_text('severity = "critical"\n')
    assert readers.read_sidecar(str(tmp_path / "p.toml")) == {"severity": "critical"} and readers.read_sidecar(str(tmp_path / "q.toml")) == {}
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / f"{d}_positive.ts").write_text("x")
        (tmp_path / d / f"{d}_negative.ts").write_text("y")
    assert {r.pattern_id for r in readers.union_libraries(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()} == {"a", "b"}


def test_rules_are_plug_ins(spark):
    rules = RuleSet()

    @rules.rule("NO_EVAL", "critical", "security", ("injection",))
    def no_eval(context):
        return context["files"].where(F.col("content").contains("eval(")).select("path", F.lit(1).alias("line"), "content", F.lit(0.9).alias("confidence"))

    @rules.rule("NO_TODO", "info", "style")
    def no_todo(context):
        return context["files"].where(F.col("content").contains("TODO")).select("path", F.lit(1).alias("line"), "content", F.lit(0.5).alias("confidence"))

    files = spark.createDataFrame([("a", "eval(x) TODO"), ("b", "ok")], "path string, content string")
    assert {(r.rule_id, r.path, r.severity) for r in rules.run({"files": files}).collect()} == {("NO_EVAL", "a", "critical"), ("NO_TODO", "a", "info")}
    assert [r.rule_id for r in rules.run({"files": files}, least="warning").collect()] == ["NO_EVAL"] and rules.run({"files": files}, disabled={"NO_EVAL", "NO_TODO"}) is None
    with pytest.raises(ValueError):
        rules.rule("X", "grave")


def test_enclosing_starts_reach_every_line(spark):
    """Every function start of a known file has a row, those beyond line 376 too."""
    from tests.conftest import DATA

    got = {(r.file_id, r.point) for r in catalog.QUERIES["enclosing_function_starts"](spark, DATA).collect()}
    fns = latest_by_key(spark.read.parquet(f"{DATA}/fingerprints.parquet"), "fn_id", "ingested_at", ["repo", "file_path", "line"])
    files = latest_by_key(spark.read.parquet(f"{DATA}/source_files.parquet"), "file_id", "ingested_at", ["repo", "file_path"])
    want = {(r.file_id, r.line) for r in fns.where("line is not null").join(files, ["repo", "file_path"]).collect()}
    assert got == want and max(p for _, p in got) > 376


def test_contrastive_scores_without_common_ngrams(spark):
    """A function that is like a positive in all but its n-grams is scored."""
    cols = "language string, ngram_hashes array<bigint>, structural_markers array<bigint>, semantic_markers array<bigint>, skeleton_hashes array<bigint>"
    fns = spark.createDataFrame([(9, "rust", [7], [1, 2], [3], [4, 5])], f"fn_id long, {cols}")
    lib = spark.createDataFrame([(1, "p", "positive", "rust", [8], [1, 2], [3], [4, 5]), (2, "p", "negative", "rust", [8], [6], [6], [6])], f"example_id long, pattern_id string, polarity string, {cols}")
    assert matching.contrastive_scores(fns, lib).count() == 0
    got = matching.contrastive_scores(fns, lib, None).collect()
    assert [(r.fn_id, r.pattern_id, r.example_id, round(r.score, 6), r.signal) for r in got] == [(9, "p", 1, 0.6, 1.0)]
