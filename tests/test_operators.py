import json

import pytest
from pyspark.sql import functions as F

from loomgrain.operators import findings as N
from loomgrain.operators import frontend, graph, joins, matching, roles, sequence, taint, training
from loomgrain.sources import readers, sinks
from loomgrain.streaming import pipelines


def _flows(text, ext="ts"):
    return [(f.name, [(x["origin"], x["category"]) for x in taint.flows_of(f)[0]]) for f in frontend.functions_of(text, ext)]


def test_taint_walk_positive_and_negative():
    assert _flows("function a(req, res) {\n  const c = req.body.c;\n  exec('ls ' + c);\n}\n") == [("a", [("request", "command")])]
    assert _flows("function a(req, res) {\n  const c = parseInt(req.body.c);\n  exec('ls ' + c);\n}\n") == [("a", [])]
    assert _flows("function a(x) {\n  // exec(x)\n  const s = 'exec(x)';\n}\n") == [("a", [])]
    assert _flows("function a(x) {\n  x = 'fixed';\n  exec(x);\n}\n") == [("a", [])]
    assert _flows("function a(x) {\n  if (y) {\n    x = 'fixed';\n  }\n  exec(x);\n}\n") == [("a", [("parameter", "command")])]
    assert _flows("function a(req) {\n  if (!isAdmin(req)) { return; }\n  db.query(req.body.q);\n}\n") == [("a", [])]
    assert _flows("def a(x):\n    os.system(x)\n", "py") == [("a", [("parameter", "command")])]
    assert _flows('fn a(x: &str) {\n    Command::new("sh").arg(x).spawn();\n}\n', "rs") == [("a", [("parameter", "command")])]


def test_functions_are_cut_at_their_brackets():
    text = "export function one(a, b = '}') {\n  if (a) { return '{'; }\n}\n\nconst two = async (c: string): Promise<void> => {\n  await c.go();\n};\n"
    got = frontend.functions_of(text, "ts")
    assert [(f.name, f.first_line, f.last_line, f.params) for f in got] == [("one", 1, 3, ["a", "b"]), ("two", 5, 7, ["c"])]
    assert got[0].events == ["branch", "return"] and [c["name"] for c in got[1].calls] == ["c.go"]
    assert frontend.functions_of("", "ts") == [] and frontend.functions_of("x", "txt") == []
    assert [f.name for f in frontend.functions_of("def a():\n    pass\n\nclass B:\n    def c(self):\n        return 1\n", "py")] == ["a", "c"]


def test_call_graph_prefers_the_same_file(spark):
    files = spark.createDataFrame(
        [(1, "r", "a.ts", "function f() { g(); h(); }\nfunction g() { }\n"), (2, "r", "b.ts", "function g() { }\nfunction h() { g(); }\n"), (3, "r", "c.ts", None)],
        "file_id long, repo string, file_path string, content string",
    )
    edges = {(r.src, r.dst) for r in frontend.call_edges(frontend.extract_functions(files)).collect()}
    assert edges == {("r/a.ts:f", "r/a.ts:g"), ("r/a.ts:f", "r/b.ts:h"), ("r/b.ts:h", "r/b.ts:g")}


def test_cross_file_paths(spark):
    files = spark.createDataFrame(
        [(1, "r", "h.ts", "function handler(req, res) {\n  log.info(req.body.x);\n  fetch(req.query.u);\n  service(1);\n}\n"), (2, "r", "s.ts", "function service(x) {\n  exec(x);\n}\n")],
        "file_id long, repo string, file_path string, content string",
    )
    flows, edges = taint.function_flows(files), frontend.call_edges(frontend.extract_functions(files))
    got = [(r.sink, r.source, r.origin, r.path_length) for r in taint.cross_file_paths(edges, flows).collect()]
    assert got == [("r/s.ts:service", "r/h.ts:handler", "request", 2)]


def test_project_pass(spark):
    files = spark.createDataFrame(
        [(1, "r", "h.ts", "function handler(req, res) {\n  service(1);\n}\n"), (2, "r", "s.ts", "function service(x) {\n  store.put(1, x);\n  log(2);\n}\nfunction lone(y) {\n  go(y);\n  stay(3);\n}\n")],
        "file_id long, repo string, file_path string, content string",
    )
    functions = frontend.extract_functions(files)
    got = {r["name"]: (r.origin, r.hops, r.tainted_calls) for r in taint.project_pass(functions, frontend.call_edges(functions)).collect()}
    assert got == {"handler": ("request", 0, ["service"]), "service": ("request", 1, ["log", "store.put"]), "lone": (None, None, ["go"])}


def test_roles(spark):
    rows = spark.createDataFrame([(["res.send", "x"], ["req"], ["branch"]), (["child.exec"], [], []), (["db.query"], [], []), ([], [], []), (["foo"], [], [])], "calls array<string>, params array<string>, control array<string>")
    assert [r.role for r in rows.select(roles.role(F.col("calls"), F.col("params"), F.col("control"), F.lit(False)).alias("role")).collect()] == ["handler", "shell", "db", "transformer", "unknown"]


def test_walks_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "z")], "src string, dst string")
    hops = {(r.node, r.hops) for r in graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 5).collect()}
    assert hops == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    labels = {r.node: r.label for r in graph.components(edges).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.components(chain).select("label").distinct().collect()[0].label == 0


def test_sequences(spark):
    rows = [("u", i, t) for i, t in enumerate("A B A R B A A B".split())] + [("v", 0, "A"), ("w", 0, "C")]
    df = spark.createDataFrame(rows, "scope string, i int, t string")
    t = F.col("t")
    assert [r.i for r in sequence.must_not_follow(df, ["scope"], ["i"], t == "A", t == "B", t == "R").orderBy("i").collect()] == [1, 7]
    assert [(r.scope, r.matched) for r in sequence.must_follow(df, ["scope"], ["i"], "t", ["A", "B"]).collect()] == [("v", 1)]
    assert [r.i for r in sequence.forbidden_between(df, ["scope"], ["i"], t == "A", t == "R", t == "B").where("scope = 'u'").orderBy("i").collect()] == [1, 7]
    assert sequence.early_stop(df, ["scope"], ["i"], t == "R").where("scope = 'u'").count() == 4


def test_exact_ranks_of_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 37).cast("double").alias("v"))
    ranks = sequence.exact_ranks(df, ["g"], "v").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(5000)) and [r.v for r in ranks] == sorted(r.v for r in ranks)
    p = sequence.latency_profile(df, ["g"], "v").first()
    values = sorted(float(i % 37) for i in range(5000))
    assert (p.p50, p.p99) == (values[2500], values[4950])


def test_enclosing_span_takes_the_tightest(spark):
    spans = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 10, 20), ("f", 3, 12, 15), ("f", 4, 50, 40)], "file string, span_id long, start long, end long")
    points = spark.createDataFrame([("f", 13), ("f", 18), ("f", 99), ("f", 101), ("g", 1)], "file string, point long")
    assert {(r.point, r.span_id) for r in joins.enclosing_span(points, spans, ["file"], width=8).collect()} == {(13, 3), (18, 2), (99, 1)}


def test_label_matching_is_one_to_one(spark):
    f = spark.createDataFrame([(1, "a", 10, "s"), (2, "a", 12, "s"), (3, "a", 100, "t")], "finding_id long, file string, line long, symbol string")
    g = spark.createDataFrame([(7, "a", 35, "s"), (8, "a", 14, "q"), (9, "a", 140, "t")], "label_id long, file string, line long, symbol string")
    assert {(r.finding_id, r.label_id) for r in N.match_labels(f, g).collect()} == {(1, 7), (2, 8)}


def test_training_is_monotone_and_falls_back(spark):
    rows = [("c", s / 100, s > 50) for s in range(100)] + [("small", 0.5, True)]
    got = {r.key: r for r in training.platt_calibration(spark.createDataFrame(rows, "c string, s double, l boolean"), "c", "s", "l").collect()}
    assert set(got) == {"_global", "c"} and got["c"].a > 0 and got["c"].accuracy > 0.8
    pairs = spark.createDataFrame([("k", float(i % 2), float(i % 2), 0.5) for i in range(20)], "category string, label double, x double, y double")
    w = {r.category: (r.x, r.y) for r in training.category_weights(pairs, ["x", "y"]).collect()}
    assert w["k"][0] > w["k"][1] and sum(w["k"]) == pytest.approx(1.0)


def test_member_roles_count_in_linear_time(spark):
    rows = [(1, 9, "a", [1, 2]), (2, 9, "b", [1, 2]), (3, 9, "c", [5, 6]), (4, 8, "d", [1, 1])]
    got = {r.fn_id: (r.mean_similarity, r.role) for r in matching.member_roles(spark.createDataFrame(rows, "fn_id long, cluster_id long, name string, sig array<bigint>")).collect()}
    assert got == {1: (0.5, "inconsistent"), 2: (0.5, "inconsistent"), 3: (0.0, "inconsistent"), 4: (None, "consistent")}


def test_directory_scan_and_examples(spark, tmp_path):
    for name, text in {"src/a.ts": "let a = 1;", "src/a.test.ts": "x", "node_modules/b.ts": "x", "src/c.min.js": "x", "src/d.txt": "x", "corpus/p_x_positive.ts": "p", "corpus/p_x_negative.ts": "n", "corpus/p_x_positive2.ts": "q", "corpus/lone_positive.rs": "z"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = readers.scan_directory(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"src/a.ts", "corpus/p_x_positive.ts", "corpus/p_x_negative.ts", "corpus/p_x_positive2.ts", "corpus/lone_positive.rs"}
    examples, warnings = readers.example_files(files)
    assert sorted((r.pattern_id, r.polarity) for r in examples.collect()) == [("p_x", "negative"), ("p_x", "positive"), ("p_x", "positive")]
    assert [r.pattern_id for r in warnings.collect()] == ["lone"]
    assert readers.example_files(files, strict_compat=True)[0].count() == 2
    one = readers.single_file(spark, "x/y.rs", "fn a() {}").first()
    assert one.language == "rust" and one.size_bytes == 9
    manifest = files.where("path = 'src/a.ts'")
    assert sinks.changed_since(files, manifest).count() == 4
    assert readers.listed_files(files, files.select("path"), manifest).count() == 4


def test_small_readers(spark, tmp_path):
    text = "// [advisory]\n// observation: it is: bad\n// cwe: CWE-1\nconst x = 1;\n// late: no\n"
    got = spark.createDataFrame([(text,)], "c string").select(readers.advisory_fields(F.col("c")).alias("m")).first().m
    assert got == {"observation": "it is: bad", "cwe": "CWE-1"}
    files = spark.createDataFrame([("a/package.json", '{"dependencies": {"express": "^4"}, "devDependencies": {"jest": "1"}}'), ("Cargo.toml", '[dependencies]\nserde = "1.0"\n\n[dev]\nx = "2"\n'), ("Cargo.lock", 'name = "rand"\nversion = "0.8"\n')], "path string, content string")
    deps = readers.dependencies(files)
    assert {(r.package, r.version) for r in deps.collect()} == {("express", "^4"), ("jest", "1"), ("serde", "1.0"), ("rand", "0.8")}
    imports = spark.createDataFrame([(1, "express/lib"), (1, "./x"), (1, "fs"), (1, "@a/b/c"), (1, "ghost")], "file_id long, package string")
    assert {r.package for r in readers.unknown_imports(imports, deps, ["fs"]).collect()} == {"@a/b/c", "ghost"}
    (tmp_path / "c.yml").write_text("disabled_rules:\n  - A\nseverity_override:\n  B: info\nsuppressions:\n  - rule_id: C\n    path: 'src/**'\n")
    assert readers.read_config(str(tmp_path / "c.yml")) == {"disabled_rules": ["A"], "severity_override": {"B": "info"}, "suppressions": [{"rule_id": "C", "path": "src/**"}]}
    assert readers.read_config(str(tmp_path / "none.yml")) == {}


FINDINGS = [(1, "R1", "critical", "a.ts", 3, "bad", 0.9, True, False), (2, "R1", "warning", "b.ts", None, None, 0.3, False, True), (3, "R0", "info", "c.ts", 1, "", 0.44, False, False)]
SCHEMA = "seq long, rule_id string, severity string, path string, line long, observation string, confidence double, requires_human boolean, auto_fixable boolean"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame(FINDINGS, SCHEMA)
    s = sinks.write_json_report(df, str(tmp_path / "r")).first()
    assert (s.clean, s.total, s.requires_human, s.auto_fixable) == (False, 3, 1, 1)
    assert readers.read_findings(spark, str(tmp_path / "r" / "findings")).count() == 3
    sinks.write_sarif(df, str(tmp_path / "s"))
    log = json.loads(sinks.sarif_log(spark, str(tmp_path / "s")))
    assert [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]] == ["R0", "R1"] and len(log["runs"][0]["results"]) == 3
    (tmp_path / "log.sarif").write_text(json.dumps(log))
    assert {(r.rule_id, r.path, r.line, r.level) for r in readers.read_sarif(spark, str(tmp_path / "log.sarif")).collect()} == {("R1", "a.ts", 3, "error"), ("R1", "b.ts", 1, "warning"), ("R0", "c.ts", 1, "note")}
    assert [r.value for r in sinks.markdown(df).collect()][0] == "## Critical"
    assert sinks.text_lines(df).first().value.startswith("[CRITICAL] a.ts:3 R1")


def test_bundle_round_trip_and_tampering(spark, tmp_path):
    path = str(tmp_path / "bundle")
    sinks.write_bundle({"a": spark.range(10).toDF("x"), "b": spark.createDataFrame(FINDINGS, SCHEMA)}, path)
    assert sinks.read_bundle(spark, path)["b"].count() == 3
    spark.range(9).toDF("x").write.mode("overwrite").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="does not match"):
        sinks.read_bundle(spark, path)


def test_edits_go_from_back_to_front(spark):
    files = spark.createDataFrame([("a", "import x\nfoo(1) + foo(2)"), ("b", "zzz"), ("c", "keep")], "path string, content string")
    edits = spark.createDataFrame([("a", 9, 12, "foo", "barbar", "import y"), ("a", 18, 21, "foo", "q", None), ("b", 0, 2, "no", "x", None)], "path string, start int, end int, original string, replacement string, import_line string")
    got = {r.path: (r.content, r.error) for r in sinks.apply_edits(files, edits).collect()}
    assert got["a"] == ("import x\nimport y\nbarbar(1) + q(2)", None) and got["c"] == ("keep", None)
    assert got["b"][0] == "zzz" and "mismatch" in got["b"][1]
    assert "+b" in files.limit(1).select(sinks.unified_diff(F.lit("a"), F.lit("b")).alias("d")).first().d


def test_suppression_and_mining(spark):
    df = spark.createDataFrame(FINDINGS, SCHEMA)
    assert [r.rule_id for r in N.suppress(df, [("R1", "*.ts")]).collect()] == ["R0"] and N.suppress(df, [("all", "**")]).count() == 0 and N.suppress(df, []).count() == 3
    assert {r.rule_id: r.severity for r in N.override_severity(df, {"R0": "critical"}, ["R1"]).collect()} == {"R0": "critical"}
    assert [r.stem for r in sinks.mined_negatives(df.withColumn("snippet", F.lit("s")), 0.4).collect()] == ["R0_c_ts_1_negative"]


def test_incremental_stream_reads_each_content_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "path string, content_sha string").coalesce(1).write.parquet(source)
    run = lambda: pipelines.incremental_scan(pipelines.file_stream(spark, source, "path string, content_sha string"), lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("a", "1"), ("a", "9")], "path string, content_sha string").coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted((r.path, r.content_sha) for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()) == [("a", "1"), ("a", "9"), ("b", "2")]


def test_event_streams(spark, tmp_path):
    events = spark.sql("select timestamp '2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id * 10, 0) ts, 'e' event_type, 1.0D value from range(12)")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = pipelines.windowed_counts(pipelines.file_stream(spark, str(tmp_path / "e"), events.schema)).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("select n from win order by start").collect()] == [5, 6, 1]
    m = spark.createDataFrame([("p", True), ("p", False), ("q", True)], "pattern_id string, verified boolean")
    m.coalesce(1).write.parquet(str(tmp_path / "m"))
    q = pipelines.running_counters(pipelines.file_stream(spark, str(tmp_path / "m"), m.schema)).writeStream.outputMode("update").format("memory").queryName("cnt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.pattern_id, r.matches, r.verified) for r in spark.sql("select * from cnt").collect()} == {("p", 2, 1), ("q", 1, 1)}
