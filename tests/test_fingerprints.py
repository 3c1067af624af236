import pytest
from pyspark.sql import functions as F

from loomgrain.operators import cfg, filters, fingerprint, frontend

CODE = "export async function saveUser(req: Request, id: number) {\n  // note\n  const name = req.body.name;\n  if (!name) { return null; }\n  await db.query('SELECT * FROM t WHERE id = ' + name);\n  db.execute(\"SELECT 1 WHERE a = :id\", [id]);\n  log(`hi ${name}`);\n}\n"


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame([(1, "r", "a.ts", CODE), (2, "r", "b.ts", CODE.replace("name", "title")), (3, "r", "c.ts", "")], "file_id long, repo string, file_path string, content string")
    return frontend.extract_functions(files)


def test_dimensions(spark, built):
    r = built.where("file_id = 1").select(
        fingerprint.semantic_categories(fingerprint.names_of(F.col("calls")), fingerprint.properties_of(F.col("body"))).alias("cats"),
        F.array_compact(F.transform(F.flatten(F.transform("calls", lambda c: c.getField("args"))), fingerprint.literal_label)).alias("labels"),
        fingerprint.tainted_calls(F.col("calls"), F.col("params")).alias("tainted"), fingerprint.path_prefixes(F.col("control")).alias("paths"), F.col("params"), F.col("control"),
    ).first()
    assert {"db_query", "db_write"} <= set(r.cats) and r.params == ["req", "id"]
    assert r.labels == ["sql_concat", "sql_parametrized_literal", "template_interp"]
    assert r.paths == ["branch", "branch>return", "branch>return>await"] and r.control == ["branch", "return", "await"]


def test_fingerprints_ignore_what_they_mask(built):
    a, b = fingerprint.fingerprints(built).orderBy("file_id").collect()
    assert a.semantic_markers == b.semantic_markers and a.structural_markers == b.structural_markers and a.skeleton_hashes == b.skeleton_hashes and a.literal_patterns == b.literal_patterns
    assert a.name_segments == ["save", "User"] and a.comment_density > 0 and a.ngram_hashes == sorted(set(a.ngram_hashes)) and a.ngram_hashes != b.ngram_hashes


def _control_paths(text, extension):
    return [f.paths for f in frontend.functions_of(text, extension)]


def test_control_paths_are_nesting_paths(spark):
    script = "function f(a) {\n  if (a) return 1\n  else if (b) { for (;;) { break; } }\n  try { g(); } catch (e) { throw e; } finally { h(); }\n  switch (a) { case 1: return 2; }\n  return xs.map(x => { while (x) { y(); } });\n}\n"
    assert _control_paths(script, "ts") == [["branch", "branch>return", "branch>branch", "branch>branch>loop", "branch>branch>loop>break", "try", "try>catch", "try>catch>throw", "return", "return>loop"]]
    rust = "fn f(x: T) {\n if let Foo { a } = x { return 1; } else { loop { break; } }\n match y { A => return 2, B => { for i in z { continue; } } }\n}\n"
    assert _control_paths(rust, "rs") == [["branch", "branch>return", "branch>loop", "branch>loop>break"]]
    python = "def f(a):\n    if a:\n        t = \"\"\"\nx\n\"\"\"\n        return [q for q in a]\n    elif b:\n        while a: break\n    else:\n        return 2\n    try:\n        g(1,\n  2)\n    except E:\n        raise\n"
    assert _control_paths(python, "py") == [["branch", "branch>return", "branch>return>loop", "branch>branch", "branch>branch>loop", "branch>branch>loop>break", "try", "try>catch", "try>catch>throw"]]
    # ten is a limit on the length of a path, not on the number of events
    deep = "function f(a) {" + " if (a) {" * 14 + "}" * 14 + "}"
    assert [len(p.split(">")) for p in _control_paths(deep, "ts")[0]] == list(range(1, 11))
    head = "function f(a) {" + " if (a) { g(); }" * 10
    files = spark.createDataFrame([(1, "r", "a.ts", head + "}"), (2, "r", "b.ts", head + " while (a) { try { return 1; } catch (e) { } } }")], "file_id long, repo string, file_path string, content string")
    a, b = fingerprint.fingerprints(frontend.extract_functions(files)).orderBy("file_id").collect()
    assert len(a.control_paths) == 1 and len(b.control_paths) == 5 and set(a.control_paths) < set(b.control_paths)


def test_idf_weights(spark):
    fps = spark.createDataFrame([(1, [1, 2, 9])], "k int, ngram_hashes array<bigint>")
    corpus = spark.createDataFrame([("a", [1, 2]), ("b", [1])], "holder string, ngram_hashes array<bigint>")
    w = fingerprint.with_idf_weights(fps, corpus, ["k"]).first().weighted_ngram_hashes
    assert w[1] == 0.0 and w[2] == pytest.approx(0.693147, abs=1e-5) and w[9] == 1.0


def _filter_frame(spark, **lists):
    row = {c: None for c in filters.LISTS} | {"function_name_regex": None} | lists
    schema = ", ".join([*[f"{c} array<string>" for c in filters.LISTS], "function_name_regex string"])
    return spark.createDataFrame([tuple(row[c] for c in [*filters.LISTS, "function_name_regex"])], schema)


@pytest.mark.parametrize(
    ("lists", "want"),
    [
        ({}, True), ({"contains_call_to": ["FETCH"]}, True), ({"contains_call_to": ["none"]}, False), ({"must_not_contain_call_to": [".catch"]}, True), ({"must_not_contain_call_to": ["fetch"]}, False),
        ({"contains_node_type": ["await", "x"]}, True), ({"must_not_contain_node_type": ["await"]}, False), ({"required_taint_flows": ["a>b"]}, True), ({"required_taint_flows": ["a>b", "c>d"]}, False),
        ({"function_name_regex": "^get"}, True), ({"function_name_regex": "^set"}, False), ({"must_not_match_function_name": ["User$"]}, False), ({"must_not_match_file_path": ["lib/"]}, False), ({"contains_import": ["express"]}, True), ({"must_not_contain_import": ["express"]}, False),
    ],
)
def test_semantic_filter(spark, lists, want):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    hit = filters.passes_filter(arr("axios.fetch"), arr("await"), arr("express"), F.lit("getUser"), F.lit("lib/a.ts"), arr("a>b"))
    assert _filter_frame(spark, **lists).select(hit.alias("ok")).first().ok is want


def test_filters_merge_and_thresholds(spark):
    hand = _filter_frame(spark, contains_call_to=["a"]).withColumn("pattern_id", F.lit("p"))
    learned = spark.createDataFrame([("p", "contains_call_to", "b"), ("q", "contains_import", "c")], "pattern_id string, constraint string, value string")
    got = {r.pattern_id: r for r in filters.merge_filters(hand, learned).collect()}
    assert got["p"].contains_call_to == ["a", "b"] and got["q"].contains_import == ["c"]
    rows = [("X", 0.5, False, 0.5, 0.5, "a"), ("X", 0.25, False, 0.5, 0.5, "a"), ("X", 0.16, True, 0.5, 0.5, "a"), ("Y", 0.5, False, 0.5, 0.5, "a"), ("X", 0.9, False, 0.01, 0.01, "a"), ("SQLI", 0.9, True, 0.5, 0.5, "x/frontend/y")]
    df = spark.createDataFrame(rows, "category string, score double, verified boolean, ngram double, signature double, path string")
    assert sorted(r.score for r in filters.reportable(df, {"Y": 0.8}).collect()) == [0.16, 0.5]


def test_call_changes_teach(spark):
    a = spark.createDataFrame([("f", ["exec"]), ("g", ["x"]), ("h", ["y"])], "name string, calls array<string>")
    b = spark.createDataFrame([("f", ["exec", "escapeShell"]), ("g", ["x"]), ("i", None)], "name string, calls array<string>")
    changes = filters.call_changes(a, b)
    assert {r.name: r.state for r in changes.collect()} == {"f": "changed", "g": "same", "h": "removed", "i": "added"}
    assert [(r.name, r.kind, r.required_calls) for r in filters.learned_change(changes).collect()] == [("f", "sanitizer_added", ["escapeShell"])]


def test_hops_are_counted_back_to_the_source(spark):
    d = spark.createDataFrame([("f", "a", 1, "req.body.x"), ("f", "b", 5, "a + 1"), ("f", "c", 9, "b"), ("f", "d", 11, "c"), ("f", "e", 13, "d")], "fn string, var string, at long, value string")
    u = spark.createDataFrame([("f", 20, "b"), ("f", 21, "req.body.y"), ("f", 22, "c"), ("f", 23, "e"), ("f", 3, "b")], "fn string, at long, text string")
    assert {(r.at, r.hop) for r in filters.trace_hops(d, u, r"req\.body").collect()} == {(20, 2), (21, 0), (22, 3)}


def test_canonical_text(spark):
    df = spark.range(1).select(filters.canonical_form(F.lit("foo(1, bar)")).alias("a"), filters.prefix_similarity(F.lit("abcd"), F.lit("abxx")).alias("s"), filters.prefix_similarity(F.lit(""), F.lit("")).alias("e")).first()
    assert df.a == "x(0, x)" and df.s == 0.5 and df.e == 0.0


def test_quality(spark):
    df = spark.createDataFrame([("a", "import x function"), ("b", "")], "tier string, text string")
    got = filters.quality_scores(df, {"has_import": (F.col("text").contains("import"), 15), "has_function": (F.col("text").contains("function"), 15)}, {"empty": (F.col("text") == "", 5)}, {"a": 30, "b": 10}).collect()
    assert [(r.tier, r.score, r.enough) for r in got] == [("b", 0, False), ("a", 30, True)] and got[0].lacking == ["has_import", "has_function", "empty"]


def test_dominators_and_guards():
    code = " if (a) { x(); } else { y(); } while (b) { z(); } "
    g = cfg.build(code)
    dom = cfg.dominators(g)
    assert all(0 in d for d in dom) and any(kind == "back" for b in g.blocks for _, kind in b.successors)
    assert any(cfg.frontier(g))
    ok = " if (!isAdmin(u)) { return; } exec(q); "
    assert cfg.guarded(ok, ok.index("exec"))
    late = " exec(q); if (!isAdmin(u)) { return; } "
    assert not cfg.guarded(late, late.index("exec"))
    inner = " if (x) { if (!isAdmin(u)) { return; } } exec(q); "
    assert not cfg.guarded(inner, inner.index("exec"))
