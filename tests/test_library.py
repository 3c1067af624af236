"""Scoring over all dimensions against plain Python, registries, frameworks, configuration rules, filters, providers, sinks and readers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgrain.operators import config_rules, findings, frameworks, graph, overlap, registry, scoring, sequence, training
from loomgrain.plans import providers
from loomgrain.sources import readers, sinks

SETS = [c for c in scoring.SETS]
FN = "language string, role string, weighted_ngram_hashes map<bigint,double>, " + ", ".join(f"{c} array<bigint>" for c in [*scoring.SETS, *scoring.SEQUENCES])


def _row(rnd, calls=True):
    some = lambda n: rnd.sample(range(14), rnd.randrange(n)) if rnd.random() > 0.15 else rnd.choice([None, []])
    out = {c: some(9) for c in scoring.SETS} | {c: [rnd.randrange(6) for _ in range(rnd.randrange(12))] for c in scoring.SEQUENCES}
    out["structural_markers"] = rnd.sample(range(8), 4)
    if not calls:
        out["api_calls"] = []
    out["weighted_ngram_hashes"] = {x: rnd.choice([1.0, 2.5]) for x in out["ngram_hashes"] or []} if rnd.random() > 0.5 else None
    out["language"], out["role"] = rnd.choice(["typescript", "javascript", "rust", None]), rnd.choice(["handler", "db", "unknown"])
    return out


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def _dims(f, e):
    s = lambda x, c: set(x[c] or [])
    def j(c):
        a, b = s(f, c), s(e, c)
        return 0.5 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)
    some = lambda c: j(c) if s(f, c) and s(e, c) else 0.0
    contained = lambda c: 0.5 if not s(e, c) else len(s(f, c) & s(e, c)) / len(s(e, c))
    fw, ew = f["weighted_ngram_hashes"] or {}, e["weighted_ngram_hashes"] or {}
    d = {"ngram": j("ngram_hashes")}
    if fw and ew:
        keys = set(fw) | set(ew)
        d["ngram"] = sum(min(fw.get(k, 0), ew.get(k, 0)) for k in keys) / sum(max(fw.get(k, 0), ew.get(k, 0)) for k in keys)
    a, b = f["skeleton_hashes"], e["skeleton_hashes"]
    d["ast"] = _lcs(a, b) / max(len(a), len(b)) if a and b and d["ngram"] > 0.25 else j("structural_markers")
    ta, tb = s(f, "type_usages"), s(e, "type_usages")
    d["type_usage"] = 0.0 if not ta or not tb else float(bool(ta & tb)) if 1 in (len(ta), len(tb)) else len(ta & tb) / len(ta | tb)
    d |= {"signature": j("signature_ngrams"), "param_type": j("param_type_ngrams"), "semantic": j("semantic_markers"), "control": j("control_paths"), "api": max(j("api_calls"), some("api_segments"))}
    d["tainted_api"] = 1.0 if not s(f, "tainted_api_calls") and not s(e, "tainted_api_calls") else j("tainted_api_calls")
    d |= {"motif": contained("motif_hashes"), "flow": contained("flow_hashes"), "config": j("config_literals"), "argument": some("argument_types"), "literal": some("literal_patterns")}
    a, b = f["control_sequence"], e["control_sequence"]
    d["order"] = 1.0 if not a and not b else 0.0 if not a or not b else _lcs(a, b) / max(len(a), len(b))
    return d


def _override(d, total):
    return max(total, 0.85) if d["flow"] > 0.8 and d["motif"] > 0.8 else max(total, 0.75) if d["api"] > 0.9 and d["flow"] > 0.5 else total


def _score(f, pos, neg, hit_both):
    s = lambda x, c: set(x[c] or [])
    if len(s(f, "structural_markers")) < 3 or not s(f, "control_paths") and not s(f, "api_calls"):
        return None
    roles = {f["role"], pos[0][1]["role"]}
    if roles == {"handler", "db"}:
        return None
    wide = max(len(s(f, "structural_markers") & s(e, "structural_markers")) / min(len(s(f, "structural_markers")), len(s(e, "structural_markers"))) for _, e in pos)
    if wide < 0.05:
        return None
    called = [(len(s(f, "api_calls") & s(e, "api_calls")), i, e) for i, e in pos if s(e, "api_calls")]
    if called:
        n, _, e = max(called, key=lambda x: x[:2])
        if not n and not s(f, "motif_hashes") & s(e, "motif_hashes"):
            return None
    best = None
    for i, e in pos:
        d = _dims(f, e)
        if s(e, "api_calls") and s(f, "api_calls") and not s(e, "api_calls") & s(f, "api_calls") and not s(e, "motif_hashes") & s(f, "motif_hashes"):
            continue
        if d["ngram"] < 0.05 and d["api"] < 0.1:
            continue
        total = _override(d, sum(d[n] * w for n, w in scoring.WEIGHTS.items()))
        same = f["language"] is None or e["language"] is None or f["language"] == e["language"] or "rust" not in (f["language"], e["language"])
        rank = total * (1 if same else 0.2) * (1 if not s(e, "semantic_markers") else 0.3 if d["semantic"] == 0 else 2.0)
        if rank > 0 and (best is None or rank > best[0] + 1e-12):
            best = (rank, i, e, d, total)
    worst = {n: max([_dims(f, e)[n] for _, e in neg], default=0.0) for n in scoring.WEIGHTS}
    if best is None:
        return None, 0.0
    _, i, e, d, total = best
    signal = {n: max(d[n] - worst[n], 0) for n in d}
    pi = len(s(f, "api_calls") & s(e, "api_calls"))
    ni = len(s(f, "api_calls") & s(neg[0][1], "api_calls")) if neg else 0
    signal["api"] = max((pi - ni) / pi, 0) if pi else 0.0
    gate = max(signal.values()) > 0.4 or sum(x > 0.15 for x in signal.values()) >= 2
    return i, total * gate * (1 if hit_both else 0.85)


def test_pattern_scores_equal_plain_python(spark):
    rnd = random.Random(11)
    fns = {i: _row(rnd) for i in range(25)}
    fns[25] = {**_row(rnd, calls=False), "control_paths": []}
    lib = [(100 + i, f"ts_c{i % 3}_p{i % 5}", "positive" if i % 3 else "negative", _row(rnd, i % 7 > 0)) for i in range(30)]
    cand = [(f, p, (f + len(p)) % 2 == 0) for f in fns for p in sorted({x[1] for x in lib})]
    columns = FN.split(", ")
    names = ["language", "role", "weighted_ngram_hashes", *scoring.SETS, *scoring.SEQUENCES]
    df = spark.createDataFrame([(i, *[r[n] for n in names]) for i, r in fns.items()], "fn_id long, " + FN)
    ex = spark.createDataFrame([(i, p, pol, *[r[n] for n in names]) for i, p, pol, r in lib], "example_id long, pattern_id string, polarity string, " + FN)
    got = {(r.fn_id, r.pattern_id): (r.example_id, r.score) for r in scoring.pattern_scores(df, ex, spark.createDataFrame(cand, "fn_id long, pattern_id string, hit_both boolean")).collect()}
    want = {}
    for f, p, both in cand:
        pos, neg = ([(i, r) for i, q, pol, r in lib if q == p and pol == k] for k in ("positive", "negative"))
        if pos and (x := _score(fns[f], pos, neg, both)) is not None:
            want[f, p] = x
    assert set(got) == set(want) and len(want) > 20 and sum(s > 0 for _, s in want.values()) > 5 and columns
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert scoring.pattern_scores(df.limit(0), ex, spark.createDataFrame(cand, "fn_id long, pattern_id string, hit_both boolean")).count() == 0


def test_calibration_per_pattern(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(30):
        good = k % 2 == 0
        base = list(range(20)) if good else list(range(50, 70))
        rows.append((k, "ts_a_p", "positive" if good else "negative", [x for x in base if rnd.random() > 0.2], list(range(4)), [1], [1, 2]))
    rows += [(100 + k, "ts_a_few", "positive" if k % 2 else "negative", [1], [1], [1], [1]) for k in range(6)]
    ex = spark.createDataFrame(rows, "example_id long, pattern_id string, polarity string, ngram_hashes array<bigint>, structural_markers array<bigint>, semantic_markers array<bigint>, skeleton_hashes array<bigint>")
    samples = scoring.calibration_samples(ex)
    assert {(r.pattern_id, r.label): r["count"] for r in samples.groupBy("pattern_id", "label").count().collect()} == {("ts_a_p", 1.0): 3, ("ts_a_p", 0.0): 15}
    fit = training.pattern_calibration(samples).collect()
    assert [(r.pattern_id, r.n_samples) for r in fit] == [("ts_a_p", 18)] and fit[0].a > 0
    counters = spark.createDataFrame([("p", 100, 1), ("q", 0, 0), ("r", 10, 10)], "pattern_id string, matches long, verified long")
    assert [r.pattern_id for r in scoring.stalest(counters, 2).collect()] == ["p", "r"]


def test_similar_sets_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for fam in range(12):
        base = rnd.sample(range(400), 15)
        rows += [(fam * 10 + i, [x for x in base if rnd.random() > 0.06] + [7]) for i in range(5)]
    rows += [(900, rows[0][1]), (901, [1]), (902, None), (903, [None, 7, 7])]
    sets = {k: frozenset(x for x in s or [] if x is not None) for k, s in rows}
    keys = [k for k in sets if len(sets[k]) >= 2]
    cls = {k: min(q for q in keys if sets[q] == sets[k]) for k in keys}
    true = {(a, b) for a in set(cls.values()) for b in set(cls.values()) if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    for floor in (20_000, 3):
        members, pairs = overlap.similar_sets(spark.createDataFrame(rows, "k long, s array<bigint>"), "k", "s", 0.8, 2, block=4, floor=floor)
        assert {(r.a, r.b) for r in pairs.collect()} == true and {r.key: r.class_id for r in members.collect()} == cls and len(true) > 5


def test_registry_counts_merge_and_classify(spark):
    fns = spark.createDataFrame(
        [(1, ["Request"], [("db.pool.query",), ("db.pool.query",), ("exec",)]), (2, ["Request"], [("pool.query",), ("exec",)]), (3, [], [("exec",), ("logger.exec",)]), (4, None, None)],
        "file_id long, types array<string>, calls array<struct<name: string>>",
    )
    files = spark.createDataFrame([(1, "x // sink: weird.thing\n"), (2, None)], "file_id long, content string")
    reg = registry.learn_registry(fns, files)
    got = {(r.kind, r["name"]): (r.category, r["count"]) for r in reg.collect()}
    assert got == {("source", "Request"): (None, 2), ("sink", "query"): ("query", 2), ("sink", "exec"): ("code", 3), ("qualified", "pool.query"): ("query", 2), ("sink", "thing"): ("unknown", 100), ("qualified", "weird.thing"): ("unknown", 100)}
    merged = {(r.kind, r["name"]): r["count"] for r in registry.merge_registries(reg, reg).collect()}
    assert merged == {k: 2 * v[1] for k, v in got.items()}
    calls = spark.createDataFrame([(1, "a.pool.query"), (2, "q.exec"), (3, "logger.exec"), (4, "x.query"), (5, "none")], "id long, name string")
    out = {r.id: (r.category, r.matched) for r in registry.classify_calls(calls, reg, ("logger.",)).collect()}
    assert out == {1: ("query", "qualified"), 2: ("code", "last"), 3: (None, None), 4: (None, None), 5: (None, None)}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(registry.sink_category(F.lit(s))) for s in ("evalIt", "execSync", "runQuery", "fs.readFile", "setItem", "res.send", "foo")] == ["code", "command", "query", "file", "storage", "response", "unknown"]
    assert one(registry.pattern_category(F.lit("ts_cmdi_x"))) == "command" and one(registry.pattern_category(F.lit("ts_none"))) is None and one(registry.weakness(F.lit("fetch"))) == 918
    assert one(registry.relevance(F.lit("query"), F.lit("database"))) == 0.7 and one(registry.relevance(F.lit("query"), F.lit("request"))) == 1.0 and one(registry.relevance(F.lit("log"), F.lit("network"))) == 0.5
    pos = spark.createDataFrame([("ts_a_1", ["x.run", "then"]), ("ts_a_2", ["run"]), ("ts_b_1", ["run", "once"])], "pattern_id string, calls array<string>")
    assert [(r["name"], r.category, r["count"]) for r in registry.learned_markers(pos).collect()] == [("run", "a", 2)]


def test_frameworks(spark):
    deps = spark.createDataFrame([("p", "express"), ("p", "@nestjs/core"), ("q", "left-pad"), ("r", "next")], "project string, package string")
    assert {r.project: r.framework for r in frameworks.detect(deps).collect()} == {"p": "nestjs", "q": "express", "r": "nextjs"}
    files = spark.createDataFrame(
        [(1, "a.ts", "app.get('/x/:id', f);\nrouter.post(\"/y\", g);", "express"), (2, "src/u.ts", "@Controller('users')\nclass U { @Get(':id') f() {} @Post() g() {} }", "nestjs"), (3, "app/api/items/route.ts", "export async function GET(r) {}", "nextjs"), (4, "z.ts", None, "hono")],
        "file_id long, file_path string, content string, framework string",
    )
    got = {(r.file_id, r.method, r.route) for r in frameworks.framework_routes(files).collect()}
    assert got == {(1, "GET", "/x/:id"), (1, "POST", "/y"), (2, "GET", "/users/:id"), (2, "POST", "/users"), (3, "GET", "/api/items")}
    fns = spark.createDataFrame([(1, "express", "a(req.body.name, req.query.q)"), (2, "hono", "c.req.param('id'); c.req.json()"), (3, "remix", "formData.get('f')")], "fn_id long, framework string, body string")
    assert {(r.fn_id, r.location, r.name) for r in frameworks.injection_points(fns).collect()} == {(1, "body", "name"), (1, "query", "q"), (1, "body", None), (2, "path", "id"), (2, "body", None), (3, "form", "f")}
    assert {(r.framework, r.auth) for r in frameworks.conventions(fns).collect()} == {("express", "bearer"), ("hono", "bearer"), ("remix", "cookie")}


CONFIG = {
    "A5-HELMET_MISSING": ("server.js", "a\n// app.use(helmet());\n", 2, "app.use(helmet());\n// helmet\n"),
    "A5-X_POWERED_BY": ("app.js", "/*\n app.disable('x-powered-by')\n*/\n", 2, "app.disable('x-powered-by');\n"),
    "A5-NOSNIFF": ("index.js", "// app.use(nosniff())\n", 1, "app.use(nosniff());\n"),
    "A5-COOKIE_NAME": ("app.js", "s({ // key: \"sessionId\"\n})\n", 1, "s({ key: 'sessionId' }) // key: 'sessionId'\n"),
    "A8-CSRF_MIDDLEWARE": ("app.js", "// app.use(csrf())\n", 1, "app.use(csurf()) // csrf\n"),
    "A5-SAVE_UNINIT": ("app.js", "x\nsaveUninitialized: true,\n", 2, "// saveUninitialized: true\n"),
    "A5-HTTP": ("server.js", "http.createServer(a)\n", 1, "https.createServer(a)\nhttp.createServer(b)\n"),
    "A3-SWIG_AUTOESCAPE": ("server.js", "autoescape: false\n", 1, "autoescape: true\n"),
    "A3-MARKED_VULN": ("server.js", "marked.setOptions({})\n", 1, "marked(x)\n"),
    "A5-COOKIE_FLAGS": ("server.js", "session({\n cookie: {}\n", 1, "cookie: { httpOnly: true }\n"),
    "A2-USER_ENUM": ("session.js", "e('user not found')\n", 1, "e('no')\n"),
    "A2-WEAK_PW": ("user-dao.js", "password = x\n", 1, "password.length > 8\n"),
    "A2-NO_SESSION_REGENERATE": ("auth.js", "function login() {\n req.session.u = 1;\n", 2, "login();\nreq.session.regenerate();\nreq.session.u = 1;\n"),
    "A7-NO_ADMIN_CHECK": ("routes.js", "app.get('/admin', f)\n", 1, "app.get('/admin', isAdmin, f)\n"),
    "A1-LOG_INJECTION": ("login.js", 'console.log("Error:", x)\n', 1, "// console.log(\"Error:\", x)\n"),
    "A3-WRONG_ENCODING": ("profile.js", "a.encodeForHTML(website)\n", 1, "a.encodeForHTML(name)\n"),
    "A4-IDOR_PARAM": ("allocations.js", "const { userId } =\n req.params;\n", 2, "req.params.id\n"),
    "A10-SSRF": ("research.js", "needle.get(u)\n", 1, "get(u)\n"),
    "REDOS": ("validate.js", "x\nr = /([0-9]+)+/\n", 2, "r = /[0-9]+/\n"),
    "HPP_DOS": ("user.js", "firstName.trim()\n", 1, "other.trim()\n"),
}


def test_every_config_rule_has_a_case_for_and_against(spark):
    by_id = {r.id: r for r in config_rules.RULES}
    assert set(by_id) == set(CONFIG)
    rows = []
    for k, (rule, (name, bad, line, good)) in enumerate(CONFIG.items()):
        assert config_rules.violations(by_id[rule], bad) == [line], rule
        assert config_rules.violations(by_id[rule], good) == [], rule
        rows.append((k, f"src/{name}", bad))
    files = spark.createDataFrame([*rows, (90, "src/other.ts", rows[0][2]), (91, "server.js", None), (92, None, "x")], "file_id long, file_path string, content string")
    found = {(r.file_id, r.rule_id) for r in config_rules.config_findings(files).collect()}
    assert {(k, rule) for k, rule in enumerate(CONFIG)} <= found and not {90, 91, 92} & {f for f, _ in found}
    assert config_rules.config_findings(files, []).count() == 0


def test_report_filters_and_fuzzy_baseline(spark):
    f = spark.createDataFrame([("A", "critical", "x/a.ts", 0.9, ["security"]), ("B", "info", "x/b.rs", 0.2, ["quality"]), ("C", "warning", None, None, None)], "rule_id string, severity string, path string, confidence double, tags array<string>")
    ids = lambda df: sorted(r.rule_id for r in df.collect())
    assert ids(findings.fix_scope(f, "security")) == ["A"] and ids(findings.fix_scope(f, "style")) == ["B"] and ids(findings.fix_scope(f, "all")) == ["A", "B", "C"]
    rules = spark.createDataFrame([("A", ["t1"]), ("B", ["t2"])], "rule_id string, tags array<string>")
    assert ids(findings.report_filter(f)) == ["A", "B", "C"] and ids(findings.report_filter(f, least_confidence=0.1)) == ["A", "B"] and ids(findings.report_filter(f, rules, tags=["t2"])) == ["B"]
    assert ids(findings.report_filter(f, least="warning")) == ["A", "C"] and ids(findings.report_filter(f, rule_ids=["C"])) == ["C"] and ids(findings.report_filter(f, languages={"rust": ["rs"]})) == ["B"]
    probes = spark.createDataFrame([(1, 3), (2, 9), (3, None)], "id long, risk int")
    assert sorted(r.id for r in findings.within_risk(probes, 5).collect()) == [1, 3]
    S = "rule_id string, path string, symbol string, content string, line long"
    now = spark.createDataFrame([("A", "p", "s", "x  = 1", 5), ("B", "p", None, "y", 1)], S)
    old = spark.createDataFrame([("A", "p", "s", "X = 1 ", 9), ("C", "p", None, "z", 1)], S)
    assert {(r.rule_id, r.state) for r in findings.fuzzy_baseline_diff(now, old).collect()} == {("B", "new"), ("C", "resolved")}


def test_graphs_merge_on_keys(spark):
    n = spark.createDataFrame([(0, "a"), (1, "b")], "id long, key string")
    e = spark.createDataFrame([(0, 1, "calls")], "src long, dst long, kind string")
    n2 = spark.createDataFrame([(7, "b"), (8, "c"), (9, "c")], "id long, key string")
    e2 = spark.createDataFrame([(7, 8, "calls"), (7, 9, "calls"), (8, 7, "reads")], "src long, dst long, kind string")
    nodes, edges = graph.merge_graphs(n, e, n2, e2)
    key = {r.id: r.key for r in nodes.collect()}
    assert sorted(key.values()) == ["a", "b", "c"] and len(key) == 3
    assert {(key[r.src], key[r.dst], r.kind) for r in edges.collect()} == {("a", "b", "calls"), ("b", "c", "calls"), ("c", "b", "reads")} and edges.count() == 3
    empty, none = graph.merge_graphs(n.limit(0), e.limit(0), n2, e2)
    assert empty.count() == 2 and none.count() == 2


def test_events_and_resource_rules(spark):
    from loomgrain.operators import frontend

    files = spark.createDataFrame([(1, "r", "a.ts", "async function f(m) {\n  m.lock();\n  await g();\n  m.unlock();\n  await h();\n  const x = 1;\n  return x;\n}\n"), (2, "r", "b.ts", "function k() { openFile(p); read(); }\n")], "file_id long, repo string, file_path string, content string")
    events = sequence.code_events(frontend.extract_functions(files))
    got = [(r.event_type, r.label) for r in events.where("file_id = 1").orderBy("at", "event_type").collect()]
    assert [t for t, _ in got if t in ("acquire", "release", "assignment", "return")] == ["acquire", "release", "assignment", "return"] and sum(t == "await" for t, _ in got) == 2
    held = sequence.held_awaits(events, ["file_id", "name", "first_line"], ["at", "event_type", "label"]).collect()
    assert [(r.file_id, r.held) for r in held] == [(1, "m.lock")]
    broken = sequence.broken_pairs(events.withColumn("call", F.regexp_extract("label", r"([^.]*)$", 1)), sequence.pair_rules(spark), ["file_id", "name"], ["at"], "call").collect()
    assert [(r.rule_id, r.file_id) for r in broken] == [("SEQ_OPENFILE_CLOSEFILE", 2)]


def test_providers(spark):
    files = spark.createDataFrame([(1, "r", "a.ts", "import { q } from 'lib';\nfunction f(req, res) { res.send(runQuery(req)); }\n"), (2, "r", "b.rs", "fn g(a: u8) { spawn(a); }\n"), (3, "r", "c.txt", "x"), (4, "r", "d.py", "def h(x):\n    return x\n")], "file_id long, repo string, file_path string, content string")
    p = providers.standard()
    assert {(r.file_id, r.provider, r.is_handler) for r in p.functions(files).collect()} == {(1, "script", True), (2, "rust", False), (4, "python", False)}
    assert {(r.file_id, r.call, r.category) for r in p.sinks(files).collect()} >= {(1, "runQuery", "query"), (2, "spawn", "command")}
    names = spark.createDataFrame([(1, "q"), (2, "q")], "file_id long, local string")
    assert {(r.file_id, r.package) for r in p.resolve(files, names).collect()} == {(1, "lib"), (2, None)}
    p.add(providers.Provider("notes", ("txt",)))
    assert files.select(p.chosen(F.col("file_path")).alias("p")).where("p is not null").count() == 4
    with pytest.raises(ValueError):
        providers.Providers().functions(files)


def test_sinks_and_readers_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("A", "critical", "a.ts", 3, "c", 0.9, True, False), ("B", "info", "b.ts", 1, "d", 0.1, False, False)], "rule_id string, severity string, path string, line long, content string, confidence double, has_taint boolean, requires_human boolean")
    sinks.write_baseline(f, f"{tmp_path}/base")
    assert {r.rule_id for r in readers.read_baseline(spark, f"{tmp_path}/base").collect()} <= {"A", "B", None} and spark.read.json(f"{tmp_path}/base").count() == 2
    (tmp_path / "b.yaml").write_text("- rule_id: A\n  path: a.ts\n  line: 3\n- rule_id: B\n  path: b.ts\n")
    assert [(r.rule_id, r.path) for r in readers.read_baseline(spark, str(tmp_path / "b.yaml")).orderBy("rule_id").collect()] == [("A", "a.ts"), ("B", "b.ts")]
    sinks.write_hypotheses(f, f"{tmp_path}/hyp")
    assert [r.rule_id for r in spark.read.json(f"{tmp_path}/hyp").collect()] == ["A"]
    sinks.write_runtime_report(f, f"{tmp_path}/run")
    t = spark.createDataFrame([(1, "x")], "id long, v string")
    sinks.build_library(t, f"{tmp_path}/lib", t, t, t, t)
    assert set(sinks.read_bundle(spark, f"{tmp_path}/lib")) == {"examples", "call_weights", "weights", "filters", "calibration"}
    sinks.write_file_cache(f, f"{tmp_path}/cache", t, t)
    assert sinks.read_file_cache(spark, f"{tmp_path}/cache", t, t).count() == 2 and sinks.read_file_cache(spark, f"{tmp_path}/cache", t.limit(0), t) is None and sinks.read_file_cache(spark, f"{tmp_path}/cache", t, t, 2) is None
    pairs = spark.createDataFrame([("ts_a_b", "ts", "exec(x)", "exec(escape(x))")], "pattern_id string, ext string, before string, after string")
    changes = spark.createDataFrame([("ts_a_b", "sanitizer_added", ["escape"], ['q"x'])], "pattern_id string, kind string, required_calls array<string>, forbidden_calls array<string>")
    back = sinks.write_learned_pattern(pairs, changes, f"{tmp_path}/learned")
    import tomllib

    assert tomllib.loads(back.where("path like '%.toml'").first().content) == {"kind": "sanitizer_added", "required_calls": ["escape"], "forbidden_calls": ['q"x']}
    examples, warnings = readers.example_files(back.where("path not like '%.toml'").withColumn("ext", F.lit("ts")))
    assert examples.count() == 2 and warnings.count() == 0
    prof = spark.createDataFrame([("rust", "k", "f", 2), ("ts", "k", "g", 1)], "language string, kind string, feature string, n long")
    readers.write_profile(prof, f"{tmp_path}/prof")
    assert readers.read_profile(spark, f"{tmp_path}/prof", ["ts"]).count() == 1 and readers.read_profile(spark, f"{tmp_path}/prof").count() == 2


def test_audits_labels_calibration_and_workspaces(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"vulnerabilities": {"lodash": {"severity": "high"}}}))
    (tmp_path / "c.json").write_text(json.dumps({"vulnerabilities": {"list": [{"advisory": {"package": "time", "severity": None}}]}}))
    assert {(r.package, r.source) for r in readers.read_audit(spark, str(tmp_path / "n.json")).collect()} == {("lodash", "npm")}
    assert {(r.package, r.source) for r in readers.read_audit(spark, str(tmp_path / "c.json")).collect()} == {("time", "cargo")}
    from loomgrain.operators import joins

    unsafe = joins.vulnerable_dependencies(spark.createDataFrame([("p", "lodash", "4.1.0"), ("p", "axios", "9.0.0")], "path string, package string, version string"), readers.advisory_table(spark))
    assert [(r.package, r.below) for r in unsafe.collect()] == [("lodash", "4.17.21")]
    (tmp_path / "l.json").write_text(json.dumps([{"id": "1", "file": "a.ts", "line": 3, "cwe": "CWE-89", "type": "sqli"}]))
    assert [(r.id, r.line) for r in readers.read_labels(spark, str(tmp_path / "l.json")).collect()] == [("1", 3)]
    (tmp_path / "k.json").write_text(json.dumps([{"scope": "global", "key": "_global", "a": 4.0, "b": -1.0, "n_samples": 10, "accuracy": 0.9}, {"scope": "category", "key": "x", "a": 1.0, "b": 0.0, "n_samples": 0, "accuracy": 0.9}]))
    assert readers.read_calibration(spark, str(tmp_path / "k.json")).count() == 1
    files = spark.createDataFrame([("package.json", json.dumps({"dependencies": {"a": "1", "b": "1"}})), ("p/q/package.json", json.dumps({"dependencies": {"b": "2"}}))], "path string, content string")
    got = {(r.path, r.package): (r.version, r.inherited) for r in readers.workspace_dependencies(files).collect()}
    assert got == {("package.json", "a"): ("1", False), ("package.json", "b"): ("1", False), ("p/q/package.json", "a"): ("1", True), ("p/q/package.json", "b"): ("2", False)}
    old = spark.createDataFrame([("a", 1), ("b", 1), ("gone", 1)], "path string, v int")
    fresh = spark.createDataFrame([("b", 2)], "path string, v int")
    assert {(r.path, r.v) for r in sinks.refresh(old, fresh, spark.createDataFrame([("a",), ("b",)], "path string")).collect()} == {("a", 1), ("b", 2)}
    assert sinks.union_all([old, fresh]).count() == 4


def test_routes_match_findings(spark):
    from loomgrain.operators import roles

    files = spark.createDataFrame([(1, "app.get('/x', show);\nrouter.post(`/y`, h);"), (2, None)], "file_id long, content string")
    assert {(r.method, r.path) for r in roles.routes(files).collect()} == {("GET", "/x"), ("POST", "/y")}
    f = spark.createDataFrame([(1, "src/a.ts", "Ctl.show"), (2, "src/b.ts", "none")], "finding_id long, path string, symbol string")
    b = spark.createDataFrame([(9, "a.ts", "show"), (8, "src/a.ts", "show"), (7, "c.ts", "show")], "route_id long, path string, handler string")
    assert [(r.finding_id, r.route_id) for r in roles.match_routes(f, b).collect()] == [(1, 8)]


def test_command_line(spark, capsys):
    from loomgrain import __main__ as cli
    from tests.conftest import DATA

    assert cli.main(["--list"]) == 0 and "pattern_findings" in capsys.readouterr().out
    assert cli.main(["--query", "no_such"], spark) == 2
    assert cli.main(["--query", "freshness_scores", "--tables", DATA, "--limit", "2"], spark) == 0 and "freshness" in capsys.readouterr().out
    o = cli.parsed(["--min-confidence", "0.5", "--rules", "A"])
    rows = spark.createDataFrame([("A", 0.9, "info"), ("A", 0.1, "info"), ("B", 0.9, "info")], "rule_id string, confidence double, severity string")
    assert cli.selected(rows, o).count() == 1


def test_texts_are_deduplicated_as_by_key(spark):
    from loomgrain.tables import latest_by_key, latest_texts

    rows = [(i % 40 if i % 40 < 12 or i < 40 else None, f"t{i}", i % 7) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, text string, at int").withColumn("at", F.timestamp_seconds("at"))
    a = {r.k: r.text for r in latest_by_key(df.withColumn("text", F.lit("x")), "k", "at", ["text"]).collect()}
    for bits in (6, 22):
        got = latest_texts(df, "k", "at", ["text"], bits).collect()
        assert len(got) == len(a) and {r.k for r in got} == set(a)
        newest = {k: max(t for q, _, t in rows if q == k) for k in a}
        assert all(next(t for q, x, t in rows if x == r.text) == newest[r.k] for r in got)
    assert latest_texts(df.limit(0), "k", "at", ["text"]).count() == 0


def test_marked_roles_and_quality_summary(spark):
    from loomgrain.operators import filters, matching

    h = {n: i for i, n in enumerate([*matching.GUARDING, *matching.DANGEROUS])}
    roles = spark.createDataFrame([(1, "consistent"), (2, "inconsistent"), (3, "consistent"), (4, "consistent")], "fn_id long, role string")
    markers = spark.createDataFrame([(1, [h["sanitize"]]), (2, [h["db_query"], None]), (3, [h["sanitize"], h["cmd_exec"]])], "fn_id long, semantic_markers array<bigint>")
    assert {r.fn_id: r.role for r in matching.marked_roles(roles, markers, h).collect()} == {1: "safe", 2: "unsafe", 3: "consistent", 4: "consistent"}
    ex = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, True)], "tier string, n int, ok boolean")
    scored = filters.quality_scores(ex, {"good": (F.col("ok"), 5)}, {"late": (F.col("n") > 2, 2)}, {"a": 4, "b": 4})
    got = {r.tier: r for r in filters.quality_summary(scored).collect()}
    assert (got["a"].examples, got["a"].enough, got["a"].least, got["a"].most, got["a"].lacking_most) == (2, 1, 0, 5, "good") and got["b"].lacking_most == "late" and got["b"].enough == 0


def test_six_kinds_of_profile(spark):
    from loomgrain.operators import profile

    cols = list(profile.SOURCE_KINDS.values())
    df = spark.createDataFrame([(1, "ts", "f", 1, *[[1, 2]] * 6), (2, "ts", "g", 2, *[[1]] * 5, None)], "fn_id long, language string, function_name string, line long, " + ", ".join(f"{c} array<bigint>" for c in cols))
    got = {(r.kind, r.feature): r.n for r in profile.learn_profile(df, kinds=profile.SOURCE_KINDS).collect()}
    assert len({k for k, _ in got}) == 6 and got[("signature", "1")] == 2 and got[("structure", "1")] == 1


def test_finding_modules(spark):
    from loomgrain.plans import modules

    files = spark.createDataFrame(
        [
            (1, "r", "h.ts", "function handler(req, res) {\n  fetch(req.query.u);\n  service(1);\n}\n"), (2, "r", "s.ts", "function service(x) {\n  exec(x);\n}\n"),
            (3, "r", "server.js", "http.createServer(a)\n"), (4, "r", "package.json", json.dumps({"dependencies": {"lodash": "4.0.0", "fine": "1.0.0"}})),
        ],
        "file_id long, repo string, file_path string, content string",
    )
    advisories = spark.createDataFrame([("lodash", "4.17.21", "high", "t")], "package string, below string, severity string, title string")
    context = {"files": files, "advisories": advisories}
    found = {(r.rule_id, r.path) for r in modules.standard().run(context).collect()}
    assert found == {("CROSS_FILE_TAINT", "r/s.ts"), ("CONFIGURATION", "server.js"), ("VULNERABLE_DEPENDENCY", "package.json")}
    assert {r.rule_id for r in modules.standard().run(context, least="critical").collect()} == {"CROSS_FILE_TAINT"}
