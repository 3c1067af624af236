"""Data flow within functions: propagators, cleaners by kind of sink, callbacks, keys, reaching definitions, merges, handler flags."""

import random

import pytest

from loomgrain.operators import cfg, frontend, taint


def flows(text, ext="ts"):
    return [(x["origin"], x["category"]) for f, found, _, _ in taint.file_flows(frontend.functions_of(text, ext)) for x in found]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("db.query('a' + id);", [("parameter", "query")]),
        ("db.query('a' + escape(id));", []),
        ("db.query(id + escape(id));", [("parameter", "query")]),  # one cleaned part does not clean the whole
        ("db.query(parseInt(id));", []),
        ("fetch(encodeURIComponent(id));", []),
        ("db.query(encodeURIComponent(id));", [("parameter", "query")]),  # cleans addresses, not queries
        ("fs.readFile(path.basename(id));", []),
        ("const x = JSON.parse(id); exec(x);", [("parameter", "command")]),
        ("const x = Object.assign(id, other); exec(x);", []),  # passes on its second argument only
        ("const x = Object.assign({}, id); exec(x);", [("parameter", "command")]),
        ("id.split(',').forEach((part) => { exec(part); });", [("parameter", "command")]),
        ("load(other).then((row) => { exec(row); });", []),
        ("fetch(url).then((data) => { exec(data); });", [("network", "command")]),
        ("target[id] = 1;", [("parameter", "object_key")]),
        ("target['fixed'] = 1;", []),
        ("const q = process.env.X; exec(q);", [("environment", "command")]),
        ("const q = table.findOne({}); exec(q.cmd);", [("database", "command")]),
        ("if (!isAuthenticated(u)) { return; } db.query(id);", []),
        ("let x = id; x = 'safe'; exec(x);", []),
        ("let x = 'safe'; if (a) { x = id; } exec(x);", [("parameter", "command")]),
        ("", []),
    ],
)
def test_flows_of_one_body(body, want):
    assert flows(f"function f(id) {{ {body} }}\n") == want


def test_summaries_of_the_file_are_used():
    kept = "function tag(v) { return 'fixed'; }\nfunction f(id) { exec(tag(id)); }\n"
    assert flows(kept) == []
    assert flows(kept.replace("return 'fixed'", "return v + '!'")) == [("parameter", "command")]


def test_states_merge_by_union_and_intersection():
    a, b = {"x": "request", "y": "parameter"}, {"x": "parameter", "z": "file"}
    assert taint.merge_states(a, b) == {"x": "request", "y": "parameter", "z": "file"}
    assert taint.merge_states(a, b, sure=True) == {"x": "request"} and taint.merge_states({}, b, sure=True) == {}


def test_reaching_definitions():
    code = " let a = 1; if (c) { a = 2; } use(a); while (c) { a = a + 1; } last(a); "
    got = cfg.def_use(code, ("c",))
    name = lambda i: code[got.definitions[i][1] :][:6] if got.definitions[i][1] >= 0 else "param"
    at = {u[1]: {name(i) for i in r} for u, r in zip(got.uses, got.reaching)}
    assert at[code.index("use(a") + 4] == {"a = 1;", "a = 2;"}
    assert at[code.index("last(a") + 5] == {"a = 1;", "a = 2;", "a = a "}
    assert at[code.index("a + 1")] == {"a = 1;", "a = 2;", "a = a "}
    assert all("param" in at[u[1]] for u in got.uses if u[0] == "c") and cfg.def_use("").uses == []


def test_reaching_sets_equal_walks():
    """Random graphs: a definition reaches a block if some walk from it meets no other definition of its name."""
    rnd = random.Random(5)
    for _ in range(40):
        g = cfg.Graph()
        blocks = [g.add(i, i) for i in range(7)]
        for _ in range(11):
            g.edge(rnd.choice(blocks), rnd.choice(blocks), "next")
        made = [(rnd.choice("ab"), rnd.randrange(7)) for _ in range(6)]
        last = {(n, b): i for i, (n, b) in enumerate(made)}
        want = [set() for _ in blocks]
        for (n, b), i in last.items():
            todo, seen = [b], {b}
            while todo:
                x = todo.pop()
                want[x].add(i)
                for s, _ in g.blocks[x].successors:
                    if s not in seen and (n, s) not in last:
                        seen.add(s)
                        todo.append(s)
        assert cfg.reaching_sets(g, made) == want


def test_handler_flags():
    text = "app.get('/a', show);\nfunction show(req, res) { res.send(1); }\napp.post('/b', (req, res) => { res.json(2); });\nclass C {\n  @Get('x')\n  find(id: string, n: number) { return id; }\n  other() { return 1; }\n}\nfunction plain() { return show; }\n"
    found = {(f.name, f.first_line): f for f in frontend.functions_of(text, "ts")}
    by = {f.name: f for f in found.values()}
    assert by["show"].registered and not by["plain"].registered and by["anonymous"].registered
    assert by["find"].decorated and not by["other"].decorated and by["find"].types == ["string", "number"]
    kind = lambda code, path: next((f.export_kind for f in frontend.functions_of(code, "ts", path)), None)
    get = "export async function GET(request) { return 1; }\n"
    assert kind(get, "app/api/x/route.ts") == "http" and kind(get, "src/x.ts") is None and kind(get, "routes/+server.ts") == "svelte"
    assert kind("export const handler = async (event) => { return 1; };\n", "x.ts") == "lambda"
    assert kind("export default function page(req, res) { return 1; }\n", "pages/api/p.ts") == "default"
    assert kind("export default {\n  async fetch(request, env) { return 1; }\n};\n", "w.ts") == "worker"


def test_shape_keeps_source_order():
    f = frontend.functions_of("function f(a) { g(a); if (a) { h(); } let x = 1; for (;;) { k(a, x); } }\n", "js")[0]
    assert f.shape == ["call/1", "branch_node", "call/0", "assign", "loop_node", "call/2"]


def test_validator_metrics():
    f = frontend.functions_of("function validateId(id) { log(id, id, id, id, id); if (id) { return 1; } }\n", "js")[0]
    m = taint.validator_metrics(f, {"id"})
    assert m["uses"] == 6 and m["branched"] == 1 and m["is_validator"] and m["hollow"]


def test_symbols():
    ts = "export class A {\n  m() { return 1; }\n}\ninterface B { x: string }\ntype C = A;\nfunction f() { this.go = () => 1; }\nexport const MAX_N = 3;\n// class Not {}\n"
    got = {(n, k, line) for n, k, line in frontend.symbols_of(ts, "ts")}
    assert got >= {("A", "class", 1), ("m", "function", 2), ("B", "interface", 4), ("C", "type", 5), ("f", "function", 6), ("go", "method", 6), ("MAX_N", "constant", 7)} and not any(n == "Not" for n, _, _ in got)
    assert {(n, k) for n, k, _ in frontend.symbols_of("pub struct S;\nenum E { A }\ntrait T {}\nfn g() {}\nconst K: u8 = 1;\n", "rs")} == {("S", "struct"), ("E", "enum"), ("T", "trait"), ("g", "function"), ("K", "constant")}
    assert {(n, k, line) for n, k, line in frontend.symbols_of("LIMIT = 2\nclass P:\n    def q(self):\n        pass\n", "py")} == {("LIMIT", "constant", 1), ("P", "class", 2), ("q", "function", 3)}
    assert frontend.symbols_of("", "ts") == [] and frontend.symbols_of("x", "md") == []
