"""Data flow from untrusted input to dangerous calls, per function and across functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.operators import cfg, fingerprint, frontend, graph

# Where untrusted data comes from, where it must not go, and what cleans it.
SOURCES = {
    "request": r"\b(?:req|request|ctx|c\.req|ctx\.req|\w*Request)\.(?:body|query|params|headers|header|cookies|param|json|form|args|files|text|parseBody|searchParams|nextUrl)\b",
    "environment": r"\bprocess\.env\b|\b(?:env|CONFIG|__ENV__)\.\w|\bDeno\.env\.get\b|\bstd::env::|\bos\.environ\b",
    "browser": r"\b(?:location|document)\.(?:href|search|hash|cookie|referrer)\b|\blocalStorage\b|\bquerySelector\([^()]*\)\.value\b",
    "socket": r"\b(?:socket|ws|message)\.(?:data|message|read|recv)\b",
    "storage": r"\b\w*(?:KV|R2)\.(?:get|list)\b",
    "network": r"(?<![\w.])(?:fetch|got|request)\s*\(|\baxios\.get\s*\(",
    "file": r"\bfs\.(?:readFileSync|readFile|createReadStream)\s*\(|\bfsPromises\.readFile\s*\(|\breadline\.createInterface\s*\(",
    "database": r"\.(?:findUnique|findFirst|findMany|findOne|hget|lrange|getItem)\s*\(",
}
SINKS = {
    "command": ["exec", "execSync", "spawn", "spawnSync", "system", "popen", "Command::new", "subprocess.run", "subprocess.call"],
    "query": ["query", "execute", "raw", "executemany", "$queryRaw", "findOne", "aggregate"],
    "code": ["eval", "Function", "setTimeout", "vm.runInContext", "compile"],
    "file": ["readFile", "readFileSync", "writeFile", "writeFileSync", "createReadStream", "open", "unlink", "File::open", "sendFile"],
    "markup": ["innerHTML", "insertAdjacentHTML", "document.write", "dangerouslySetInnerHTML", "render_template_string"],
    "redirect": ["redirect"],
    "fetch": ["fetch", "axios", "axios.get", "axios.post", "request.get", "reqwest::get", "requests.get"],
    "log": ["console.log", "logger.info"],
}
WEAKNESS = {"command": 78, "query": 89, "code": 94, "file": 22, "markup": 79, "redirect": 601, "fetch": 918, "log": 117, "object_key": 1321}
# Calls whose result is safe anywhere, and calls whose result is safe in one kind of sink.
CLEANERS = (
    "parseInt parseFloat Number BigInt Math.round Math.floor Math.ceil Math.abs Boolean he.escape escapeHtml sanitizeHtml DOMPurify.sanitize validator.escape xss crypto.randomUUID uuidv4 nanoid Buffer.from "
    "percent_encode htmlescape::encode_minimal uuid::Uuid::new_v4 int float shlex.quote html.escape"
).split()
CONTEXT_CLEANERS = {
    "bind": "query", "db.prepare": "query", "sqlx::query!": "query", "encodeURIComponent": "url", "encodeURI": "url", "URL": "url", "new URL": "url", "path.basename": "file", "os.path.basename": "file",
}
CONTEXT_OF = {"query": "query", "redirect": "url", "fetch": "url", "file": "file"}
CLEANER = re.compile(r"[sS]anitize|[eE]scape|(?:^|\.)validate")
# Calls that pass taint on from one argument, and methods that pass it on from what they are called on.
FROM_ARGUMENT = {
    "JSON.parse": 0, "Buffer.from": 0, "atob": 0, "btoa": 0, "decodeURIComponent": 0, "decodeURI": 0, "JSON.stringify": 0, "String": 0, "Object.assign": 1, "Object.create": 0, "structuredClone": 0,
    "Array.from": 0, "Object.keys": 0, "Object.values": 0, "Object.entries": 0, "Object.fromEntries": 0, "Promise.resolve": 0, "Promise.all": 0,
}
FROM_RECEIVER = set(
    "map filter reduce find flatMap join slice concat flat replace replaceAll substring split trim toLowerCase toUpperCase padStart padEnd to_string clone strip lower upper format encode decode".split()
)
CALLBACK = re.compile(r"(?P<r>[\w$.\])]+)\s*\.\s*(?P<m>then|map|forEach|filter|flatMap|reduce|find|some|every)\s*\(\s*(?:async\s*)?(?:\(\s*(?P<p>[\w$]+)[^()]*\)|(?P<q>[\w$]+))\s*=>")
KEYED = re.compile(r"(?P<o>[\w$.]+)\[(?P<k>[\w$.]+)\]\s*=(?![=>])")
CALLED = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$.]*)\s*\(")
REQUEST_NAMES = {"req", "request", "ctx", "event", "body", "payload", "params", "query"}
SAFE_RECEIVERS = ("JSON.", "Math.", "console.", "Object.", "Array.", "Promise.", "logger.", "log::")
GUARDS = re.compile(r"\b(?:isAuthenticated|isAuthorized|requireAuth|authorize|checkPermission|hasRole|verifyToken|ensureLoggedIn|is_admin|isAdmin)\b")
STATEMENT = re.compile(r"[^;\n]*")
WORD = re.compile(r"[A-Za-z_$][\w$]*")


class Guards:
    """Whether an authorisation test that leaves early covers a position. The control-flow graph is built once, at the first question."""

    def __init__(self, code: str) -> None:
        self.code, self.braces = code, "{" in code
        self.tests = [m.start() for m in GUARDS.finditer(code)] if not self.braces else []
        self.known: cfg.Guarded | None = None

    def cover(self, at: int) -> bool:
        if self.braces:
            self.known = self.known or cfg.Guarded(self.code)
            return self.known.at(at)
        guard = next((t for t in self.tests if t < at), None)
        return guard is not None and bool(re.search(r"\b(?:return|raise)\b", self.code[guard:at]))


def is_cleaner(name: str) -> bool:
    return name in CLEANERS or name.rsplit(".", 1)[-1] in CLEANERS or bool(CLEANER.search(name))


def cleaned(text: str) -> bool:
    """Whether the text calls something that cleans its argument. Names are matched one by one: long literals cost their length."""
    return any(is_cleaner(name) for name in CALLED.findall(text))


def exposed(text: str, context: str | None = None, clean_names: frozenset[str] = frozenset()) -> str:
    """The text without what cannot carry taint: arguments of cleaners (for ``context`` those of its kind too), of functions
    known to return nothing of them, and arguments of propagators other than the one that passes on."""
    if "(" not in text:
        return text
    out, at = [], 0
    for m in CALLED.finditer(text):
        if m.start() < at:
            continue
        name, open_at = m.group(1), m.end() - 1
        new = "new " + name if text[max(0, m.start() - 4) : m.start()] == "new " else name
        kind = CONTEXT_CLEANERS.get(new) or CONTEXT_CLEANERS.get(name) or CONTEXT_CLEANERS.get(name.rsplit(".", 1)[-1])
        passing = FROM_ARGUMENT.get(name)
        close = frontend.closing(text, open_at)
        if is_cleaner(name) or kind is not None and kind == CONTEXT_OF.get(context or "") or name in clean_names:
            receiver = "" if is_cleaner(name) else text[at : m.start()]
            out.append((text[at : m.start()] if is_cleaner(name) else receiver) + "_()")
            at = close + 1
        elif passing is not None:
            args = frontend.split_arguments(text[open_at + 1 : close])
            kept = exposed(args[passing], context, clean_names) if passing < len(args) else ""
            out.append(text[at : m.start()] + f"({kept})")
            at = close + 1
    return "".join(out) + text[at:]


def merge_states(a: dict[str, str], b: dict[str, str], sure: bool = False) -> dict[str, str]:
    """What is tainted where two ways meet: on either of them, or with ``sure`` only what is on both."""
    if sure:
        return {k: v for k, v in a.items() if k in b}
    return {**b, **a}


def validator_metrics(fn: frontend.Function, tainted: set[str]) -> dict:
    """How a function treats tainted names: uses, those branched on, their share, and whether its name promises a check that it hardly makes."""
    uses = sum(w in tainted for w in WORD.findall(fn.code))
    branched = sum(any(w in tainted for w in WORD.findall(c)) for c in re.findall(r"\b(?:if|elif|match|switch|while)\b([^{:\n]*)", fn.code))
    ratio = branched / uses if uses else 0.0
    promises = bool(re.match(r"(?i)(?:is_?|has_?|check|valid|verify|ensure|assert|sanitiz)", fn.name))
    return {"uses": uses, "branched": branched, "ratio": ratio, "is_validator": promises, "hollow": promises and ratio < 0.2}


def sink_of(callee: str) -> str | None:
    """Category of a call: by its full name, its last two parts or its last part; safe receivers have none."""
    name = callee.rstrip("!")
    if name.startswith(SAFE_RECEIVERS):
        return None
    parts = re.split(r"\.|::", name)
    for category, names in SINKS.items():
        if name in names or ".".join(parts[-2:]) in names or "::".join(parts[-2:]) in names or parts[-1] in names:
            return category
    return None


def flows_of(fn: frontend.Function, clean_names: frozenset[str] = frozenset()) -> tuple[list[dict], bool, float]:
    """Flows of one function, whether its return value depends on a parameter, and the share of tainted uses branched on.

    Statements are walked in order. An assignment taints its target if what its value lets through names tainted data;
    a clean value cleans the target only where it is sure to run (outside any inner block), so both
    arms of a branch are merged by union. Callbacks of tainted values and of promises of them get tainted parameters, a
    tainted key that is written through is a sink. A guard that leaves early before a sink covers it. ``clean_names`` are functions
    of the file whose results depend on no argument.
    """
    tainted = {p: ("parameter" if p.lower() not in REQUEST_NAMES else "request") for p in fn.params}
    steps = [(a["at"], 0, a) for a in fn.assignments] + [(c["at"], 1, c) for c in fn.calls]
    steps += [(m.start("r"), -1, m) for m in CALLBACK.finditer(fn.code)] + [(m.start(), 2, m) for m in KEYED.finditer(fn.code)]
    flows, guards = [], Guards(fn.code)

    def origin(text: str, context: str | None = None) -> str | None:
        text = exposed(text, context, clean_names)
        for name, pattern in SOURCES.items():
            if re.search(pattern, text):
                return name
        code = frontend.blanked(text, False) if "`" not in text else text
        return next((tainted[w] for w in WORD.findall(code) if w in tainted), None)

    for at, kind, x in sorted(steps, key=lambda s: (s[0], s[1])):
        if kind == -1:
            o = origin(fn.body[max(0, x.start("r") - 60) : x.end("r")].rsplit(";", 1)[-1].rsplit("\n", 1)[-1])
            if o:
                tainted.setdefault(x.group("p") or x.group("q"), o)
        elif kind == 0:
            o, var = origin(x["value"]), x["var"].split(".")[0]
            if o:
                tainted.setdefault(var, o)
            elif x["depth"] == 0 and "." not in x["var"]:
                tainted.pop(var, None)
        elif kind == 2:
            o = tainted.get(x.group("k").split(".")[0])
            if o and not guards.cover(at):
                flows.append({"origin": o, "sink": x.group("o") + "[]", "category": "object_key", "line": fn.first_line + fn.code.count("\n", 0, at)})
        else:
            category = sink_of(x["name"])
            if category is None:
                continue
            o = next((o for o in (origin(arg, category) for arg in x["args"]) if o), None)
            if o and not guards.cover(at):
                flows.append({"origin": o, "sink": x["name"], "category": category, "line": x["line"]})
    returns = [fn.body[m.end() : STATEMENT.match(fn.code, m.end()).end()] for m in re.finditer(r"\breturn\b", fn.code)]
    seeds = set(fn.params) | {v for v, o in tainted.items() if o in ("parameter", "request")}
    propagates = any(not seeds.isdisjoint(WORD.findall(exposed(r, None, clean_names))) for r in returns)
    return flows, propagates, validator_metrics(fn, set(tainted))["ratio"]


def file_flows(functions: list[frontend.Function]) -> list[tuple[frontend.Function, list[dict], bool, float]]:
    """Flows of the functions of one file. Summaries come first: calls of functions that return nothing of their arguments clean."""
    first = [(f, *flows_of(f)) for f in functions]
    passing = {f.name for f, _, propagates, _ in first if propagates}
    clean = frozenset(f.name for f, *_ in first if f.name not in passing and f.params and f.name != "anonymous" and re.search(r"\breturn\b", f.code))
    if not clean:
        return first
    return [(f, *flows_of(f, clean)) if any(c["name"].rsplit(".", 1)[-1] in clean for c in f.calls) else (f, *rest) for f, *rest in first]


FLOW_SCHEMA = "file_id long, repo string, file_path string, function string, propagates boolean, branch_ratio double, flows array<struct<origin: string, sink: string, category: string, line: long>>"


def function_flows(files: DataFrame) -> DataFrame:
    """One row per function with its flows and its summary."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, repo, path, text in zip(b.file_id, b.repo, b.file_path, b.content):
                for f, flows, propagates, ratio in file_flows(frontend.functions_of(text or "", (path or "").rsplit(".", 1)[-1].lower(), path or "")):
                    out.append((fid, repo, path, f.name, propagates, ratio, flows))
            yield pd.DataFrame(out, columns=["file_id", "repo", "file_path", "function", "propagates", "branch_ratio", "flows"])

    return files.select("file_id", "repo", "file_path", "content").where("file_id is not null").mapInPandas(walk, FLOW_SCHEMA)


def weakness_of(category):
    out = F.when(F.lit(False), F.lit(0))
    for name, cwe in WEAKNESS.items():
        out = out.when(category == name, cwe)
    return out


def taint_findings(flows: DataFrame) -> DataFrame:
    """One row per flow with the weakness number of its sink and a severity."""
    rows = flows.select("file_id", "repo", "file_path", "function", F.explode("flows").alias("f")).select("file_id", "repo", "file_path", "function", "f.*")
    severity = F.when(F.col("category").isin("command", "query", "code"), "critical").when(F.col("category") == "log", "info").otherwise("warning")
    return rows.withColumn("cwe", weakness_of(F.col("category"))).withColumn("severity", severity)


def cross_file_paths(edges: DataFrame, flows: DataFrame, depth: int = 10) -> DataFrame:
    """``(sink, source, origin, path_length)``: functions with a request source above functions with a sink, along calls."""
    node = F.concat(F.concat_ws("/", "repo", "file_path"), F.lit(":"), F.col("function"))
    rows = flows.select(node.alias("node"), F.explode("flows").alias("f"))
    sinks = rows.where("f.origin = 'parameter'").select("node").distinct()
    sources = rows.where("f.origin != 'parameter'").groupBy("node").agg(F.min("f.origin").alias("origin"))
    return graph.backward_resolve(edges, sinks, sources, depth)


def project_pass(functions: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """Functions of the front end with what the whole project says about them.

    ``origin`` and ``hops`` tell the nearest function with request parameters that calls them, within ``depth`` calls; the calls of
    such a function all count as tainted, of others those with a parameter among their arguments. Columns:
    ``file_id, name, first_line, origin, hops, tainted_calls``.
    """
    node = F.concat(F.concat_ws("/", "repo", "file_path"), F.lit(":"), F.col("name"))
    rows = functions.withColumn("node", node)
    request = F.exists("params", lambda p: F.lower(p).isin(sorted(REQUEST_NAMES)))
    reached = graph.forward_propagate(edges, rows.where(request).select("node", F.lit("request").alias("origin")), depth)
    own = fingerprint.tainted_calls(F.col("calls"), F.col("params"))
    calls = F.when(F.col("origin").isNotNull(), fingerprint.names_of(F.col("calls"))).otherwise(own)
    return rows.join(reached, "node", "left").select("file_id", "name", "first_line", "origin", "hops", F.sort_array(calls).alias("tainted_calls"))
