"""Source text to functions, calls and assignments, for scripts, Rust and Python.

There is no grammar library here: a scanner that knows strings, comments and brackets finds function
headers and their bodies. It sees calls with their arguments, assignments, branches, loops, returns, awaits and
guards; it does not see types or operator precedence. Each file is scanned by itself in an Arrow batch,
and everything after it is relational again.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = re.compile(
    r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.)*'(?!\w)|`(?:[^`\\]|\\[\s\S])*`)"
)
BLANK_PY = re.compile(r"(?P<c>#[^\n]*)|(?P<s>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')")
HEADER = {
    "script": re.compile(
        r"\bfunction\s*\*?\s*(?P<n1>[\w$]+)?\s*(?:<[^()]*>)?\s*(?P<p1>\()|(?:\b(?:const|let|var)\s+(?P<n2>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?P<p2>\()(?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]+)?=>))"
        r"|(?<=[(,])\s*(?:async\s*)?(?P<p4>\()(?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]+)?=>\s*\{)"
        r"|^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(?P<n3>[\w$]+)\s*(?P<p3>\()(?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={;]+)?\{)",
        re.M,
    ),
    "rust": re.compile(r"\bfn\s+(?P<n1>\w+)\s*(?:<[^()]*>)?\s*(?P<p1>\()"),
    "python": re.compile(r"^(?P<i>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<n1>\w+)[ \t]*(?P<p1>\()", re.M),
}
CALL = re.compile(r"(?<![\w$.])((?:await\s+)?(?:new\s+)?[A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*!?)\s*\(")
CHAINED = re.compile(r"\s*\??\.\s*[A-Za-z_]\w*\s*\(")
# What fails at the first letter of a word fails at the others.
ASSIGN = re.compile(r"(?<![A-Za-z_$])(?:\b(?:const|let(?:\s+mut)?|var)\s+)?(?P<v>[A-Za-z_$][\w$.]*)\s*(?::\s*[^=;\n(]+)?(?<![=!<>+\-*/%&|^])=(?![=>])\s*(?P<r>[^;\n]+)")
EVENTS = re.compile(r"\b(?:(?P<branch>if|elif|match|switch|case)|(?P<loop>for|while|loop)|(?P<return>return)|(?P<break>break|continue)|(?P<try>try)|(?P<catch>catch|except)|(?P<await>await)|(?P<throw>throw|raise))\b")
# Control words and what else opens, closes or ends a statement.
NESTING = re.compile(EVENTS.pattern + r"|\b(?P<more>else|finally)\b|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>[;,])|(?P<line>\n\s*)")
NEXT = re.compile(r"\s*(\w+|[^\s\w])?")
HOLDERS = {"script": set("if switch for while return try catch".split()), "rust": set("if match for while loop return".split()), "python": set("if elif match for while return try except".split())}
PATH_DEPTH = 10
# How handlers are registered, decorated and exported.
REGISTRATION = re.compile(r"\b(?:app|router|route|server|fastify|hono)\.(?:get|post|put|delete|patch|use|all)\s*(\()")
DECORATED = re.compile(r"@(?:Get|Post|Put|Delete|Patch|All|Query|Mutation|Subscription|GrpcMethod|SubscribeMessage)\b[^\n]*\n(?:\s*@[^\n]*\n)*\s*$")
VERBS = {"GET", "POST", "PUT", "DELETE", "PATCH"}
# Families of constructs that count as one in a skeleton.
SHAPES = {"branch": "branch_node", "loop": "loop_node", "try": "catch_node", "catch": "catch_node"}
NOT_CALLS = set("if for while switch catch return function match elif with await new typeof def fn print".split())


def family(extension: str) -> str | None:
    return {"ts": "script", "tsx": "script", "js": "script", "jsx": "script", "rs": "rust", "py": "python"}.get(extension)


def blanked(text: str, python: bool) -> str:
    """The text with comments and the insides of strings turned to spaces; every position stays where it was."""

    def blank(m: re.Match) -> str:
        s = m.group()
        if m.lastgroup == "c":
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s

    return (BLANK_PY if python else BLANK).sub(blank, text)


def closing(code: str, at: int) -> int:
    """Position of the bracket that closes the one at ``at``; the end of the text if none does."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for m in re.compile(r"[()\[\]{}]").finditer(code, at):
        c = m.group()
        if c in "([{":
            stack.append(c)
        elif stack and stack[-1] == pairs[c]:
            stack.pop()
            if not stack:
                return m.start()
    return len(code)


def split_arguments(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


@dataclass
class Function:
    name: str
    first_line: int
    last_line: int
    params: list[str]
    body: str
    code: str
    offset: int
    signature: str = ""
    calls: list[dict] = field(default_factory=list)
    assignments: list[dict] = field(default_factory=list)
    events: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    shape: list[str] = field(default_factory=list)
    marks: list[tuple[int, str]] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    decorated: bool = False
    registered: bool = False
    export_kind: str | None = None


def parameter_type(text: str, kind: str) -> str | None:
    """The declared type of a parameter, without its default."""
    m = re.match(r"[^:=]*:(?!:)\s*([^=]+)", text, re.S)
    return re.sub(r"\s+", " ", m.group(1)).strip() if m else None


def registrations(code: str, text: str) -> tuple[set[str], list[int]]:
    """Names that router calls of a file are given as handlers, and where arguments of such calls begin."""
    names, starts = set(), []
    for m in REGISTRATION.finditer(code):
        open_at = m.start(1)
        close = closing(code, open_at)
        depth, begin = 0, open_at + 1
        for at in range(open_at + 1, close + 1):
            c = code[at : at + 1]
            depth += (c in "([{" and c != "") - (c in ")]}" and at < close)
            if at == close or c == "," and depth == 0:
                arg = text[begin:at].strip()
                starts.append(begin + len(text[begin:at]) - len(text[begin:at].lstrip()))
                if re.fullmatch(r"[A-Za-z_$][\w$.]*", arg):
                    names.add(arg.rsplit(".", 1)[-1])
                begin = at + 1
    return names, starts


def export_kind(before: str, name: str, path: str, code: str, at: int) -> str | None:
    """What a framework takes an exported function for, by its name and the file's path."""
    m = re.search(r"\bexport\s+(default\s+)?(?:async\s+)?(?:(?:const|let|var)\s+)?$", before)
    if not m:
        opened = code.rfind("export default", 0, at)
        return "worker" if name == "fetch" and opened >= 0 and re.match(r"export default\s*\{", code[opened:at]) else None
    if name in VERBS and "+server" in path:
        return "svelte"
    if name in VERBS and "api/" in path:
        return "http"
    if m.group(1) and "pages/api/" in path:
        return "default"
    return "lambda" if name in ("handler", "lambdaHandler") else None


def parameter_name(text: str, kind: str) -> str:
    text = re.sub(r"=.*", "", text, flags=re.S).strip().lstrip("*.&")
    text = re.sub(r"^(?:(?:mut|ref|public|private|readonly)\s+)+", "", text)
    return re.split(r"[:\s]", text, maxsplit=1)[0].strip("{}[]? ") or ""


def functions_of(text: str, extension: str, path: str = "") -> list[Function]:
    kind = family(extension)
    if kind is None or not text:
        return []
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    code = blanked(text, kind == "python")
    found = []
    line_at = [m.start() for m in re.finditer(r"\n", code)]

    def line(pos: int) -> int:
        return bisect.bisect_left(line_at, pos) + 1

    handlers, starts = registrations(code, text) if kind == "script" else (set(), [])
    for m in HEADER[kind].finditer(code):
        n = next((g for g in ("1", "2", "3", "4") if m.groupdict().get(f"p{g}")), "1")
        name, start = m.groupdict().get(f"n{n}") or "anonymous", m.start(f"p{n}")
        end = closing(code, start)
        if n == "4" and not any(m.start() <= at <= start for at in starts):
            continue  # of functions in place only those given to a router stand by themselves
        declared = split_arguments(text[start + 1 : end])
        params = [parameter_name(p, kind) for p in declared]
        if kind == "python":
            colon = code.find(":", end)
            if colon < 0:
                continue
            indent = len(m.group("i").expandtabs(8))
            stop = re.compile(r"\n(?=(?P<w>[ \t]*)[^\s#])")
            body_end = len(code)
            for s in stop.finditer(code, colon):
                if len(s.group("w").expandtabs(8)) <= indent:
                    body_end = s.start()
                    break
            body_start = colon + 1
        else:
            body_start = code.find("{", end)
            semicolon = code.find(";", end)
            if body_start < 0 or 0 <= semicolon < body_start:
                continue
            body_end = closing(code, body_start)
            body_start += 1
        body_code = code[body_start:body_end]
        fn = Function(name, line(m.start()), line(min(body_end, len(code) - 1)), [p for p in params if p and p != "self"], text[body_start:body_end], body_code, body_start, text[m.start() : body_start].strip())
        fn.types = [t for t in (parameter_type(p, kind) for p in declared) if t]
        if kind == "script":
            before = code[max(0, m.start() - 400) : m.start() + (len(m.group()) - len(m.group().lstrip()))]
            fn.decorated = n == "3" and bool(DECORATED.search(before))
            fn.registered = name in handlers or n == "4"
            fn.export_kind = export_kind(before, name, path, code, m.start())
        for c in CALL.finditer(body_code):
            callee = re.sub(r"^(?:await|new)\s+|\s", "", c.group(1)).replace("?.", ".")
            if callee.split(".")[0] in NOT_CALLS:
                continue
            open_at = c.end() - 1
            close = closing(body_code, open_at)
            args, after = split_arguments(fn.body[open_at + 1 : close]), close + 1
            # arguments of calls chained on the result, as in a builder
            while m := CHAINED.match(body_code, after):
                close = closing(body_code, m.end() - 1)
                args += split_arguments(fn.body[m.end() : close])
                after = close + 1
            fn.calls.append({"name": callee, "at": c.start(), "line": line(body_start + c.start()), "args": args})
        depth_at = _depths(body_code)
        for a in ASSIGN.finditer(body_code):
            fn.assignments.append({"var": a.group("v"), "at": a.start("v"), "value": fn.body[a.start("r") : a.end("r")].strip(), "depth": depth_at(a.start("v"))})
        fn.events = [e.lastgroup for e in EVENTS.finditer(body_code)]
        fn.marks = [(e.start(), e.lastgroup) for e in EVENTS.finditer(body_code)]
        marks = [(e.start(), SHAPES.get(e.lastgroup, e.lastgroup)) for e in EVENTS.finditer(body_code)]
        marks += [(c["at"], f"call/{len(c['args'])}") for c in fn.calls] + [(a["at"], "assign") for a in fn.assignments]
        fn.shape = [kind_of for _, kind_of in sorted(marks)]
        flat = re.sub(r"([\"'`])\s*\1", lambda s: s.group().replace("\n", " "), body_code)  # line ends within strings end nothing
        fn.paths = indented_paths(flat) if kind == "python" else braced_paths(flat, kind)
        found.append(fn)
    return found


class _Paths(dict):
    def note(self, above: list[str], event: str) -> None:
        if len(above) < PATH_DEPTH:
            self[">".join([*above, event])] = None


@dataclass
class _Open:
    """A control event whose statement is not over: ``head`` before its body, ``opening`` before its brace, ``block``, ``single``, ``wait`` for its next part."""

    event: str
    word: str
    depth: int
    state: str = "head"
    start: int = 0
    tail: bool = False


def braced_paths(code: str, kind: str) -> list[str]:
    """Distinct nesting paths of all control events of a body in braces, from the root, those of up to ``PATH_DEPTH`` events."""
    paths, stack, depth, rust = _Paths(), [], 0, kind == "rust"

    def following(at: int) -> str:
        return NEXT.match(code, at).group(1) or ""

    def finish(at: int) -> None:
        """The body of the innermost statement is over, and with it every statement that it ends."""
        while stack:
            if following(at) in {"if": ("else",), "try": ("catch", "finally")}.get(stack[-1].word, ()):
                stack[-1].state = "wait"
                return
            stack.pop()
            if not stack or stack[-1].depth != depth or stack[-1].state not in ("single", "wait"):
                return

    def begin(at: int) -> None:
        block = following(at) == "{"
        if stack[-1].tail and not block:  # the condition of do ... while
            stack.pop()
        else:
            stack[-1].state, stack[-1].start = "opening" if block else "single", at

    for m in NESTING.finditer(code):
        what, word, at = m.lastgroup, m.group(), m.end()
        if what == "open":
            if stack and stack[-1].depth == depth and word == "{" and stack[-1].state in ("head", "opening"):
                stack[-1].state = "block"
            depth += 1
            continue
        if what == "close":
            depth -= 1
            while stack and stack[-1].depth > depth:
                stack.pop()
        top = stack[-1] if stack and stack[-1].depth == depth else None
        if what == "close":
            if top and word == "}" and top.state == "block":
                if rust and following(at) == "=":  # the braces of a pattern
                    top.state = "head"
                else:
                    finish(at)
            elif top and word == ")" and top.state == "head" and not rust:
                begin(at)
        elif what == "more":
            if top and top.state == "wait":
                begin(at)
        elif what == "end":
            if top and top.state != "block" and (word == ";" or rust):
                finish(m.start() + 1)
        elif what == "line":
            if top and top.state == "single" and not rust:
                body = code[top.start : m.start()].rstrip()
                goes_on = bool(body) and body[-1] in "+-*/%&|^=<>?:,.!~" or following(at)[:1] in tuple("+-*/%&|^=<>?:,.")
                if not goes_on and (body or top.word == "return"):
                    finish(at)
        else:
            paths.note([f.event for f in stack], what)
            if word in HOLDERS[kind] and code[m.start() - 1 : m.start()] != ".":
                stack.append(_Open(what, word, depth, start=at, tail=word == "while" and code[max(m.start() - 80, 0) : m.start()].rstrip().endswith("}")))
                if word in ("try", "loop", "return"):
                    begin(at)
                    if word == "return":
                        stack[-1].state = "single"
    return list(paths)


def indented_paths(code: str) -> list[str]:
    """As ``braced_paths`` for a body by indentation. Words within expressions hold no others."""
    paths, stack, depth, indent, line_start = _Paths(), [], 0, None, 0  # stack of (event, indent, whether it is a later part of the statement below)
    for m in NESTING.finditer("\n" + code):
        what, word = m.lastgroup, m.group()
        if what in ("open", "close"):
            depth = max(depth + (1 if what == "open" else -1), 0)
        elif what == "line":
            if depth == 0 and not code[: m.start() - 1][-1:] == "\\":
                indent, line_start = len(word.rsplit("\n", 1)[-1].expandtabs(8)), m.end() - 1
                part = re.compile(r"(?:elif|else|except|finally)\b").match(code, line_start)
                while stack and (stack[-1][1] > indent or stack[-1][1] == indent and (stack[-1][2] or not part)):
                    stack.pop()
        elif what not in ("more", "end"):
            before = code[line_start : m.start() - 1].strip()
            paths.note([e for e, _, _ in stack], what)
            if word in HOLDERS["python"] and depth == 0 and (before in ("", "async") or before[-1] in ":;"):
                stack.append((what, indent, word in ("elif", "except")))
    return list(paths)


def _depths(code: str):
    """Nesting depth in braces before a position: one running sum, looked up by bisection."""
    places, depths, depth = [], [0], 0
    for m in re.finditer(r"[{}]", code):
        depth += 1 if m.group() == "{" else -1
        places.append(m.start())
        depths.append(depth)
    return lambda at: depths[bisect.bisect_left(places, at)]


FUNCTION_SCHEMA = (
    "file_id long, repo string, file_path string, name string, first_line long, last_line long, params array<string>, calls array<struct<name: string, line: long, args: array<string>, at: long>>, "
    "assignments array<struct<var: string, value: string, at: long>>, control array<string>, control_paths array<string>, shape array<string>, marks array<struct<at: long, kind: string>>, types array<string>, decorated boolean, registered boolean, export_kind string, signature string, body string"
)
COLUMNS = "file_id repo file_path name first_line last_line params calls assignments control control_paths shape marks types decorated registered export_kind signature body".split()


def extract_functions(files: DataFrame) -> DataFrame:
    """One row per function of ``files(file_id, repo, file_path, content)``. Null contents and unknown extensions have none."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, repo, path, text in zip(b.file_id, b.repo, b.file_path, b.content):
                for f in functions_of(text or "", (path or "").rsplit(".", 1)[-1].lower(), path or ""):
                    calls = [{"name": c["name"], "line": c["line"], "args": c["args"], "at": c["at"]} for c in f.calls]
                    marks = [{"at": at, "kind": kind} for at, kind in f.marks]
                    assigned = [{"var": a["var"], "value": a["value"], "at": a["at"]} for a in f.assignments]
                    out.append((fid, repo, path, f.name, f.first_line, f.last_line, f.params, calls, assigned, f.events, f.paths, f.shape, marks, f.types, f.decorated, f.registered, f.export_kind, f.signature, f.body))
            yield pd.DataFrame(out, columns=COLUMNS)

    return files.select("file_id", "repo", "file_path", "content").where("file_id is not null").mapInPandas(scan, FUNCTION_SCHEMA)


def call_edges(functions: DataFrame) -> DataFrame:
    """Calls between functions of one repository ``(src, dst)`` as ``repo/path:name``: the callee of the same file, else the only one of its name."""
    key = F.concat(F.concat_ws("/", "repo", "file_path"), F.lit(":"), F.col("name"))
    nodes = functions.select("repo", "file_path", "name", key.alias("node")).distinct()
    uses = functions.select("repo", "file_path", key.alias("src"), F.explode("calls").alias("c")).select("repo", "file_path", "src", F.regexp_extract("c.name", r"([^.:!]*)!?$", 1).alias("name")).distinct()
    here = nodes.select("repo", "file_path", "name", F.col("node").alias("here"))
    only = nodes.groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("node").alias("only")).where("n = 1").drop("n")
    met = uses.join(here, ["repo", "file_path", "name"], "left").join(only, ["repo", "name"], "left")
    return met.select("src", F.coalesce("here", "only").alias("dst")).where("dst is not null and src != dst").distinct()


# How declarations other than functions begin, by kind.
SYMBOLS = {
    "script": re.compile(r"\b(?:(?P<class>class)|(?P<interface>interface)|(?P<enum>enum)|(?P<type>type)|(?P<module>namespace))\s+(?P<n>[A-Za-z_$][\w$]*)|\bthis\.(?P<method>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|[\w$]+\s*=>)|^(?:export\s+)?const\s+(?P<constant>[A-Z][A-Z0-9_]+)\b", re.M),
    "rust": re.compile(r"\b(?:(?P<struct>struct)|(?P<enum>enum)|(?P<trait>trait)|(?P<type>type)|(?P<module>mod)|(?P<macro>macro_rules!))\s+(?P<n>\w+)|\b(?:const|static)\s+(?P<constant>[A-Z][A-Z0-9_]*)\b"),
    "python": re.compile(r"^[ \t]*(?P<class>class)\s+(?P<n>\w+)|^(?P<constant>[A-Z][A-Z0-9_]+)\s*[:=]", re.M),
}


def symbols_of(text: str, extension: str, path: str = "") -> list[tuple[str, str, int]]:
    """``(name, kind, line)`` of all declarations: functions, classes, types, constants, and methods assigned to ``this``."""
    kind = family(extension)
    if kind is None or not text:
        return []
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    out = [(f.name, "function", f.first_line) for f in functions_of(text, extension, path)]
    code = blanked(text, kind == "python")
    for m in SYMBOLS[kind].finditer(code):
        found = {k: v for k, v in m.groupdict().items() if v and k != "n"}
        what, word = next(iter(found.items()))
        out.append((m.groupdict().get("n") or word, what, code.count("\n", 0, m.start()) + 1 + m.group()[: len(m.group()) - len(m.group().lstrip())].count("\n")))
    return sorted(out, key=lambda s: (s[2], s[0]))


def discovered_symbols(files: DataFrame) -> DataFrame:
    """``(file_id, name, kind, line)`` of all declarations of ``files(file_id, file_path, content)``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, path, text in zip(b.file_id, b.file_path, b.content):
                out += [(fid, *s) for s in symbols_of(text or "", (path or "").rsplit(".", 1)[-1].lower(), path or "")]
            yield pd.DataFrame(out, columns=["file_id", "name", "kind", "line"])

    return files.select("file_id", "file_path", "content").where("file_id is not null").mapInPandas(scan, "file_id long, name string, kind string, line long")
