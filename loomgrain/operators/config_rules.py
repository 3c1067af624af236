"""Checks of server and configuration files: what stands in active code, what only in comments, and in which files to look."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")


@dataclass(frozen=True)
class ConfigRule:
    """A check of files whose name is one of ``names`` or ends with one of ``ends``.

    With ``commented``: something that active code lacks (``active``) but comments mention. Else the active lines that hold one
    of ``any_of``, one of ``also`` and none of ``none_of`` (all lines, or the first), in files whose active code has one of ``when``
    and none of ``unless``. ``before``: words that clear a line if they stand in it or one of the five active lines before.
    """

    id: str
    severity: str
    cwe: int
    names: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    commented: tuple[str, ...] = ()
    active: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    when: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    every: bool = False


# The files, words and weakness numbers of the checks.
SERVER = ("server.js", "app.js", "index.js")
LOGIN = ("-dao.js", "_dao.js", "session.js", "auth.js", "login.js")
RULES = [
    ConfigRule("A5-HELMET_MISSING", "warning", 1021, SERVER, commented=("helmet",), active=("helmet(",)),
    ConfigRule("A5-X_POWERED_BY", "warning", 200, SERVER, commented=("x-powered-by",), active=('app.disable("x-powered-by"', "app.disable('x-powered-by'", "app.disable(`x-powered-by`")),
    ConfigRule("A5-NOSNIFF", "warning", 200, SERVER, commented=("nosniff", "noSniff()", "dont-sniff"), active=("nosniff(", "noSniff(", "dont-sniff")),
    ConfigRule("A5-COOKIE_NAME", "warning", 200, SERVER, commented=('key: "sessionId"', 'key : "sessionId"', "key: 'sessionId'", "key : 'sessionId'"), active=("key:", "key :")),
    ConfigRule("A8-CSRF_MIDDLEWARE", "warning", 352, SERVER, commented=("csrf", "csurf"), active=("csrf(", "csurf(", "xsrf(")),
    ConfigRule("A5-SAVE_UNINIT", "warning", 384, SERVER, any_of=("saveUninitialized: true", "save_uninitialized: true", "saveUninitialized : true")),
    ConfigRule("A5-HTTP", "critical", 319, SERVER, any_of=("http.createServer",), unless=("https.createServer",)),
    ConfigRule("A3-SWIG_AUTOESCAPE", "warning", 79, SERVER, any_of=("autoescape: false", "autoescape : false")),
    ConfigRule("A3-MARKED_VULN", "warning", 79, SERVER, any_of=("marked.setOptions", "marked.set_options")),
    ConfigRule("A5-COOKIE_FLAGS", "warning", 1004, SERVER, any_of=("cookie:", "cookie :", "session({", "saveUninitialized"), unless=("httpOnly: true", "httpOnly : true")),
    ConfigRule("A2-USER_ENUM", "warning", 204, SERVER, LOGIN, any_of=("invalidUserName", "invalidPassword", "user not found", "User not found", "doesn't exist", "does not exist", "no account", "No account", "invalid user", "Invalid user")),
    ConfigRule("A2-WEAK_PW", "warning", 521, SERVER, ("-dao.js", "_dao.js", "session.js", "user.js", "auth.js"), any_of=("PASS_RE", "password"), unless=("minLength", "min_length", "minlength", "minLen", "password.length", "password.len", "passwordStrength")),
    ConfigRule("A2-NO_SESSION_REGENERATE", "warning", 384, (), LOGIN, any_of=("req.session",), also=("= ",), when=("login", "authenticate", "signin"), before=("regenerate",)),
    ConfigRule("A7-NO_ADMIN_CHECK", "warning", 862, (), ("index.js", "admin.js", "routes.js"), any_of=("/benefits", "/admin"), none_of=("isAdmin", "is_admin", "requireAdmin", "ensureAdmin", "require(", "import ", "from ", "const ", "let ", "var ")),
    ConfigRule("A1-LOG_INJECTION", "warning", 117, (), ("session.js", "auth.js", "login.js"), any_of=('console.log("Error:',)),
    ConfigRule("A3-WRONG_ENCODING", "warning", 79, ("profile.js", "user.js"), any_of=("encodeForHTML",), also=("website", "url"), every=True),
    ConfigRule("A4-IDOR_PARAM", "critical", 639, (), ("allocations.js", "profile.js", "users.js"), any_of=("req.params",), when=("userId",)),
    ConfigRule("A10-SSRF", "critical", 918, (), ("research.js", "proxy.js", "fetch.js"), any_of=("needle.get(",)),
    ConfigRule("REDOS", "warning", 1333, (), ("profile.js", "validate.js", "regex.js"), any_of=("+)+", "+}+", "*)+", "*}+"), every=True),
    ConfigRule("HPP_DOS", "warning", 235, (), ("profile.js", "user.js", "auth.js"), any_of=(".trim(",), also=("firstName", "lastName", "body"), every=True),
]


def active_code(text: str) -> str:
    """The text without comments; every line stays where it was."""
    return COMMENT.sub(lambda m: "\n" * m.group().count("\n"), text)


def _holds(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def violations(rule: ConfigRule, text: str) -> list[int]:
    """Lines (from 1) at which a text breaks a rule."""
    active = active_code(text)
    if rule.commented:
        if _holds(active, rule.active):
            return []
        hits = [m for m in COMMENT.finditer(text) if _holds(m.group(), rule.commented)]
        if not hits:
            return []
        at = min(hits[0].group().find(w) for w in rule.commented if w in hits[0].group())
        return [text.count("\n", 0, hits[0].start() + at) + 1]
    if rule.when and not _holds(active, rule.when) or _holds(active, rule.unless):
        return []
    lines = active.split("\n")
    found = [
        i + 1
        for i, line in enumerate(lines)
        if _holds(line, rule.any_of) and (not rule.also or _holds(line, rule.also)) and not _holds(line, rule.none_of) and not (rule.before and any(_holds(x, rule.before) for x in lines[max(0, i - 5) : i + 1]))
    ]
    return found if rule.every else found[:1]


def config_findings(files: DataFrame, rules: list[ConfigRule] | None = None) -> DataFrame:
    """``(file_id, rule_id, severity, cwe, line)`` of ``files(file_id, file_path, content)``. Only files that a rule names leave the JVM."""
    chosen = RULES if rules is None else rules
    name = F.substring_index("file_path", "/", -1)
    gates = [name.isin(*sorted({n for r in chosen for n in r.names}))] if any(r.names for r in chosen) else []
    gates += [name.endswith(e) for e in sorted({e for r in chosen for e in r.ends})]
    kept = files.where("content is not null").where(reduce(lambda a, b: a | b, gates)) if gates else files.limit(0)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, path, text in zip(b.file_id, b.file_path, b.content):
                base = path.rsplit("/", 1)[-1]
                for r in chosen:
                    if base in r.names or base.endswith(r.ends or ("\0",)):
                        out += [(fid, r.id, r.severity, r.cwe, line) for line in violations(r, text)]
            yield pd.DataFrame(out, columns=["file_id", "rule_id", "severity", "cwe", "line"])

    return kept.select("file_id", "file_path", "content").mapInPandas(check, "file_id long, rule_id string, severity string, cwe int, line long")
