"""Problem 6: source files that do not parse.

Method: a lexer per language drives a pushdown stack. It finds unterminated literals and comments,
unbalanced delimiters and tags, premature ends, merge-conflict markers, and token sequences that no
statement of the language can hold (two operands side by side, a statement after an operator, a header
without its body, a try without a handler). Markers and quotes inside comments, strings and templates are just their content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.tables import spread

LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python"}
CLOSES = {")": "(", "]": "[", "}": "{"}
CONFLICT = re.compile(r"(<{7}|>{7}|={7}|\|{7})(?=[ \r\n]|$)")

# Words of the languages.
JS_WORDS = set(
    "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof "
    "new return super switch this throw try typeof var void while with yield null true false".split()
)
JS_STARTERS = set("break case const continue do export for if return switch throw try var while import".split())
JS_SOFT = set("async get set static of as from let".split())
TS_SOFT = JS_SOFT | set("type interface declare namespace module abstract readonly public private protected keyof infer satisfies asserts override enum implements unique global accessor is out".split())
JS_VALUES = {"this", "null", "true", "false", "super"}
RS_WORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self "
    "static struct super trait true type unsafe use where while union auto macro_rules default yield raw".split()
)
RS_STARTERS = {"use", "pub", "struct", "mod", "enum", "trait"}
RS_VALUES = {"self", "Self", "true", "false", "crate", "super"}
PY_WORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield match case type".split()
)
PY_BLOCKS = set("def class if elif else for while try except finally with async match case".split())
PY_STARTERS = set("assert break class continue def del elif except finally global import nonlocal pass raise return try while with".split())
PY_VALUES = {"False", "None", "True"}
OPERATORS = set("|&+-*/%=<>^!~?.@")


class Broken(Exception):
    """What is wrong with a text, and in which line."""


class Lexer:
    """What the languages share: tokens, the stack, and checks between neighbouring tokens."""

    keywords: set[str] = set()
    soft: set[str] = set()
    starters: set[str] = set()
    values: set[str] = set()

    def __init__(self, text: str):
        self.text = text
        self.at = 0
        self.stack: list[tuple[str, str]] = []
        self.kind, self.word = "", ""  # the token before: id, num, str, punct or nothing
        self.before = ""  # the word before that
        self.broke_line = True
        self.need = ""  # what the token after a closed header must be

    def fail(self, why: str) -> None:
        raise Broken(f"{why} in line {self.text.count(chr(10), 0, self.at) + 1}")

    def ends_operand(self) -> bool:
        return self.kind in ("num", "str") or self.word == "]" or self.kind == "id" and (self.word not in self.keywords or self.word in self.values)

    def token(self, kind: str, word: str) -> None:
        if self.need:
            self.check_header(word)
        if kind in ("id", "num", "str") and not self.broke_line and self.ends_operand() and not self.neighbours(kind, word):
            self.fail(f"{word[:20]!r} follows {self.word[:20]!r}")
        if kind == "id" and word in self.starters and self.kind == "punct" and self.word in OPERATORS and self.word != "." and not self.starter_allowed(word):
            self.fail(f"{word!r} follows {self.word!r}")
        self.before, self.kind, self.word, self.broke_line = self.word, kind, word, False

    def neighbours(self, kind: str, word: str) -> bool:
        """Whether an operand may directly follow another."""
        if self.before == ".":
            return kind == "id" and (word in self.keywords and word not in self.values or word in self.soft)
        return kind == "id" and (word in self.keywords and word not in self.values or word in self.soft) or self.kind == "id" and self.word in self.soft

    def starter_allowed(self, word: str) -> bool:
        return False

    def check_header(self, word: str) -> None:
        need, self.need = self.need, ""
        if word not in need.split():
            self.fail(f"a header is followed by {word[:20]!r}")

    def open(self, word: str) -> None:
        role = ""
        if word == "(":
            role = self.role()
        self.token("punct", word)
        self.stack.append((word, role))

    def role(self) -> str:
        return ""

    def close(self, word: str) -> str:
        if not self.stack or self.stack[-1][0] != CLOSES[word]:
            self.fail(f"{word!r} closes nothing")
        self.token("punct", word)
        return self.stack.pop()[1]

    def finish(self) -> None:
        self.at = len(self.text)
        if self.stack:
            self.fail(f"the text ends inside {self.stack[-1][0]!r}")
        if self.need:
            self.fail("the text ends after a header")
        if self.kind == "punct" and self.word in OPERATORS | {",", "=>", "("} and self.word not in "!?>*":
            self.fail(f"the text ends after {self.word!r}")


class Script(Lexer):
    """JavaScript and TypeScript, with templates, regular expressions and tags."""

    keywords, starters, values = JS_WORDS, JS_STARTERS, JS_VALUES
    TOKEN = re.compile(
        r"(?P<ws>[^\S\n]+|﻿)|(?P<nl>\n)|(?P<lc>//[^\n]*|<!--[^\n]*|\A#![^\n]*)|(?P<bc>/\*[\s\S]*?\*/)"
        r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?)"
        r"|(?P<id>[#@]?(?:[^\W\d]|\$|\\u)[\w$]*)|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<p>=>|\.\.\.|\?\.(?!\d)|\+\+|--|.)"
    )
    TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
    REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
    TAG = re.compile(r"<\s*(?:>|([A-Za-z_$][\w.$:-]*)(?=[\s/>]))")
    ATTRIBUTE = re.compile(r"\s*(?:[A-Za-z_$][\w$:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=\{)))?|(?=\{))")

    def __init__(self, text: str, typed: bool, tags: bool):
        super().__init__(text)
        self.typed, self.tags = typed, tags
        self.soft = TS_SOFT if typed else JS_SOFT

    def run(self) -> None:
        while self.at < len(self.text):
            self.step()
        self.finish()

    def step(self) -> None:
        text, m = self.text, self.TOKEN.match(self.text, self.at)
        kind, word = m.lastgroup, m.group()
        if self.at == 0 or kind != "ws" and text[self.at - 1] == "\n":
            c = CONFLICT.match(text, self.at)
            if c:
                self.fail("merge conflict")
        if kind in ("ws", "lc"):
            self.at = m.end()
        elif kind in ("nl", "bc"):
            self.broke_line |= "\n" in word
            self.at = m.end()
        elif kind == "num":
            self.at = m.end()
            if re.match(r"[\w$]", text[self.at : self.at + 1]):
                self.fail("a number runs into a word")
            self.token("num", word)
        elif kind == "id":
            self.token("id", word)
            self.at = m.end()
        elif kind == "str":
            self.token("str", word)
            self.at = m.end()
        else:
            self.punct(word, m.end())

    def punct(self, word: str, end: int) -> None:
        text = self.text
        if word in "\"'":
            self.fail("unterminated string")
        if word == "`":
            self.token("str" if not self.ends_operand() or self.broke_line else "punct", "`")
            self.at = end
            self.template()
            return
        if word == "/":
            if text.startswith("/*", self.at):
                self.fail("unterminated comment")
            if not self.ends_operand() and self.word not in (")", "}", "`") or self.word == "}" and self.broke_line:
                m = self.REGEX.match(text, self.at)
                if not m:
                    self.fail("unterminated regular expression")
                self.token("str", "regex")
                self.at = m.end()
                return
        if word == "<" and not self.ends_operand() and self.word not in (")", "}"):
            m = self.TAG.match(text, self.at)
            if m and self.tags and not (self.typed and re.match(r"<\s*[\w$]+\s*(?:,|extends\b)", text[self.at : self.at + 200])):
                if not self.stack and self.kind == "":
                    self.fail("a page, not a script")
                self.tag()
                return
            if not self.word or self.word in (";", "}") and text.startswith("<!", self.at):
                self.fail("markup where a statement starts")
        if word == "{" and not self.word and re.match(r"\{\s*\"(?:[^\"\\\n]|\\.)*\"\s*:", text[self.at :]):
            self.fail("data where a statement starts")
        if word in "([{":
            self.open(word)
        elif word in CLOSES:
            if word == "}" and self.stack and self.stack[-1][0] == "${":
                self.stack.pop()
                self.at = end
                self.template()
                return
            role = self.close(word)
            if role == "function":
                self.need = "{ : ;" if self.typed else "{"
            elif role == "switch":
                self.need = "{"
        elif word in "\\" or word == "#" or word == "@":
            self.fail(f"stray {word!r}")
        else:
            if word == ":" and not self.typed and self.stack and self.stack[-1][1] == "function" and self.kind == "id":
                self.fail("type annotation")
            self.token("punct", word)
        self.at = end

    def role(self) -> str:
        if self.word == "function" or self.before == "function" and self.kind == "id" or self.word == "*" and self.before == "function":
            return "function"
        return "switch" if self.word in ("switch", "catch") and self.before != "." else ""

    def template(self) -> None:
        """From inside a template to its end or to the next substitution."""
        self.at = self.TEMPLATE.match(self.text, self.at).end()
        if self.at >= len(self.text):
            self.fail("unterminated template")
        if self.text[self.at] == "`":
            self.at += 1
            self.kind, self.word, self.before, self.broke_line = "str", "`", "", False
        else:
            self.at += 2
            self.stack.append(("${", ""))
            self.kind, self.word = "punct", "("

    def braces(self) -> None:
        """A ``{...}`` inside markup, from its opening brace."""
        depth = len(self.stack)
        self.kind, self.word = "punct", "("
        self.stack.append(("{", ""))
        self.at += 1
        while len(self.stack) > depth:
            if self.at >= len(self.text):
                self.fail("unterminated expression in markup")
            self.step()

    def tag(self) -> None:
        """One element with its children; ends after it, where an operand ends."""
        open_tags: list[str] = []
        text = self.text
        while True:
            m = self.TAG.match(text, self.at)
            if not m:
                self.fail("malformed tag")
            name, self.at = m.group(1) or "", m.end()
            closed = False
            if m.group(1) is not None:
                while True:
                    rest = re.compile(r"\s*(/?)>").match(text, self.at)
                    if rest:
                        self.at, closed = rest.end(), bool(rest.group(1))
                        break
                    a = self.ATTRIBUTE.match(text, self.at)
                    if not a or a.end() == self.at and text[self.at : self.at + 1] != "{":
                        self.fail("malformed attribute")
                    self.at = a.end()
                    if text[self.at : self.at + 1] == "{":
                        self.braces()
            if not closed:
                open_tags.append(name)
            while open_tags:  # children
                while self.at < len(text) and text[self.at] not in "<{":
                    if text[self.at] in "}>":
                        self.fail(f"{text[self.at]!r} in markup")
                    self.at += 1
                if self.at >= len(text):
                    self.fail("unterminated element")
                if text[self.at] == "{":
                    self.braces()
                    continue
                end = re.compile(r"<\s*/\s*([\w.$:-]*)\s*>").match(text, self.at)
                if not end:
                    break
                if open_tags.pop() != end.group(1):
                    self.fail("tags do not match")
                self.at = end.end()
            if not open_tags:
                break
        self.kind, self.word, self.before, self.broke_line = "str", "element", "", False

    def starter_allowed(self, word: str) -> bool:
        return self.word in ">" or word == "import" and re.match(r"import\s*[(.]", self.text[self.at :]) is not None


class Rust(Lexer):
    keywords, starters, values = RS_WORDS, RS_STARTERS, RS_VALUES
    TOKEN = re.compile(
        r"(?P<ws>[^\S\n]+|﻿)|(?P<nl>\n)|(?P<lc>//[^\n]*|\A#!(?!\[)[^\n]*)|(?P<raw>b?c?r(?P<h>#*)\"[\s\S]*?\"(?P=h))"
        r"|(?P<num>(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?)(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?)"
        r"|(?P<str>[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|[^ux\n]))')|(?P<life>'[^\W\d]\w*(?!'))"
        r"|(?P<id>(?:r#)?[^\W\d]\w*)|(?P<p>->|=>|::|\.\.=?|.)"
    )
    COMMENT = re.compile(r"/\*|\*/")

    def run(self) -> None:
        text = self.text
        while self.at < len(text):
            if self.at == 0 or text[self.at - 1] == "\n":
                if CONFLICT.match(text, self.at):
                    self.fail("merge conflict")
            if text.startswith("/*", self.at):
                self.comment()
                continue
            m = self.TOKEN.match(text, self.at)
            kind, word = m.lastgroup, m.group()
            if kind == "h":
                kind = "raw"
            if kind == "nl":
                self.broke_line = True
            elif kind == "num":
                if re.match(r"\w", text[m.end() : m.end() + 1]):
                    self.fail("a number runs into a word")
                self.token("num", word)
            elif kind in ("str", "raw"):
                self.token("str", word)
            elif kind == "life":
                self.token("punct", "'")
            elif kind == "id":
                self.token("id", word)
            elif kind == "p":
                self.punct(word)
            self.at = m.end()
        self.finish()

    def comment(self) -> None:
        depth = 0
        for m in self.COMMENT.finditer(self.text, self.at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                self.broke_line |= "\n" in self.text[self.at : m.end()]
                self.at = m.end()
                return
        self.fail("unterminated comment")

    def punct(self, word: str) -> None:
        if word in "\"'":
            self.fail("unterminated literal")
        if word in "`\\":
            self.fail(f"stray {word!r}")
        if not self.stack and not self.word and word in "{[(<+-":
            self.fail(f"a file that starts with {word!r}")
        if word in "([{":
            self.open(word)
        elif word in CLOSES:
            if self.close(word) == "function":
                self.need = "{ ; -> where"
        else:
            self.token("punct", word)

    def neighbours(self, kind: str, word: str) -> bool:
        return super().neighbours(kind, word) or self.word == "]" and self.inside_attribute()

    def inside_attribute(self) -> bool:
        return True  # an item follows its attribute; an indexed value before a word is caught by the words after it

    def role(self) -> str:
        return "function" if self.before == "fn" and self.kind == "id" else ""

    def token(self, kind: str, word: str) -> None:
        # at the top level an item starts with one of the language's own words
        if kind == "id" and not self.stack and self.word in ("", ";", "}") and self.broke_line and word not in RS_WORDS:
            follows = self.text[self.at + len(word) : self.at + len(word) + 2].strip()
            if not follows.startswith(("!", "::", ":")):
                self.fail(f"an item starts with {word[:20]!r}")
        super().token(kind, word)

    def finish(self) -> None:
        super().finish()
        if self.word and self.word not in ("}", ";", ")", "]"):
            self.fail(f"the text ends after {self.word[:20]!r}")


FORMATTED = re.compile(r"(?i)(?:[ft]r?|r[ft])(\"\"\"|'''|\"|')")
PREFIXED = re.compile(r"(?i)[rbfut]{0,2}(\"\"\"|'''|\"|')")


def formatted_end(text: str, at: int, quote: str) -> int:
    """Where a formatted string ends whose text begins at ``at``, or -1. Fields are code: brackets nest and strings in them are whole."""
    inner: list[tuple[str, bool]] = [(quote, True)]  # open strings and brackets; for a string, whether it has fields
    while at < len(text):
        top, fields = inner[-1]
        c = text[at]
        if top in ('"', "'", '"""', "'''"):
            if text.startswith(top, at):
                inner.pop()
                at += len(top)
                if not inner:
                    return at
            elif c == "\\":
                at += 2
            elif c == "\n" and len(top) == 1:
                return -1
            elif fields and c == "{":
                if text.startswith("{{", at):
                    at += 2
                else:
                    inner.append(("{", False))
                    at += 1
            else:
                at += 1
            continue
        m = PREFIXED.match(text, at) if c in "\"'rRbBfFuUtT" else None
        if m and (m.start() == m.end() - len(m.group(1)) or not text[at - 1].isalnum()):
            inner.append((m.group(1), "f" in m.group().lower() or "t" in m.group().lower()))
            at = m.end()
        elif c in "([{":
            inner.append((c, False))
            at += 1
        elif c in ")]}":
            inner.pop()
            at += 1
        elif c == ":" and top == "{":  # the format after a field is text until the field ends
            depth = 1
            at += 1
            while at < len(text) and depth:
                depth += (text[at] == "{") - (text[at] == "}")
                if depth and (text.startswith(quote, at) or text[at] == "\n" and len(quote) == 1):
                    return -1
                at += 1
            inner.pop()
        else:
            at += 1
    return -1


class Python(Lexer):
    keywords, starters, values = PY_WORDS, PY_STARTERS, PY_VALUES
    TOKEN = re.compile(
        r"(?P<ws>[ \t\f\r]+|\\\r?\n|﻿)|(?P<nl>\n)|(?P<lc>#[^\n]*)"
        r"|(?P<str>(?i:[rbfu]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))"
        r"|(?P<num>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?)|(?P<id>[^\W\d]\w*)|(?P<p>->|:=|\*\*|//|\.\.\.|.)"
    )

    def run(self) -> None:
        text, indents, line_start = self.text, [0], True
        opened = False  # the line before ended with a colon that opens a block
        self.width, self.tries = 0, []  # indentation of the line, and of each try that still lacks its handler
        head, colon, lambdas, words_in_line = "", False, 0, 0
        while self.at < len(text):
            if line_start and not self.stack:
                m = re.compile(r"[ \t\f]*").match(text, self.at)
                rest = re.compile(r"\r?\n|#[^\n]*|\r?\Z").match(text, m.end())
                if rest:
                    self.at = rest.end()
                    if text[self.at : self.at + 1] == "\n":
                        self.at += 1
                    continue
                if CONFLICT.match(text, self.at):
                    self.fail("merge conflict")
                width = len(m.group().expandtabs(8))
                self.at, self.width = m.end(), width
                if opened and width <= indents[-1]:
                    self.fail("a block is missing")
                if not opened and width > indents[-1]:
                    self.fail("unexpected indentation")
                if opened:
                    indents.append(width)
                while width < indents[-1]:
                    indents.pop()
                if width != indents[-1]:
                    self.fail("indentation that matches no block")
                opened, line_start, head, colon, lambdas, words_in_line = False, False, "", False, 0, 0
                self.kind, self.word, self.before, self.broke_line = "", "", "", True
            m = self.TOKEN.match(text, self.at)
            kind, word = m.lastgroup, m.group()
            if kind == "nl":
                if not self.stack:
                    self.line_end(head, colon)
                    opened = head in PY_BLOCKS and self.word == ":"
                    line_start = True
            elif kind == "num":
                if re.match(r"\w", text[m.end() : m.end() + 1]):
                    self.fail("a number runs into a word")
                self.token("num", word)
            elif kind == "id":
                head = head or word
                lambdas += word == "lambda" and not self.stack
                self.token("id", word)
            elif kind == "str":
                end = m.end()
                if "{" in word and (q := FORMATTED.match(word)):  # its fields may hold strings with the same quotes
                    end = formatted_end(text, self.at + q.end(), q.group(1))
                    if end < 0:
                        self.fail("unterminated string")
                self.token("str", word)
                self.at = end
                if not words_in_line:
                    words_in_line, head = 1, head or word
                continue
            elif kind == "p":
                if word in "\"'":
                    self.fail("unterminated string")
                if word in "$?`\\" or word == "!" and text[m.end() : m.end() + 1] != "=":
                    self.fail(f"stray {word!r}")
                if word in "([{":
                    self.open(word)
                elif word in CLOSES:
                    self.close(word)
                else:
                    if word == ":" and not self.stack:
                        colon = colon or not lambdas
                        lambdas = max(0, lambdas - 1)
                    self.token("punct", word)
            if not words_in_line and kind not in ("ws", "lc", "nl"):
                words_in_line, head = 1, head or word
            self.at = m.end()
        if not line_start:
            self.line_end(head, colon)
            opened = head in PY_BLOCKS and self.word == ":"
        if opened:
            self.fail("the text ends where a block should start")
        if self.tries:
            self.fail("the text ends before the handler of a try")
        self.kind = self.word = ""
        self.finish()

    def line_end(self, head: str, colon: bool) -> None:
        if head == "from" and self.word == "*":
            return
        while self.tries and self.tries[-1] >= self.width:
            if self.tries.pop() != self.width or head not in ("except", "finally"):
                self.fail("a try without a handler")
        if head == "try":
            self.tries.append(self.width)
        if head in PY_BLOCKS - {"match", "case", "async"} and not colon:
            self.fail(f"{head!r} without a colon")
        if self.kind == "punct" and self.word in OPERATORS and self.word not in "." or self.word == "**":
            self.fail(f"a line ends after {self.word!r}")

    def neighbours(self, kind: str, word: str) -> bool:
        if kind == "str" and self.kind == "str":
            return True
        return kind == "id" and word in self.keywords and word not in self.values or self.kind == "id" and self.word in ("match", "case", "type")

    def token(self, kind: str, word: str) -> None:
        self.broke_line = False if self.kind == "str" and kind != "str" else self.broke_line
        super().token(kind, word)


def what_is_broken(text: str | None, extension: str) -> str | None:
    """Why ``text`` isn't valid in the language of ``extension``; None where it is, is null, or the language is unknown."""
    if text is None or extension not in LANGUAGES:
        return None
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    try:
        if extension == "py":
            Python(text).run()
        elif extension == "rs":
            Rust(text).run()
        else:
            Script(text, typed=extension in ("ts", "tsx"), tags=extension != "ts").run()
    except Broken as why:
        return str(why)
    return None


def checked_files(files: DataFrame, key: str = "file_id", path: str = "file_path", content: str = "content") -> DataFrame:
    """``files`` columns ``key``, ``repo``, ``language`` (of the extension) and ``problem`` (null where the file is valid).

    Null and empty contents and paths without a known extension are valid. Repeated keys are repeated.
    """
    rows = files.select(F.col(key).alias("_key"), F.col("repo").alias("_repo"), F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.(\w+)$", 1)).alias("_ext"), F.col(content).alias("_text"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["_key"], "repo": b["_repo"], "language": b["_ext"].map(LANGUAGES), "problem": [what_is_broken(t, e) for t, e in zip(b["_text"], b["_ext"])]})

    kind = dict(files.dtypes)[key]
    return spread(rows, "_key").mapInPandas(check, f"{key} {kind}, repo string, language string, problem string")


def broken_rates(checked: DataFrame, key: str = "file_id") -> DataFrame:
    """Files, broken files and their share by repository and language, with totals (null stands for all); each key once."""
    once = checked.groupBy(key).agg(F.max("repo").alias("repo"), F.max("language").alias("language"), F.max(F.col("problem").isNotNull().cast("int")).alias("bad"))
    named = once.select(F.coalesce("repo", F.lit("(none)")).alias("repo"), F.coalesce("language", F.lit("(none)")).alias("language"), "bad")
    sets = named.cube("repo", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("broken"))
    return sets.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
