"""Control-flow graphs of single functions, dominators and guards. Procedural, inside one function's text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomgrain.operators.frontend import closing

GUARD = re.compile(r"(?i)\b(?:is_?auth\w*|require_?auth\w*|authorize\w*|check_?permission\w*|has_?role\w*|verify_?token\w*|is_?admin|current_?user|session\.user|req\.user)\b")
HEAD = re.compile(r"\b(if|while|for|loop|try|catch|finally|else|switch|match)\b")


@dataclass
class Block:
    id: int
    start: int
    end: int
    successors: list[tuple[int, str]] = field(default_factory=list)


@dataclass
class Graph:
    blocks: list[Block] = field(default_factory=list)

    def add(self, start: int, end: int) -> Block:
        self.blocks.append(Block(len(self.blocks), start, end))
        return self.blocks[-1]

    def edge(self, a: Block, b: Block, kind: str) -> None:
        if (b.id, kind) not in a.successors:
            a.successors.append((b.id, kind))

    def predecessors(self) -> list[set[int]]:
        out = [set() for _ in self.blocks]
        for b in self.blocks:
            for s, _ in b.successors:
                out[s].add(b.id)
        return out


def build(code: str) -> Graph:
    """Blocks of a brace language's body (strings and comments blanked). Edges: next, true, false, back, exception."""
    g = Graph()
    entry = g.add(0, 0)
    _sequence(g, code, 0, len(code), entry)
    return g


def _sequence(g: Graph, code: str, at: int, end: int, current: Block) -> Block:
    while at < end:
        m = HEAD.search(code, at, end)
        if not m:
            break
        word, cursor = m.group(1), m.end()
        current.end = m.start()
        while cursor < end and code[cursor] in " \t\n":
            cursor += 1
        condition = (cursor, cursor)
        if cursor < end and code[cursor] == "(":
            close = min(closing(code, cursor), end)
            condition, cursor = (cursor, close), close + 1
        brace = code.find("{", cursor, end)
        semicolon = code.find(";", cursor, end)
        if brace < 0 or 0 <= semicolon < brace:
            stop = semicolon if semicolon >= 0 else end
            body = (cursor, stop)
            at = stop + 1
        else:
            close = min(closing(code, brace), end)
            if condition[0] == condition[1]:
                condition = (cursor, brace)
            body = (brace + 1, close)
            at = close + 1
        if word in ("while", "for", "loop"):  # the test of a loop is a block of its own: what comes before it is not run again
            head = g.add(m.start(), condition[1])
            g.edge(current, head, "next")
            current = head
        current.end = max(current.end, condition[1])
        inner = g.add(*body)
        after = g.add(at, at)
        if word in ("while", "for", "loop"):
            g.edge(current, inner, "true")
            last = _sequence(g, code, *body, inner)
            g.edge(last, current, "back")
            g.edge(current, after, "false")
        elif word in ("try",):
            g.edge(current, inner, "next")
            last = _sequence(g, code, *body, inner)
            g.edge(last, after, "next")
        elif word == "catch":
            g.edge(current, inner, "exception")
            last = _sequence(g, code, *body, inner)
            g.edge(last, after, "next")
            g.edge(current, after, "next")
        else:
            g.edge(current, inner, "next" if word in ("else", "finally") else "true")
            last = _sequence(g, code, *body, inner)
            if not re.search(r"\b(?:return|throw|break|continue|raise)\b[^{}]*$", code[body[0] : body[1]]):
                g.edge(last, after, "next")
            if word != "finally":
                g.edge(current, after, "false")
        current = after
    current.end = max(current.end, end)
    return current


def dominators(g: Graph) -> list[set[int]]:
    """Blocks that every way to a block passes; by intersection over predecessors until nothing changes."""
    every = set(range(len(g.blocks)))
    preds = g.predecessors()
    dom = [{0} if i == 0 else set(every) for i in every]
    changed = True
    while changed:
        changed = False
        for i in range(1, len(dom)):
            ways = [dom[p] for p in preds[i]]
            new = {i} | (set.intersection(*ways) if ways else set())
            if new != dom[i]:
                dom[i], changed = new, True
    return dom


def frontier(g: Graph) -> list[set[int]]:
    """Blocks where a block's dominance ends."""
    dom, preds = dominators(g), g.predecessors()
    out = [set() for _ in g.blocks]
    for b, ways in enumerate(preds):
        for p in ways:
            for d in dom[p]:
                if d not in dom[b] - {b}:
                    out[d].add(b)
    return out


class Guarded:
    """Positions of one function's code behind an early exit of an authorisation test; graph and dominators are built once."""

    def __init__(self, code: str) -> None:
        self.code = code
        self.tests = bool(GUARD.search(code))
        if self.tests:
            self.graph = build(code)
            self.dom = dominators(self.graph)

    def at(self, position: int) -> bool:
        if not self.tests:
            return False
        g, code = self.graph, self.code
        holder = max((b for b in g.blocks if b.start <= position <= b.end), key=lambda b: (b.start, -b.end), default=None)
        if holder is None:
            return False
        for d in self.dom[holder.id] - {holder.id}:  # the test itself comes after what else its block holds
            block = g.blocks[d]
            inner = [g.blocks[s] for s, kind in block.successors if kind == "true"]
            if GUARD.search(code[block.start : block.end]) and any(re.search(r"\b(?:return|throw)\b", code[i.start : i.end]) and not i.start <= position <= i.end for i in inner):
                return True
        return False


def guarded(code: str, position: int) -> bool:
    """Whether an early exit behind an authorisation test dominates the position."""
    return Guarded(code).at(position)


@dataclass
class DefUse:
    """Definitions ``(name, position, block)``, uses likewise, and for each use the definitions that may reach it."""

    definitions: list[tuple[str, int, int]]
    uses: list[tuple[str, int, int]]
    reaching: list[list[int]]


WRITTEN = re.compile(r"(?<![\w$.])(?:(?:const|let(?:\s+mut)?|var)\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=;(){}\n]+)?(?:[+\-*/%&|^]|\*\*|<<|>>)?=(?![=>])")
READ = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*")
RESERVED = set("if else while for loop try catch finally switch match return const let var new await async function in of typeof throw break continue case default mut true false null undefined".split())


def reaching_sets(g: Graph, made: list[tuple[str, int]]) -> list[set[int]]:
    """Definitions ``(name, block)`` alive at the end of each block: those that come in, less those written anew, and its own last ones.

    Sets only grow, so the rounds end; a block is looked at again only when one before it changed.
    """
    own: list[dict[str, int]] = [{} for _ in g.blocks]
    for i, (name, block) in enumerate(made):
        own[block][name] = i  # the last one of a name in a block
    preds = g.predecessors()
    out: list[set[int]] = [set() for _ in g.blocks]
    todo = list(range(len(g.blocks)))
    while todo:
        b = todo.pop(0)
        came = set().union(*(out[p] for p in preds[b])) if preds[b] else set()
        new = {i for i in came if made[i][0] not in own[b]} | set(own[b].values())
        if new != out[b]:
            out[b] = new
            todo += [s for s, _ in g.blocks[b].successors if s not in todo]
    return out


def def_use(code: str, params: tuple[str, ...] = ()) -> DefUse:
    """Definitions and uses of the names of one function's code, strings and comments blanked. Parameters are defined at its start."""
    g = build(code)

    def block_of(at: int) -> int:
        return max((b for b in g.blocks if b.start <= at <= b.end), key=lambda b: (b.start, -b.end), default=g.blocks[0]).id

    definitions = [(p, -1, 0) for p in params] + [(m.group(1), m.start(1), block_of(m.start(1))) for m in WRITTEN.finditer(code) if m.group(1) not in RESERVED]
    written = {at for _, at, _ in definitions}
    uses = [(m.group(), m.start(), block_of(m.start())) for m in READ.finditer(code) if m.group() not in RESERVED and m.start() not in written]
    alive = reaching_sets(g, [(name, block) for name, _, block in definitions])
    ends = [min((x for x in (code.find(";", d), code.find("\n", d)) if x >= 0), default=len(code)) if d >= 0 else -1 for _, d, _ in definitions]  # a value is read before it is written
    preds = g.predecessors()
    entering = [set().union(*(alive[p] for p in preds[b.id])) if preds[b.id] else set() for b in g.blocks]
    reaching = []
    for name, at, block in uses:
        before = [i for i, (n, d, b) in enumerate(definitions) if n == name and b == block and ends[i] < at]
        reaching.append([before[-1]] if before else sorted(i for i in entering[block] if definitions[i][0] == name))
    return DefUse(definitions, uses, reaching)
