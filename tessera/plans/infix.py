"""A compact infix notation for documents.

Sections `name:`, `method:`, `input:`, `output:`, `zero:`, `action:`, `merge:`, `cells:`, `pools:`, `fcns:`, `types:` hold
types (`double`, `array(int)`, `map(string)`, `union(double, null)`, `record(Name, a: int, b: string)`,
`enum([A, B], Name)`), constants in JSON, or programs: statements separated by `;`, with `x = e`, `if/else`, `while`,
`foreach (x : e)`, `fcn(x: double -> double) e`, calls, field and index access, and the usual operators.
"""

from __future__ import annotations

import json
import re
from typing import Any

TOKEN = re.compile(r"""\s*(?:(//[^\n]*)|(\d+\.\d*(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*)*)|(->|&&&|\|\|\||!!!|&&|\|\||\^\^|\*\*|%%|==|!=|<=|>=|idiv|[-+*/%<>=!&|^~(){}\[\],;:.]))""", re.X)
#: Binary operators by how tightly they bind.
LEVELS = [["||", "|||"], ["^^"], ["&&", "&&&"], ["==", "!=", "<", "<=", ">", ">="], ["|"], ["^"], ["&"], ["+", "-"], ["*", "/", "%", "%%", "idiv"], ["**"]]
BINDS = {op: k for k, level in enumerate(LEVELS) for op in level}
PREFIX = {"-": "u-", "!": "!", "!!!": "!!!", "~": "~"}
SECTION = re.compile(r"^(name|method|input|output|zero|action|begin|end|merge|cells|pools|fcns|types|version|doc)\s*:", re.M)


class InfixError(ValueError):
    """Text that isn't in the notation."""


class Parser:
    def __init__(self, text: str, types: dict[str, Any] | None = None):
        self.tokens: list[tuple[str, str]] = []
        self.types = types if types is not None else {}
        at, text = 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise InfixError(f"unexpected text {text[at : at + 20]!r}")
            at = m.end()
            kind = ("comment", "number", "string", "name", "op")[m.lastindex - 1]
            if kind != "comment":
                self.tokens.append((kind, m[m.lastindex]))
        self.k = 0
        self.known: list[set[str]] = [set()]

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.k + ahead][1] if self.k + ahead < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if got is None or want is not None and got != want:
            raise InfixError(f"expected {want or 'more'} instead of {got!r}")
        self.k += 1
        return got

    def accept(self, want: str) -> bool:
        if self.peek() == want:
            self.k += 1
            return True
        return False

    def block(self) -> list:
        """`{ ... }` or one statement."""
        self.known.append(set())
        try:
            return self.statements("}") if self.accept("{") else [self.statement()]
        finally:
            self.known.pop()

    def statements(self, end: str | None = None) -> list:
        out = []
        while self.peek() is not None and self.peek() != end:
            if not self.accept(";"):
                out.append(self.statement())
        if end:
            self.take(end)
        return out

    def statement(self) -> Any:
        word = self.peek()
        if word == "while":
            self.take()
            self.take("(")
            test = self.expression()
            self.take(")")
            return {"while": test, "do": self.block()}
        if word == "foreach":
            self.take()
            self.take("(")
            name = self.take()
            self.take(":")
            over = self.expression()
            self.take(")")
            return {"foreach": name, "in": over, "do": self.block(), "seq": True}
        if self.tokens[self.k][0] == "name" and self.peek(1) == "=":
            name = self.take()
            self.take("=")
            value = self.expression()
            old = any(name in s for s in self.known)
            self.known[-1].add(name)
            return {"set" if old else "let": {name: value}}
        return self.expression()

    def expression(self, level: int = 0) -> Any:
        if level == len(LEVELS):
            return self.prefix()
        left = self.expression(level + 1)
        while self.peek() in LEVELS[level] and self.tokens[self.k][0] in ("op", "name"):
            op = self.take()
            right = self.expression(level if op == "**" else level + 1)
            left = {"//" if op == "idiv" else op: [left, right]}
        return left

    def prefix(self) -> Any:
        if self.peek() in PREFIX and self.tokens[self.k][0] == "op":
            return {PREFIX[self.take()]: [self.prefix()]}
        return self.postfix(self.primary())

    def postfix(self, value: Any) -> Any:
        while self.peek() == "[":
            self.take()
            path = [self.expression()]
            while self.accept(","):
                path.append(self.expression())
            self.take("]")
            value = {"attr": value, "path": path}
        return value

    def primary(self) -> Any:
        kind, text = self.tokens[self.k] if self.k < len(self.tokens) else ("end", "")
        if kind == "number":
            self.k += 1
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "string":
            self.k += 1
            return {"string": json.loads(text) if text[0] == '"' else text[1:-1]}
        if text == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        if text == "{":
            return {"do": self.block()}
        if kind != "name":
            raise InfixError(f"unexpected {text!r}")
        self.k += 1
        if text in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text]
        if text == "if":
            self.take("(")
            test = self.expression()
            self.take(")")
            out: dict[str, Any] = {"if": test, "then": self.block()}
            if self.accept("else"):
                out["else"] = self.block()
            return out
        if text == "fcn":
            return self.function()
        if text == "new":
            return self.new()
        if self.accept("("):
            args = []
            while not self.accept(")"):
                args.append(self.expression())
                self.accept(",")
            return {text: args}
        if text in self.types.get("%cells", ()):
            return {"cell": text}
        return text

    def new(self) -> Any:
        """`new(type, e, e)` or `new(type, name: e, name: e)`."""
        self.take("(")
        kind = self.type()
        items: list[Any] = []
        named: dict[str, Any] = {}
        while not self.accept(")"):
            self.accept(",")
            if self.peek(1) == ":":
                name = self.take().strip("\"'")
                self.take(":")
                named[name] = self.expression()
            else:
                items.append(self.expression())
        return {"new": named or items, "type": kind}

    def function(self) -> dict:
        self.take("(")
        params = []
        while self.peek() != "->":
            name = self.take()
            self.take(":")
            params.append({name: self.type()})
            self.accept(",")
        self.take("->")
        ret = self.type()
        self.take(")")
        return {"params": params, "ret": ret, "do": self.block()}

    def type(self) -> Any:
        name = self.take()
        if not self.accept("("):
            return name
        if name in ("array", "map"):
            inner = self.type()
            self.take(")")
            return {"type": name, "items" if name == "array" else "values": inner}
        if name == "union":
            out = []
            while not self.accept(")"):
                out.append(self.type())
                self.accept(",")
            return out
        if name == "record":
            label, fields = self.take(), []
            while not self.accept(")"):
                self.take(",")
                field = self.take()
                self.take(":")
                fields.append({"name": field, "type": self.type()})
            return {"type": "record", "name": label, "fields": fields}
        if name == "enum":
            self.take("[")
            symbols = []
            while not self.accept("]"):
                symbols.append(self.take())
                self.accept(",")
            self.take(",")
            label = self.take()
            self.take(")")
            return {"type": "enum", "symbols": symbols, "name": label}
        raise InfixError(f"unknown type {name!r}")


def expression(text: str) -> Any:
    p = Parser(text)
    out = p.statements()
    return out[0] if len(out) == 1 else out


def document(text: str) -> dict[str, Any]:
    """A document from its sections."""
    marks = list(SECTION.finditer(text))
    parts = {m[1]: text[m.end() : n.start() if n else len(text)].strip() for m, n in zip(marks, [*marks[1:], None], strict=True)}
    out: dict[str, Any] = {}
    cells = re.findall(r"^\s*(\w+)\s*\(", parts.get("cells", ""), re.M)
    shared = {"%cells": cells}
    for name, body in parts.items():
        if name in ("name", "method", "doc"):
            out[name] = body
        elif name in ("input", "output"):
            out[name] = Parser(body, shared).type()
        elif name in ("zero", "version"):
            out[name] = json.loads(body)
        elif name in ("cells", "pools"):  # name(type) = constant, one a line
            out[name] = {}
            for line in re.split(r"\n(?=\s*\w+\s*\()", body):
                head, _, value = line.partition("=")
                label, _, kind = head.strip().partition("(")
                out[name][label.strip()] = {"type": Parser(kind.rstrip()[:-1], shared).type(), "init": json.loads(value)}
        elif name == "fcns":
            p = Parser(body, shared)
            out[name] = {}
            while p.peek() is not None:
                if not p.accept(";"):
                    label = p.take()
                    p.take("=")
                    p.take("fcn")
                    out[name][label] = p.function()
        else:
            out[name] = Parser(body, shared).statements()
    return out
