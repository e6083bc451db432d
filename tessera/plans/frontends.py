"""Other ways to write and look at documents: Python expressions, infix text, JSON tools, schema text."""

from __future__ import annotations

import ast
import copy
import json
from collections.abc import Callable, Iterator
from typing import Any

#: Python operators and the functions that they name.
BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^"}
COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
UNARY = {ast.USub: "u-", ast.Not: "!", ast.Invert: "~"}


def from_python(source: str, symbols: dict[str, Any] | None = None) -> Any:
    """A Python expression as a document expression; names in `symbols` are replaced."""
    return _lower(ast.parse(source.strip(), mode="eval").body, symbols or {})


def program(source: str, symbols: dict[str, Any] | None = None) -> list:
    """Lines of assignments, if/else, for loops, while loops and expressions as a list of steps."""
    return _steps(ast.parse(source).body, symbols or {}, set())


def _steps(body: list[ast.stmt], names: dict[str, Any], known: set[str]) -> list:
    out: list[Any] = []
    for s in body:
        if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Name):
            name = s.targets[0].id
            out.append({"set" if name in known else "let": {name: _lower(s.value, names)}})
            known.add(name)
        elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
            out.append({"set": {s.target.id: {BINARY[type(s.op)]: [s.target.id, _lower(s.value, names)]}}})
        elif isinstance(s, ast.If):
            step = {"if": _lower(s.test, names), "then": _steps(s.body, names, set(known))}
            if s.orelse:
                step["else"] = _steps(s.orelse, names, set(known))
            out.append(step)
        elif isinstance(s, ast.While):
            out.append({"while": _lower(s.test, names), "do": _steps(s.body, names, set(known))})
        elif isinstance(s, ast.For) and isinstance(s.target, ast.Name):
            out.append({"foreach": s.target.id, "in": _lower(s.iter, names), "do": _steps(s.body, names, {*known, s.target.id}), "seq": True})
        elif isinstance(s, (ast.Expr, ast.Return)):
            out.append(_lower(s.value, names))
        else:
            raise SyntaxError(f"line {s.lineno}: not part of the language")
    return out


def _dotted(e: ast.expr) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute) and (head := _dotted(e.value)):
        return f"{head}.{e.attr}"
    return None


def _lower(e: ast.expr, names: dict[str, Any]) -> Any:
    if isinstance(e, ast.Constant):
        return {"string": e.value} if isinstance(e.value, str) else e.value
    if isinstance(e, ast.Name):
        return names.get(e.id, e.id)
    if isinstance(e, ast.BinOp):
        return {BINARY[type(e.op)]: [_lower(e.left, names), _lower(e.right, names)]}
    if isinstance(e, ast.UnaryOp):
        return _lower(e.operand, names) if isinstance(e.op, ast.UAdd) else {UNARY[type(e.op)]: [_lower(e.operand, names)]}
    if isinstance(e, ast.BoolOp):
        out = _lower(e.values[0], names)
        for v in e.values[1:]:
            out = {"&&" if isinstance(e.op, ast.And) else "||": [out, _lower(v, names)]}
        return out
    if isinstance(e, ast.Compare):
        parts, left = [], e.left
        for op, right in zip(e.ops, e.comparators, strict=True):
            parts.append({COMPARE[type(op)]: [_lower(left, names), _lower(right, names)]})
            left = right
        out = parts[0]
        for p in parts[1:]:
            out = {"&&": [out, p]}
        return out
    if isinstance(e, ast.IfExp):
        return {"if": _lower(e.test, names), "then": _lower(e.body, names), "else": _lower(e.orelse, names)}
    if isinstance(e, ast.Call):
        name = _dotted(e.func)
        if name is None:
            raise SyntaxError("only named functions can be called")
        return {name: [_lower(a, names) for a in e.args]}
    if isinstance(e, ast.Lambda):
        raise SyntaxError("a function needs types: use {params, ret, do}")
    if isinstance(e, ast.Attribute):
        return {"attr": _lower(e.value, names), "path": [[e.attr]]}
    if isinstance(e, ast.Subscript):
        return {"attr": _lower(e.value, names), "path": [_lower(e.slice, names)]}
    if isinstance(e, ast.List):
        return {"new": [_lower(v, names) for v in e.elts], "type": {"type": "array", "items": "double"}}
    if isinstance(e, ast.Dict):
        return {"new": {k.value: _lower(v, names) for k, v in zip(e.keys, e.values, strict=True)}, "type": {"type": "map", "values": "double"}}
    raise SyntaxError(f"{type(e).__name__} isn't part of the language")


def walk(document: Any, path: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    """All (path, value) pairs of a document, parents first."""
    yield path, document
    if isinstance(document, (dict, list)):
        for k, v in document.items() if isinstance(document, dict) else enumerate(document):
            yield from walk(v, (*path, k))


def search(document: Any, test: Callable[[Any], bool]) -> list[tuple]:
    return [p for p, v in walk(document) if test(v)]


def get(document: Any, path: tuple) -> Any:
    for k in path:
        document = document[k]
    return document


def assign(document: Any, path: tuple, value: Any) -> Any:
    """A copy of the document with one place changed."""
    if not path:
        return value
    out = copy.copy(document)
    out[path[0]] = assign(document[path[0]], path[1:], value)
    return out


def remove(document: Any, path: tuple) -> Any:
    out = copy.deepcopy(document)
    del get(out, path[:-1])[path[-1]]
    return out


def called(document: dict) -> set[str]:
    """Names of the functions that a document calls."""
    from ..functions import LIBRARY

    return {k for _, v in walk(document) if isinstance(v, dict) for k in v if k in LIBRARY or k.startswith("u.")}


def call_graph(document: dict) -> dict[str, set[str]]:
    return {"(action)": called({"action": document["action"]}), **{f"u.{n}": called(f) for n, f in document.get("fcns", {}).items()}}


def is_recursive(document: dict, name: str) -> bool:
    graph, seen, todo = call_graph(document), set(), [name]
    while todo:
        for f in graph.get(todo.pop(), ()):
            if f == name:
                return True
            if f not in seen:
                seen.add(f)
                todo.append(f)
    return False


def pretty(schema: Any, indent: int = 0) -> str:
    """A schema as short text."""
    if isinstance(schema, str):
        return schema
    if isinstance(schema, list):
        return "union(" + ", ".join(pretty(s, indent) for s in schema) + ")"
    kind, pad = schema["type"], "  " * (indent + 1)
    if kind == "record":
        return f"record({schema['name']},\n" + ",\n".join(f"{pad}{f['name']}: {pretty(f['type'], indent + 1)}" for f in schema["fields"]) + ")"
    if kind == "enum":
        return f"enum({schema['name']}: {', '.join(schema['symbols'])})"
    if kind in ("array", "map"):
        return f"{kind}({pretty(schema['items' if kind == 'array' else 'values'], indent)})"
    if kind == "fixed":
        return f"fixed({schema['name']}, {schema['size']})"
    return pretty(kind, indent)


def describe(document: dict) -> str:
    """What a document takes, gives and uses."""
    return json.dumps({"method": document.get("method", "map"), "input": pretty(document["input"]), "output": pretty(document["output"]), "cells": sorted(document.get("cells", {})), "pools": sorted(document.get("pools", {})), "calls": sorted(called(document))}, indent=1)
