"""PMML tree models and derived fields as documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from typing import Any

#: PMML names and those of the library.
TYPES = {"double": "double", "float": "float", "integer": "int", "string": "string", "boolean": "boolean"}
OPERATORS = {"lessThan": "<", "lessOrEqual": "<=", "greaterThan": ">", "greaterOrEqual": ">=", "equal": "==", "notEqual": "!="}
APPLY = {
    "+": "+", "-": "-", "*": "*", "/": "/", "min": "min", "max": "max", "sqrt": "m.sqrt", "abs": "m.abs", "exp": "m.exp", "ln": "m.ln", "log10": "m.log10",
    "pow": "**", "floor": "m.floor", "ceil": "m.ceil", "round": "m.round", "uppercase": "s.upper", "lowercase": "s.lower", "concat": "s.concat",
    "equal": "==", "notEqual": "!=", "lessThan": "<", "lessOrEqual": "<=", "greaterThan": ">", "greaterOrEqual": ">=", "and": "&&", "or": "||", "not": "!",
}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if _local(c) == name]


def _expression(e: ET.Element, symbol: Any) -> Any:
    kind = _local(e)
    if kind == "Constant":
        text, data = e.text or "", e.get("dataType", "double")
        return {"string": text} if data == "string" else int(text) if data == "integer" else float(text)
    if kind == "FieldRef":
        return symbol(e.get("field"))
    if kind == "Apply":
        name, args = e.get("function"), [_expression(c, symbol) for c in e if _local(c) != "Extension"]
        if name == "if":
            return {"if": args[0], "then": args[1], "else": args[2]}
        if name not in APPLY:
            raise NotImplementedError(f"function {name}")
        out = args[0] if len(args) > 1 else {APPLY[name]: args}
        for a in args[1:]:
            out = {APPLY[name]: [out, a]}
        return out
    raise NotImplementedError(kind)


def _predicate(e: ET.Element, symbol: Any, kinds: dict[str, str]) -> Any:
    kind = _local(e)
    if kind in ("True", "False"):
        return kind == "True"
    if kind == "SimplePredicate":
        field, value = e.get("field"), e.get("value")
        literal = {"string": value} if kinds.get(field) == "string" else float(value)
        return {OPERATORS[e.get("operator")]: [symbol(field), literal]}
    if kind == "CompoundPredicate":
        parts = [_predicate(c, symbol, kinds) for c in e]
        name = {"and": "&&", "or": "||", "xor": "^^"}[e.get("booleanOperator")]
        out = parts[0]
        for p in parts[1:]:
            out = {name: [out, p]}
        return out
    raise NotImplementedError(kind)


def from_pmml(text: str) -> dict[str, Any]:
    """The document of a PMML file with one tree model; derived fields become variables."""
    root = ET.fromstring(text)
    kinds = {f.get("name"): TYPES[f.get("dataType")] for f in _all(root, "DataField")}
    trees = _all(root, "TreeModel")
    if len(trees) != 1:
        raise NotImplementedError("one TreeModel is expected")
    tree = trees[0]
    target = {f.get("name") for f in _all(tree, "MiningField") if f.get("usageType") in ("predicted", "target")}
    fields = [n for n in kinds if n not in target]
    derived = {f.get("name"): f for f in _all(root, "DerivedField")}
    symbol = lambda n: n if n in derived else f"input.{n}"
    steps: list[Any] = [{"let": {n: _expression(next(c for c in f if _local(c) != "Extension"), symbol)}} for n, f in derived.items()]
    kinds.update({n: TYPES[f.get("dataType", "double")] for n, f in derived.items()})
    words = tree.get("functionName") == "classification"

    def node(e: ET.Element) -> Any:
        children = [c for c in e if _local(c) == "Node"]
        score = e.get("score")
        out: Any = None if score is None else {"string": score} if words else float(score)
        for c in reversed(children):
            test = _predicate(next(p for p in c if _local(p) in ("True", "False", "SimplePredicate", "CompoundPredicate")), symbol, kinds)
            if test is True:
                out = node(c)
            elif test is not False:
                out = {"if": test, "then": node(c), "else": out} if out is not None else {"if": test, "then": node(c), "else": {"error": "no score"}}
        return out

    top = next(c for c in tree if _local(c) == "Node")
    return {"input": {"type": "record", "name": "Input", "fields": [{"name": n, "type": kinds[n]} for n in fields]}, "output": "string" if words else "double", "action": [*steps, node(top)]}
