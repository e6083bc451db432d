"""The function library as lowerings to Column expressions.

A lowering takes Columns (function arguments come as Python callables over Columns, constant models as Const) and
returns a Column, so whole programs stay inside Catalyst. Runtime errors are raised with `code: message`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LIBRARY: dict[str, Callable[..., Column]] = {}


@dataclass
class Const:
    """A compile-time constant: its Python value, and how it looks as a Column."""

    value: Any
    make: Callable[[], Column] | None = None

    @property
    def column(self) -> Column:
        return self.make() if self.make else F.lit(self.value)


def define(**functions: Callable[..., Column]) -> None:
    LIBRARY.update(functions)


def define_all(prefix: str, functions: dict[str, Callable[..., Column]]) -> None:
    LIBRARY.update({prefix + name: f for name, f in functions.items()})


def fail(code: int, message: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {message}"))


def guard(bad: Column, code: int, message: str, value: Column) -> Column:
    """value, or a runtime error where `bad` holds; the value isn't evaluated there."""
    return F.when(bad, fail(code, message)).otherwise(value)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def d(x) -> Column:
    return (x.column if isinstance(x, Const) else x).cast("double")


def i(x: Column) -> Column:
    return x.cast("int")


def lam(f: Callable, n: int) -> Callable:
    """A callable with exactly n positional parameters, as higher-order functions want."""
    return {1: lambda a: f(a), 2: lambda a, b: f(a, b), 3: lambda a, b, c: f(a, b, c)}[n]


def trait(x, name: str):
    """What the compiler has noted on a Column (a plain getattr would mean a field of the column)."""
    return vars(x).get(name) if isinstance(x, Column) else None
