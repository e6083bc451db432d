"""The function library: one registry of lowerings to Column expressions."""

from . import collections, distributions, models, numeric, scalar  # noqa: F401
from .registry import LIBRARY, Const

__all__ = ["LIBRARY", "Const"]
