"""Digests of everything that decides an output: the plan, the code, the values, the vocabulary.

Column renderers are in the plan, with every pattern and literal they use. Python renderers show
only their name there, so their source, what they close over and the module values and functions
they name are taken as well. Numbers that Spark gives to columns, and that change from one build
to the next, are left out.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
from collections.abc import Callable, Iterable
from types import BuiltinFunctionType, FunctionType, ModuleType
from typing import Any

from pyspark.sql import DataFrame

NUMBERS = re.compile(r"(?:_\d+)?#\d+L?")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plan_print(df: DataFrame) -> str:
    """A digest of the analyzed plan: tables by their schema, expressions with their literals."""
    conf, whole = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(whole)
    conf.set(whole, str(2**31 - 1))  # long lists of columns are part of the plan
    try:
        text = df._jdf.queryExecution().analyzed().toString()
    finally:
        conf.set(whole, before)
    return digest(NUMBERS.sub("#", text))


def _value(value: Any, seen: set[int]) -> str:
    """A value that a function uses, as text that does not depend on where it is in memory."""
    if isinstance(value, FunctionType):
        return function_print(value, seen)
    if isinstance(value, re.Pattern):
        return f"{value.pattern!r}/{value.flags}"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_value(k, seen)}:{_value(v, seen)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_value(v, seen) for v in value) + "]"
    if isinstance(value, (set, frozenset)):
        return "{" + ",".join(sorted(_value(v, seen) for v in value)) + "}"
    if value is None or isinstance(value, (str, bytes, int, float, bool)):
        return repr(value)
    return f"<{type(value).__module__}.{type(value).__qualname__} {getattr(value, '__qualname__', '')}>"


def _names(code: Any) -> set[str]:
    """Names a function's code and the functions inside it look up."""
    return set(code.co_names).union(*[_names(c) for c in code.co_consts if inspect.iscode(c)])


def function_print(fn: Callable, seen: set[int] | None = None) -> str:
    """A function's source, closed-over values, defaults, and the module values and functions of
    its own package that it names, however deep."""
    seen = set() if seen is None else seen
    fn = getattr(fn, "func", fn)  # a Python UDF keeps its function there
    if not isinstance(fn, FunctionType) or id(fn) in seen:
        return f"<{getattr(fn, '__qualname__', type(fn).__qualname__)}>"
    seen.add(id(fn))
    try:
        source = inspect.getsource(fn)
    except (OSError, TypeError):
        source = repr((fn.__code__.co_code, [c for c in fn.__code__.co_consts if not inspect.iscode(c)]))
    parts = [source, _value(fn.__defaults__, seen), _value(fn.__kwdefaults__, seen)]
    parts += [_value(cell.cell_contents, seen) for cell in fn.__closure__ or ()]
    package = (fn.__module__ or "").split(".")[0]
    for name in sorted(_names(fn.__code__) & fn.__globals__.keys()):
        value = fn.__globals__[name]
        if isinstance(value, ModuleType):  # its values are reached by attribute: those that are named
            if value.__name__.split(".")[0] == package:
                used = sorted(_names(fn.__code__) & vars(value).keys())
                parts += [f"{name}.{k}={_value(vars(value)[k], seen)}" for k in used if not isinstance(vars(value)[k], ModuleType)]
        elif isinstance(value, FunctionType) and (value.__module__ or "").split(".")[0] != package:
            parts.append(f"{name}=<{value.__module__}.{value.__qualname__}>")
        elif not isinstance(value, BuiltinFunctionType):
            parts.append(f"{name}={_value(value, seen)}")
    return digest("\n".join(parts))


def fingerprint(config: dict, plan: DataFrame | None = None, code: Iterable[Callable] = (),
                vocabulary: Iterable[tuple[str, str]] = ()) -> str:
    """Twelve digits that change with anything that decides the output."""
    parts = {"config": config, "plan": plan_print(plan) if plan is not None else None,
             "code": [function_print(f) for f in code], "vocabulary": digest(json.dumps([list(p) for p in vocabulary]))}
    return digest(json.dumps(parts, sort_keys=True))[:12]
