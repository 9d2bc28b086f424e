"""Texts that say what a table was made of: code, parameters, inputs.

A table is stale if the text it was stored with differs from the one it would get now. The text follows
a function into the functions of this package it calls, and takes in the values of the parameters and constants they read, so
that a changed threshold makes its readers stale, and what is built from them, but nothing else.
"""

from __future__ import annotations

import hashlib
from types import CodeType, FunctionType

from panelscope import config

PACKAGE = __name__.split(".")[0]
PLAIN = (int, float, str, bytes, bool, tuple, frozenset, dict, list, type(None))


def digest(*parts: str) -> str:
    return hashlib.md5("\0".join(parts).encode()).hexdigest()


def _codes(code: CodeType):
    """A function's code and that of the functions inside it."""
    yield code
    for constant in code.co_consts:
        if isinstance(constant, CodeType):
            yield from _codes(constant)


def of_function(function: FunctionType) -> str:
    """What a function does, as far as this package says."""
    parts: dict[str, str] = {}
    todo = [function]
    while todo:
        one = todo.pop()
        name = f"{one.__module__}.{one.__qualname__}"
        if name in parts:
            continue
        text = [repr(one.__defaults__), repr(one.__kwdefaults__)]
        for cell in one.__closure__ or ():
            if isinstance(cell.cell_contents, PLAIN):
                text.append(repr(cell.cell_contents))
        for code in _codes(one.__code__):
            constants = [c for c in code.co_consts if not isinstance(c, CodeType)]
            text += [code.co_code.hex(), repr(constants), repr(code.co_names), repr(code.co_varnames)]
            for used in code.co_names:
                if used.isupper() and hasattr(config, used):
                    parts[f"config.{used}"] = repr(getattr(config, used))
                value = one.__globals__.get(used)
                if isinstance(value, FunctionType) and value.__module__.startswith(PACKAGE):
                    todo.append(value)
                elif isinstance(value, PLAIN):
                    parts[f"{one.__module__}.{used}"] = repr(value)
        parts[name] = digest(*text)
    return digest(*[f"{k}={v}" for k, v in sorted(parts.items())])
