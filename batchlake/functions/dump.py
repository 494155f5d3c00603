"""Values as readable literals."""

from __future__ import annotations

from typing import Any


def literal(value: Any) -> str:
    """A string in quotes, a row or mapping in braces, a list in brackets, anything else as it is."""
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return table(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value)


def table(values: dict, newline: bool = False, sort: bool = False) -> str:
    """`{key = value, ...}`, an entry a line if newline; keys that are no plain names stand in brackets."""
    entries = sorted(values.items(), key=lambda kv: str(kv[0])) if sort else values.items()
    name = lambda k: k if isinstance(k, str) and k.isidentifier() else f"[{literal(k)}]"
    return "{" + (",\n " if newline else ", ").join(f"{name(k)} = {literal(v)}" for k, v in entries) + "}"
