"""Metadata as TOML text."""

from __future__ import annotations

import json
import tomllib
from typing import Any

from wordloom.errors import FormatError


def parse(text: str) -> dict[str, Any]:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise FormatError(f"the metadata is no TOML: {error}") from error


def _value(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(value) if value == value and abs(value) != float("inf") else str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(value, list):
        return "[" + ", ".join(map(_value, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_key(k)} = {_value(v)}" for k, v in value.items()) + "}"
    return str(value)


def _key(key: str) -> str:
    return key if key and all(c.isascii() and (c.isalnum() or c in "-_") for c in key) else json.dumps(key, ensure_ascii=False)


def dump(table: dict[str, Any], path: tuple[str, ...] = ()) -> str:
    """TOML text of nested dicts: plain values first, then a table for each dict."""
    lines = [f"{_key(k)} = {_value(v)}" for k, v in table.items() if not isinstance(v, dict)]
    head = [f"[{'.'.join(map(_key, path))}]"] if path and (lines or not table) else []
    parts = ["\n".join(head + lines)] if head or lines else []
    parts += [dump(v, (*path, k)).rstrip("\n") for k, v in table.items() if isinstance(v, dict)]
    return "\n\n".join(parts) + "\n" if parts else ""
