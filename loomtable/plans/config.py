"""Configuration: TOML or JSON, from a file, a string or a dict, with named assets and references to them."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any


def load(source: str | dict | Path) -> dict:
    """A dict; a path ending in .toml or .json; or such text itself."""
    if isinstance(source, dict):
        return source
    text = Path(source).read_text() if str(source).endswith((".toml", ".json")) else str(source)
    return json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)


def merged(base: Any, over: Any) -> Any:
    """Deep merge of dicts; anything else is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: merged(base.get(k), v) for k, v in over.items()}
    return over


def resolved(value: Any, assets: dict[str, Any], seen: tuple[str, ...] = ()) -> Any:
    """``{resolve = "name", ...}`` replaced by the asset of that name, other keys merged over it, at any depth."""
    if isinstance(value, list):
        return [resolved(v, assets, seen) for v in value]
    if isinstance(value, dict):
        if "resolve" in value:
            name = value["resolve"]
            if name in seen or name not in assets:
                raise ValueError(f"{'circular' if name in seen else 'unknown'} reference {name!r}")
            rest = {k: v for k, v in value.items() if k != "resolve"}
            return resolved(merged(assets[name], rest) if rest else assets[name], assets, (*seen, name))
        return {k: resolved(v, assets, seen) for k, v in value.items()}
    return value


def assets_of(config: dict) -> dict[str, Any]:
    """Assets by name, from ``[[assets]]`` with a ``name`` each."""
    return {a["name"]: {k: v for k, v in a.items() if k != "name"} for a in config.get("assets", [])}


def steps_of(config: dict, assets: dict[str, Any] | None = None) -> list[dict]:
    """The ``[[step]]`` list with references resolved."""
    every = assets_of(config) | (assets or {})
    steps = resolved(config.get("step", []), every)
    for s in steps:
        if "step" not in s and "split" not in s:
            raise ValueError(f"a step needs a name: {s}")
    return steps
