"""Configuration: defaults, deep merge, dotted paths, and checks of parameters. Plain Python, on the driver."""

from __future__ import annotations

import copy
import json
from typing import Any

DEFAULTS: dict[str, Any] = {
    "search": {"limit": 5, "least": 0.3, "scope": "all"},
    "index": {"enabled": True, "exclude": [], "most_bytes": 1 << 20, "timeout": 60, "tests": False},
    "rules": {"enabled": True, "rules": []},
    "cache": {"hours": 24},
    "sensitive": {"allow": [], "custom": [], "off": []},
    "permissions": {"read_only": True, "never": [], "extra": [], "categories": ["core", "memory"]},
}
LIMITS = {"limit": (0, None), "least": (0.0, 1.0), "complexity": (1, 10), "most_depth": (1, None)}


def merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``: dictionaries are merged, anything else (lists too) is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def get(config: dict, path: str, default: Any = None) -> Any:
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def coerce(text: Any) -> Any:
    """true, false, numbers and JSON from text; other text stays."""
    if not isinstance(text, str):
        return text
    try:
        return json.loads(text)
    except ValueError:
        return text


def put(config: dict, path: str, value: Any) -> dict:
    out = copy.deepcopy(config)
    *way, last = path.split(".")
    at = out
    for part in way:
        at = at.setdefault(part, {})
    at[last] = coerce(value)
    return out


def flatten(config: dict, prefix: str = "") -> list[tuple[str, str, str]]:
    """(key, value, type) rows."""
    rows = []
    for k, v in config.items():
        name = f"{prefix}{k}"
        rows += flatten(v, name + ".") if isinstance(v, dict) and v else [(name, json.dumps(v), type(v).__name__)]
    return rows


def problems(values: dict[str, Any], enums: dict[str, list[str]] | None = None) -> list[dict[str, str]]:
    """What is wrong with parameters: [{path, message}]."""
    out = []
    for k, v in values.items():
        if v is None:
            continue
        if enums and k in enums and v not in enums[k]:
            out.append({"path": k, "message": f"must be one of {', '.join(enums[k])}"})
        if k in LIMITS:
            lo, hi = LIMITS[k]
            if not isinstance(v, int | float) or isinstance(v, bool):
                out.append({"path": k, "message": "must be a number"})
            elif v < lo or (hi is not None and v > hi):
                out.append({"path": k, "message": f"must be from {lo}" + (f" to {hi}" if hi is not None else "")})
    return out
