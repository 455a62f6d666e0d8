"""Settings in layers: defaults, user file, workspace file, environment, call; with the layer each value came from."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

from .. import values as V

PREFIX = "TERRAVANE_"
DEFAULTS = {
    "retrieval": {"lexical": 40, "semantic": 40, "graph_hops": 2, "graph_total": 150, "fanout": 25, "context_tokens": 6000, "weights": V.FUSION_WEIGHTS, "kind_priors": V.KIND_PRIORS},
    "index": {"max_file_bytes": V.MAX_FILE_BYTES, "include": [], "exclude": []},
    "semantic": {"top_k": 12, "threshold": 0.55, "degree": 8, "budget": 0.6},
}


def merged(base: dict, over: dict, layer: str, origins: dict[str, str], at: str = "") -> dict:
    """base with over laid on it, key by key."""
    out = dict(base)
    for key, value in over.items():
        where = f"{at}{key}"
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value, layer, origins, where + ".")
        else:
            out[key] = value
            origins[where] = layer
    return out


def from_environment(environ) -> dict:
    """PREFIX_SECTION__KEY=value; values are JSON where they parse as such."""
    out: dict = {}
    for name, text in environ.items():
        if not name.startswith(PREFIX) or "__" not in name:
            continue
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        *path, last = name[len(PREFIX) :].lower().split("__")
        node = out
        for p in path:
            node = node.setdefault(p, {})
        node[last] = value
    return out


def load(user: str | None = None, workspace: str | None = None, environ=None, call: dict | None = None) -> tuple[dict, dict[str, str]]:
    """The settings and, by dotted name, the layer of each that is not a default."""
    origins: dict[str, str] = {}
    out = DEFAULTS
    for layer, path in (("user", user), ("workspace", workspace)):
        if path and Path(path).is_file():
            out = merged(out, tomllib.loads(Path(path).read_text(encoding="utf-8")), layer, origins)
    out = merged(out, from_environment(os.environ if environ is None else environ), "environment", origins)
    return merged(out, call or {}, "call", origins), origins


def envelope(command: str, data=None, index=None, warnings=(), error: str | None = None) -> str:
    """A versioned JSON reply around rows that were collected."""
    return json.dumps({"version": 1, "ok": error is None, "command": command, "data": data, "index": index, "warnings": list(warnings), "error": error}, sort_keys=True, default=str)
