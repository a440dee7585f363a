"""Settings in layers: defaults, a YAML or JSON file, environment variables, arguments, the session.

Later layers win. Names are dotted paths (``budget.grpo``); a value from the outside is read as the
type of the default that it replaces."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import SparkSession


def flat(tree: Mapping[str, Any], above: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted name, value) of the leaves of nested mappings."""
    for k, v in tree.items():
        if isinstance(v, Mapping):
            yield from flat(v, f"{above}{k}.")
        else:
            yield f"{above}{k}", v


def read_file(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:  # an optional library
        raise ValueError(f"{path}: YAML needs the yaml library; JSON is always read") from e
    return yaml.safe_load(text) or {}


def _as(kind: Any, name: str, raw: str) -> Any:
    """Outside text as the type of a default; lists are split at commas."""
    try:
        if isinstance(kind, bool):
            return {"1": True, "true": True, "on": True, "yes": True, "0": False, "false": False, "off": False, "no": False}[raw.lower()]
        if isinstance(kind, (int, float)):
            return type(kind)(raw)
    except (KeyError, ValueError) as e:
        raise ValueError(f"{name}: {raw!r} is no {type(kind).__name__}") from e
    return [x for x in raw.split(",") if x] if isinstance(kind, list) else raw


def settings(defaults: Mapping[str, Any], file: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "PAIRGAUGE_", arguments: Sequence[str] = (), spark: SparkSession | None = None) -> dict[str, Any]:
    """Flat settings. ``a.b`` is also PAIRGAUGE_A_B, ``--a.b value`` or ``--a.b=value``, and pairgauge.a.b in the session.

    Arguments that name no setting, or have no value, are errors; a file may add names."""
    out = dict(flat(defaults))
    known = dict(out)
    if file:
        out |= dict(flat(read_file(file)))
    for name, kind in known.items():
        raw = (environment or {}).get(prefix + name.upper().replace(".", "_"))
        if raw is not None:
            out[name] = _as(kind, name, raw)
    rest = list(arguments)
    while rest:
        word = rest.pop(0)
        name, eq, raw = word.removeprefix("--").partition("=")
        if not word.startswith("--") or name not in known:
            raise ValueError(f"{word} is no setting")
        if not eq:
            if not rest or rest[0].startswith("--"):
                raise ValueError(f"{word} needs a value")
            raw = rest.pop(0)
        out[name] = _as(known[name], name, raw)
    if spark is not None:
        for name, kind in known.items():
            raw = spark.conf.get(f"pairgauge.{name}", None)
            if raw is not None:
                out[name] = _as(kind, name, raw)
    return out
