"""Settings as nested dictionaries with `${a.b}` references, sections of machines, and overrides."""

from __future__ import annotations

import copy
import json
import os
import re
from datetime import datetime
from typing import Any

from plumeline.operators.grid import Grid


def lookup(settings: dict, path: str) -> Any:
    out: Any = settings
    for key in path.split("."):
        out = out[key]
    return out


def resolved(settings: dict, machine: str | None = None, **overrides: Any) -> dict:
    """Settings with references replaced; `machine` names the section that `machine` refers to; overrides that are None count as not given."""
    out = copy.deepcopy(settings)
    if machine is not None:
        out["machine"] = copy.deepcopy(out[machine])
    for path, value in overrides.items():
        if value is not None:
            *sections, last = path.replace("__", ".").split(".")
            at = out
            for s in sections:
                at = at.setdefault(s, {})
            at[last] = value
    return replaced(out, out, ())


def replaced(value: Any, settings: dict, path: tuple[str, ...]) -> Any:
    if isinstance(value, dict):
        return {k: replaced(v, settings, path) for k, v in value.items()}
    if isinstance(value, list):
        return [replaced(v, settings, path) for v in value]
    if not isinstance(value, str):
        return value
    made = re.fullmatch(r"\$\{(ts|Grid|env):([^{}]+)\}", value)
    if made:
        return RESOLVERS[made[1]](made[2].strip(), settings)
    whole = re.fullmatch(r"\$\{([\w.]+)\}", value)
    if whole:
        if whole[1] in path:
            raise ValueError(f"references in a circle: {' '.join([*path, whole[1]])}")
        return replaced(lookup(settings, whole[1]), settings, (*path, whole[1]))
    return re.sub(r"\$\{([\w.]+)\}", lambda m: str(replaced("${" + m[1] + "}", settings, path)), value)


#: What `${name:text}` stands for: a time, a grid of a section's keys, a variable of the environment.
RESOLVERS = {
    "ts": lambda text, settings: datetime.fromisoformat(text),
    "Grid": lambda text, settings: Grid.of(**replaced(lookup(settings, text), settings, ())),
    "env": lambda text, settings: os.environ[text],
}


def read(path: str, machine: str | None = None, **overrides: Any) -> dict:
    """Settings of a JSON file, or of a YAML file where there is a library for it."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return resolved(yaml.safe_load(f), machine, **overrides)
        return resolved(json.load(f), machine, **overrides)


def write(settings: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2, sort_keys=True)
