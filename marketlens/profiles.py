"""Environment profiles: where raw, curated and output data lie, without addresses in code."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any


def parsed(text: str) -> dict[str, Any]:
    """Nested mappings of scalars, as profiles have them: ``key: value`` lines, deeper ones indented by spaces."""
    root: dict[str, Any] = {}
    open_ = [(-1, root)]
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip(" "))
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not a profile line: {line}")
        while open_[-1][0] >= depth:
            open_.pop()
        value = value.strip()
        if value:
            open_[-1][1][key] = scalar(value)
        else:
            open_[-1][1][key] = {}
            open_.append((depth, open_[-1][1][key]))
    return root


def scalar(value: str) -> Any:
    if value[0] in "\"'" and value[-1] == value[0]:
        return value[1:-1]
    named = {"true": True, "false": False, "null": None, "~": None}
    if value.lower() in named:
        return named[value.lower()]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def load_profile(folder: str, name: str | None = None) -> dict[str, Any]:
    """The profile ``name`` (by default of the variable APP_ENV, else ``local``) in ``folder``; ValueError if it declares
    another environment."""
    name = name or os.environ.get("APP_ENV", "local")
    path = Path(folder) / f"{name}.yml"
    if not path.is_file():
        raise FileNotFoundError(f"no profile {path}")
    profile = parsed(path.read_text(encoding="utf-8"))
    if profile.get("environment") != name:
        raise ValueError(f"{path} declares environment {profile.get('environment')!r}")
    return profile


def setting(profile: dict[str, Any], dotted: str) -> Any:
    """One scalar by its dotted name; KeyError where there is none, ValueError for a section."""
    value: Any = profile
    for key in dotted.split("."):
        if not isinstance(value, dict) or key not in value:
            raise KeyError(dotted)
        value = value[key]
    if isinstance(value, dict):
        raise ValueError(f"{dotted} is a section")
    return value
