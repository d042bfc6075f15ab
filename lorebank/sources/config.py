"""Settings from a file, looked up by dotted names."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def load(path: str) -> dict[str, Any]:
    """The settings of a JSON file, or of a YAML file where a reader for it is installed; none if the file is not there or empty."""
    at = Path(path)
    if not at.exists():
        return {}
    text = at.read_text(encoding="utf-8")
    if at.suffix == ".json":
        return json.loads(text or "{}")
    import yaml

    return yaml.safe_load(text) or {}


def lookup(settings: dict[str, Any], name: str | None = None, default: Any = None) -> Any:
    """The setting ``a.b.c``, or the default where any part is missing or null; without a name all settings."""
    value: Any = settings
    for part in name.split(".") if name else ():
        if not isinstance(value, dict) or part not in value:
            return default
        value = value[part]
    return default if value is None else value
