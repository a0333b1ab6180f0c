"""Layered configuration: defaults, overrides, profile; nested tables merge, lists are replaced whole."""

from __future__ import annotations

import json
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that must not be run with."""


def deep_merge(base: dict, override: dict) -> dict:
    """``base`` with the values of ``override``; only dicts merge into dicts."""
    out = dict(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def read_layer(path: str | Path) -> dict:
    """One layer from JSON, or YAML where a reader is installed; a missing file is an empty layer."""
    path = Path(path)
    if not path.exists():
        return {}
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        layer = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise ConfigError(f"{path}: no YAML reader is installed; use JSON") from error
        layer = yaml.safe_load(text) or {}
    if not isinstance(layer, dict):
        raise ConfigError(f"{path}: a layer must be a table")
    return layer


def load(*paths: str | Path, inline: dict | None = None) -> dict:
    """Layers from weakest to strongest, then inline values."""
    out: dict = {}
    for path in paths:
        out = deep_merge(out, read_layer(path))
    return deep_merge(out, inline or {})


def validate(config: dict, schema: dict, at: str = "") -> None:
    """Refuse unknown keys, wrong types and values out of range.

    ``schema`` maps a key to a nested schema, a type, a (low, high) range or a set of choices.
    """
    for key, value in config.items():
        where = f"{at}{key}"
        if key not in schema:
            raise ConfigError(f"unknown setting {where}")
        rule = schema[key]
        if isinstance(rule, dict):
            if not isinstance(value, dict):
                raise ConfigError(f"{where} must be a table")
            validate(value, rule, f"{where}.")
        elif isinstance(rule, set):
            if value not in rule:
                raise ConfigError(f"{where} must be one of {sorted(map(str, rule))}")
        elif isinstance(rule, tuple):
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not rule[0] <= value <= rule[1]:
                raise ConfigError(f"{where} must be between {rule[0]} and {rule[1]}")
        elif not isinstance(value, rule) or (rule is int and isinstance(value, bool)):
            raise ConfigError(f"{where} must be {rule.__name__}")
