"""Options as nested mappings: merged over defaults, listed by dotted key, read and written as JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from pathlib import Path

DEFAULTS: dict = {
    "chunks": {"max_characters": 1600, "overlap": 150, "with_heading_path": True},
    "images": {"least_px": 12, "most_px": 1800},
    "publication": {"mode": "replace", "page_width": "max"},
    "language": "en",
}


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with what ``over`` says otherwise, level by level; a mapping against anything else is replaced whole."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else value
    return out


def keys(options: Mapping, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted key, value) of all options, in the order of the keys."""
    for key in sorted(options):
        value = options[key]
        if isinstance(value, Mapping) and value:
            yield from keys(value, f"{prefix}{key}.")
        else:
            yield prefix + key, value


def assigned(options: Mapping, settings: list[str]) -> dict:
    """Options after ``key.of.option=value`` settings; a value is JSON where it can be read as such, else text."""
    out = dict(options)
    for setting in settings:
        name, sign, text = setting.partition("=")
        if not sign or not name.strip():
            raise ValueError(f"not key=value: {setting}")
        try:
            value: object = json.loads(text)
        except ValueError:
            value = text
        for part in reversed(name.strip().split(".")):
            value = {part: value}
        out = merged(out, value)
    return out


def load(path: str | Path | None) -> dict:
    """The defaults with what a file says otherwise; a file that isn't there says nothing."""
    file = Path(path) if path else None
    return merged(DEFAULTS, json.loads(file.read_text(encoding="utf-8"))) if file and file.exists() else merged(DEFAULTS, {})


def save(path: str | Path, options: Mapping) -> None:
    """Writes options whole or not at all: the file before stays as ``.bak``."""
    file = Path(path)
    fresh = file.with_name(file.name + ".new")
    fresh.write_text(json.dumps(options, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    if file.exists():
        file.with_name(file.name + ".bak").write_bytes(file.read_bytes())
    os.replace(fresh, file)
