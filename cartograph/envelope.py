"""JSON envelopes around results, and exit codes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def envelope(command: str, data: object, warnings: list[str] | None = None) -> dict:
    return {"schema_version": 1, "command": command, "status": "ok", "data": data, "warnings": warnings or []}


def failure(command: str, kind: str, message: str) -> dict:
    return {"schema_version": 1, "command": command, "status": "error", "data": {"kind": kind, "message": message}, "warnings": []}


def compact(value: object) -> object:
    """Drops nulls and empty lists and objects from objects; list items stay."""
    if isinstance(value, dict):
        small = {k: compact(v) for k, v in value.items()}
        return {k: v for k, v in small.items() if v is not None and v != [] and v != {}}
    return [compact(v) for v in value] if isinstance(value, list) else value


def render(value: dict, small: bool = False) -> str:
    return json.dumps(compact(value), separators=(",", ":")) if small else json.dumps(value, indent=2)
