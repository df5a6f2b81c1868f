"""Sensitivity ranks, scopes, JSON checks, routing and budgets."""

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sensitivity levels in order.
LEVELS = ("public", "internal", "restricted", "prohibited")


def sensitivity_rank(level: Column) -> Column:
    """0 to 3; no level is internal, an unknown one prohibited."""
    out = F.when(level.isNull(), 1)
    for i, name in enumerate(LEVELS):
        out = out.when(level == name, i)
    return out.otherwise(3)


def in_scope(scope: Column, scopes: list[str] | None, session: list[str] | None = None) -> Column:
    """No list of scopes: everything; a session's list narrows it."""
    if scopes is None:
        return F.lit(True) if session is None else scope.isin(session)
    allowed = [s for s in scopes if session is None or s in session]
    return scope.isin(allowed) if allowed else F.lit(False)


@dataclass(frozen=True)
class Principal:
    """Who asks: scopes that may be read (None: all) and the highest sensitivity."""

    name: str
    scopes: tuple[str, ...] | None
    ceiling: int

    def sees(self, scope: Column, level: Column) -> Column:
        """Rows in a readable scope, at or under the ceiling; rows without a scope are of the default one."""
        return in_scope(F.coalesce(scope, F.lit("default")), None if self.scopes is None else list(self.scopes)) & (sensitivity_rank(level) <= self.ceiling)


def principal(rows: DataFrame, name: str) -> Principal:
    """A principal of (name, enabled, scopes: JSON list or null, ceiling: level or null).

    Unknown and disabled ones are refused. Scopes that aren't a JSON list of texts allow
    nothing, and an unknown ceiling is the lowest: what can't be read is closed.
    """
    found = rows.where(F.col("name") == name).select("enabled", "scopes", "ceiling").first()
    if found is None or not found.enabled:
        raise PermissionError(f"principal {name!r} is unknown or disabled")
    scopes: tuple[str, ...] | None = None
    if found.scopes is not None:
        try:
            given = json.loads(found.scopes)
        except ValueError:
            given = None
        scopes = tuple(given) if isinstance(given, list) and all(isinstance(s, str) for s in given) else ()
    ceiling = len(LEVELS) - 1 if found.ceiling is None else LEVELS.index(found.ceiling) if found.ceiling in LEVELS else 0
    return Principal(name, scopes, ceiling)


def json_errors(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What a JSON value breaks of a schema: type, enum, required, properties, items, bounds, pattern."""
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}
    out = []
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or kind in ("number", "integer") and isinstance(value, bool)):
        return [f"{path}: not a {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the values")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{path}.{n}: missing" for n in schema.get("required", []) if n not in value]
        for name, inner in value.items():
            if name in fields:
                out += json_errors(inner, fields[name], f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{name}: not allowed")
    if isinstance(value, list):
        out += _bounds(path, "items", len(value), schema.get("minItems"), schema.get("maxItems"))
        for i, inner in enumerate(value):
            out += json_errors(inner, schema.get("items", {}), f"{path}[{i}]")
    if isinstance(value, str):
        out += _bounds(path, "characters", len(value), schema.get("minLength"), schema.get("maxLength"))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: doesn't match")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += _bounds(path, "value", value, schema.get("minimum"), schema.get("maximum"))
    return out


def _bounds(path: str, what: str, n: float, low: float | None, high: float | None) -> list[str]:
    if low is not None and n < low:
        return [f"{path}: {what} below {low}"]
    return [f"{path}: {what} above {high}"] if high is not None and n > high else []


def payload_errors(payload: Column, schema: dict) -> Column:
    """An array of errors of JSON texts, by an Arrow-batched function."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json_errors(json.loads(text), schema)
            except (TypeError, ValueError):
                return ["$: not JSON"]

        return texts.map(one)

    return check(payload)


def route(percent: Column) -> Column:
    """Weights (old, new) of a split in which ``percent`` of queries go to the new space."""
    return F.struct(F.round((100 - percent) / 100.0, 4).alias("old_weight"), F.round(percent / 100.0, 4).alias("new_weight"))


#: States that may follow one another.
MODEL_MOVES = {"proposed": ("canary", "retired"), "canary": ("active", "retired"), "active": ("retiring",), "retiring": ("retired",)}
INDEX_MOVES = {
    "proposed": ("shadow_building", "aborted"),
    "shadow_building": ("dual_serve", "aborted"),
    "dual_serve": ("dual_serve", "cutover", "aborted"),
    "cutover": ("cleanup", "aborted"),
    "cleanup": ("done",),
}


def advanced(state: str, to: str, moves: dict[str, tuple[str, ...]]) -> str:
    if to not in moves.get(state, ()):
        raise ValueError(f"{state} can't become {to}")
    return to
