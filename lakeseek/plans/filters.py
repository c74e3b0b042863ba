"""Predicates: time and version of points, and typed conditions on their metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.types import parse_time

_BOUNDS = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


@dataclass(frozen=True)
class TemporalFilter:
    """``version`` wins over ``as_of``, that over ``include_inactive``; without any, active points."""

    include_inactive: bool = False
    version: int | None = None
    as_of: float | None = None

    @classmethod
    def of(cls, value: Any) -> TemporalFilter:
        if value is None or isinstance(value, cls):
            return value or cls()
        if not isinstance(value, Mapping) or set(value) - set(cls.__dataclass_fields__):
            raise ValueError(f"not a temporal filter: {value!r}")
        version = value.get("version")
        return cls(bool(value.get("include_inactive", False)), None if version is None else int(version), parse_time(value.get("as_of")))

    def predicate(self) -> Column | None:
        if self.version is not None:
            return F.col("version") == self.version
        if self.as_of is not None:
            return (F.col("valid_from") <= self.as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > self.as_of))
        return None if self.include_inactive else F.col("is_active")


#: JSON types by the SQL type of a value: of a scalar, and of an array of them.
_JSON = {"boolean": ("^BOOLEAN", "^ARRAY<BOOLEAN>"), "double": ("^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "^ARRAY<(BIGINT|DOUBLE|DECIMAL)"), "string": ("^STRING", "^ARRAY<STRING>")}


def _any(key: str, values: Sequence[bool | int | str], column: str) -> Column:
    """Any of the values, each by equality of the same JSON type; the document is parsed once a type, not once a value."""
    path = "$." + key
    doc = F.try_parse_json(F.col(column))
    kind = F.schema_of_variant(F.variant_get(doc, path, "variant"))
    groups: dict[str, list] = {}
    for v in values:
        cast = "boolean" if isinstance(v, bool) else "double" if isinstance(v, int) else "string"
        groups.setdefault(cast, []).append(float(v) if cast == "double" else v)
    out = None
    for cast, group in groups.items():
        scalar, array = _JSON[cast]
        exact = F.rlike(kind, F.lit(scalar)) & F.try_variant_get(doc, path, cast).isin(group)
        # an array matches if one of its elements does
        among = F.rlike(kind, F.lit(array)) & F.arrays_overlap(F.try_variant_get(doc, path, f"array<{cast}>"), F.array(*map(F.lit, group)))
        now = F.coalesce(exact | among, exact, F.lit(False))
        out = now if out is None else out | now
    return out


def _range(key: str, bounds: Mapping[str, Any], column: str) -> Column:
    path = "$." + key
    doc = F.try_parse_json(F.col(column))
    number = F.schema_of_variant(F.variant_get(doc, path, "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    v = F.try_variant_get(doc, path, "double")
    out = number
    for name, bound in bounds.items():
        out = out & _BOUNDS[name](v, F.lit(float(bound)))
    return F.coalesce(out, F.lit(False))


def metadata(conditions: Mapping[str, Any] | None, column: str = "meta") -> Column | None:
    """All conditions at once: bool, int and str by equality of the same JSON type, float as a closed range, sequences as any of, mappings as ranges. Dots in a key go into nested objects."""
    out = None
    for key, value in (conditions or {}).items():
        if isinstance(value, (bool, int, str)):
            c = _any(key, [value], column)
        elif isinstance(value, float):
            c = _range(key, {"gte": value, "lte": value}, column)
        elif isinstance(value, Sequence):
            if not value or not all(isinstance(v, (bool, int, str)) for v in value):
                raise StoreError(f"any-of for {key!r} takes bools, ints and strings")
            c = _any(key, value, column)
        elif isinstance(value, Mapping) and value and set(value) <= set(_BOUNDS):
            c = _range(key, value, column)
        else:
            raise StoreError(f"no condition can be made of {key!r}: {value!r}")
        out = c if out is None else out & c
    return out


def require(keys: Sequence[str], conditions: Mapping[str, Any] | None) -> None:
    """Each key must be there and not None; 0, False and "" will do."""
    missing = [k for k in keys if (conditions or {}).get(k) is None]
    if missing:
        raise ValueError(f"metadata_filter lacks required keys: {missing}")


def every(*parts: Column | None) -> Column:
    """The conjunction of those that are there."""
    out = F.lit(True)
    for p in parts:
        if p is not None:
            out = out & p
    return out
