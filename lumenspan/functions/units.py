"""Units: what a value is scaled to, and how it is printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to nanoseconds, bytes and ratios, by unit.
TO_NANOS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "min": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}
TO_BYTES = {"By": 1, "KiBy": 1 << 10, "MiBy": 1 << 20, "GiBy": 1 << 30, "kBy": 1_000, "MBy": 1_000_000, "GBy": 1_000_000_000}


def scaled(value: Column, unit: str) -> tuple[Column, str]:
    """The value in the base unit of its kind: duration, bytes, ratio, count, or the unit itself."""
    if unit in TO_NANOS:
        return value * TO_NANOS[unit], "duration"
    if unit in TO_BYTES:
        return value * TO_BYTES[unit], "bytes"
    if unit == "%":
        return value / 100.0, "ratio"
    if unit == "1" or unit.startswith("{"):
        return value, "ratio" if unit == "1" else "count"
    return value, unit


def _stepped(value: Column, steps: list[tuple[float, str]]) -> Column:
    out = F.concat(F.round(value, 0).cast("long").cast("string"), F.lit(steps[0][1]))
    for size, name in steps[1:]:
        out = F.when(F.abs(value) >= size, F.concat(F.format_number(value / size, 1), F.lit(name))).otherwise(out)
    return out


def duration_text(nanos: Column) -> Column:
    return _stepped(nanos, [(1, "ns"), (1e3, "us"), (1e6, "ms"), (1e9, "s"), (60e9, "min"), (3600e9, "h"), (86_400e9, "d")])


def count_text(value: Column) -> Column:
    return _stepped(value, [(1, ""), (1e3, "K"), (1e6, "M"), (1e9, "B")])


def bytes_text(value: Column) -> Column:
    return _stepped(value, [(1, " B"), (1 << 10, " KiB"), (1 << 20, " MiB"), (1 << 30, " GiB"), (1 << 40, " TiB")])
