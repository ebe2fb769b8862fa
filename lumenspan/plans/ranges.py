"""Choices that depend on the time range alone: steps, resolution, cut ranges, page limits."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
# The round steps, in seconds, and the limits.
ROUND_STEPS = (1, 5, 10, 15, 30, 60, 300, 600, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400)
MAX_STEPS, MAX_CELLS = 10_000, 100_000
PAGE_LIMITS = {"logs": (100, 1_000), "spans": (100, 1_000), "traces": (50, 1_000), "log_groups": (50, 10_000), "span_groups": (50, 10_000), "log_counts": (50, 10_000), "metrics": (100, 10_000), "services": (100, 10_000), "metric_series": (20, 10_000), "trace": (1_000, 1_000)}


@dataclass(frozen=True)
class Range:
    """Half-open, in nanoseconds."""

    start: int
    end: int

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise ValueError("a range must start before it ends")

    def first_step(self, step: int) -> int:
        return self.start - self.start % step

    def steps(self, step: int) -> int:
        count = -(-(self.end - self.first_step(step)) // step)
        if step <= 0 or count > MAX_STEPS:
            raise ValueError(f"a step must be positive and give at most {MAX_STEPS} buckets")
        return count


def default_step(r: Range, most: int = 120) -> int:
    return next((s * SECOND for s in ROUND_STEPS if (r.end - r.start) // (s * SECOND) <= most), DAY)


def resolution(r: Range) -> str:
    length = r.end - r.start
    return "raw" if length <= 6 * HOUR else "1m" if length <= 14 * DAY else "1h"


def summary_step(step: int, kind: str) -> int:
    unit = {"raw": 1, "1m": MINUTE, "1h": HOUR}[kind]
    return -(-step // unit) * unit


def group_limit(limit: int, buckets: int) -> int:
    return max(1, min(limit, MAX_CELLS // max(1, buckets)))


def page_limit(kind: str, asked: int | None) -> int:
    default, most = PAGE_LIMITS[kind]
    limit = default if asked is None else asked
    if not 1 <= limit <= most:
        raise ValueError(f"a limit must be from 1 to {most}")
    return limit


def parts(r: Range) -> dict[str, list[Range]]:
    """A range as raw ends, whole minutes and whole hours, for reading summaries."""
    out: dict[str, list[Range]] = {"raw": [], "1m": [], "1h": []}

    def split(start: int, end: int, units: list[tuple[str, int]]) -> None:
        if start >= end:
            return
        (kind, unit), rest = units[0], units[1:]
        low, high = -(-start // unit) * unit, end // unit * unit
        if unit == 1 or low < high:
            out[kind].append(Range(low, high))
            if rest:
                split(start, low, rest)
                split(high, end, rest)
        else:
            split(start, end, rest)

    split(r.start, r.end, [("1h", HOUR), ("1m", MINUTE), ("raw", 1)])
    return out


# The units of a duration text.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY, "w": 7 * DAY}
MOST = 2**63 - 1


def parse_duration(text: str) -> int:
    """Nanoseconds of 500ms, 1h, 2d or 1h30m; a day has 24 hours."""
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)\s*(ns|us|ms|s|m|h|d|w)", text)
    if text.strip().startswith("-"):
        raise ValueError(f"{text!r} is negative")
    if not parts or re.sub(r"[0-9]+(?:\.[0-9]+)?\s*(?:ns|us|ms|s|m|h|d|w)", "", text).strip():
        raise ValueError(f"{text!r} is not a duration such as 500ms, 1h or 2d")
    return min(MOST, sum(round(float(n) * UNITS[u]) if "." in n else int(n) * UNITS[u] for n, u in parts))


def parse_time(text: str, now: int) -> int:
    """Nanoseconds of an RFC 3339 instant, or of a duration before now."""
    found = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)", text.strip())
    if not found:
        return max(-MOST, now - parse_duration(text))
    day, clock, fraction, zone = found.groups()
    whole = datetime.fromisoformat(f"{day}T{clock}{'+00:00' if zone in 'Zz' else zone}") - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return min(MOST, (whole.days * 86_400 + whole.seconds) * SECOND + int((fraction or "").ljust(9, "0")))


def resolve(since: str | None, until: str | None, now: int, oldest: list[int], whole: bool = False) -> Range:
    """The range that two texts name, within what is kept: by default the last hour, or all that is kept.

    `oldest` has the oldest kept instant of each signal that is read; the latest of them counts.
    """
    end = now if until is None else parse_time(until, now)
    start = parse_time(since, now) if since is not None else None if whole else now - HOUR
    if start is not None and start >= end:
        raise ValueError("since has to be before until")
    kept = max(oldest)
    if kept >= end:
        raise ValueError("the range ends before the oldest telemetry that is kept")
    return Range(kept if start is None else max(start, kept), end)
