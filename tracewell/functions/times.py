"""Nanosecond times, durations and byte sizes as text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from typing import Any

NS = 1_000_000_000
I64_MIN, I64_MAX = -(2**63), 2**63 - 1
_RFC = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?([Zz]|[+-]\d\d(?::?\d\d)?)\Z", re.A)
_DURATION = re.compile(r"(\d+)\s*(ms|s|m|h|d|w)", re.A)
#: Milliseconds of each unit.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
#: Bytes of each unit.
SIZES = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "kib": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_rfc3339(text: str) -> int | None:
    """Nanoseconds since the epoch; an offset is required."""
    m = _RFC.match(text.strip())
    if not m:
        return None
    y, mo, d, h, mi, s, frac, zone = m.groups()
    sec = min(int(s or 0), 59)  # a leap second is the second before it
    try:
        at = datetime(int(y), int(mo), int(d), int(h), int(mi), sec, tzinfo=timezone.utc)
    except ValueError:
        return None
    if zone not in "Zz":
        digits = zone[1:].replace(":", "").ljust(4, "0")
        if int(digits[:2]) > 25 or int(digits[2:]) > 59:
            return None
        away = timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        try:
            at = at - away if zone[0] == "+" else at + away
        except OverflowError:
            return None
    delta = at - _EPOCH
    ns = (delta.days * 86_400 + delta.seconds) * NS + int((frac or "").ljust(9, "0"))
    return ns if I64_MIN <= ns <= I64_MAX else None


def format_rfc3339(ns: int) -> str:
    """UTC with as few of 0, 3, 6 or 9 digits as keep the value."""
    sec, sub = divmod(ns, NS)
    text = (_EPOCH + timedelta(seconds=sec)).strftime("%Y-%m-%dT%H:%M:%S")
    text = text.rjust(19, "0")
    digits = 0 if not sub else 3 if sub % 1_000_000 == 0 else 6 if sub % 1000 == 0 else 9
    return f"{text}{'.' + f'{sub:09d}'[:digits] if digits else ''}Z"


def unix_factor(size: float) -> int:
    """What a bare number of this size must be multiplied by to be nanoseconds."""
    return 1 if size >= 1e17 else 1000 if size >= 1e14 else 1_000_000 if size >= 1e11 else NS


def from_unix(n: int | float) -> int | None:
    """A bare number as nanoseconds, its unit guessed from its size; integers keep all digits."""
    if isinstance(n, int):
        return max(I64_MIN, min(I64_MAX, n * unix_factor(abs(n))))
    if n != n or n in (float("inf"), float("-inf")):
        return None
    ns = n * float(unix_factor(abs(n)))
    return max(I64_MIN, min(I64_MAX, int(ns))) if float(I64_MIN) <= ns <= float(I64_MAX) else None


def parse_duration_ms(text: str) -> int | None:
    """'1h30m', '15m', '500ms'; null unless all of it is units."""
    t, total, at = text.strip().lower(), 0, 0
    while at < len(t):
        m = _DURATION.match(t, at)
        if not m:
            return None
        total += int(m[1]) * UNITS[m[2]]
        at = m.end()
        while at < len(t) and t[at].isspace():
            at += 1
    return total if t else None


def parse_bytes(text: str) -> int | None:
    m = re.match(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\Z", text.strip(), re.A)
    unit = SIZES.get(m[2].lower()) if m else None
    return int(float(m[1]) * unit) if unit else None


class TimeInputError(ValueError):
    """A bad time or range in a request (status 400)."""

    status, code = 400, "bad_request"


def parse_api_time(value: Any, field: str, now: int) -> int | None:
    """RFC 3339, a Unix number or its text, 'now', '-15m' or 'now-1h'; None stays None."""
    if value is None or value == "":
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TimeInputError(f"'{field}' must be a timestamp")
    if not isinstance(value, str):
        at = from_unix(value)
    else:
        t = value.strip()
        ago = re.match(r"(?:now)?\s*-\s*(.+)\Z", t)
        if t == "now":
            return now
        if ago and (ms := parse_duration_ms(ago[1])) is not None:
            return now - ms * 1_000_000
        at = parse_rfc3339(t)
        if at is None and re.match(r"-?\d+\Z", t, re.A):
            at = from_unix(int(t))
        elif at is None and re.match(r"-?\d+\.\d+\Z", t, re.A):
            at = from_unix(float(t))
    if at is None:
        raise TimeInputError(f"'{field}' is not a valid time: {value}")
    return at


def time_range(start: Any, stop: Any, now: int, default_ms: int | None = None) -> tuple[int | None, int | None]:
    """[from, to) of a request. With default_ms a missing end is just after now and a missing start so long before the end."""
    a, b = parse_api_time(start, "from", now), parse_api_time(stop, "to", now)
    if default_ms is not None:
        b = now + 1 if b is None else b
        a = b - default_ms * 1_000_000 if a is None else a
    if a is not None and b is not None and a >= b:
        raise TimeInputError("'from' must be before 'to'")
    return a, b
