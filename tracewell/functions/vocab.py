"""Levels, ids and message templates, in Python and as columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.values import display, lookup

#: Levels in order; their codes are 1 to 6, and 0 or null is none.
LEVELS = ("Trace", "Debug", "Information", "Warning", "Error", "Fatal")
#: The spellings of each level.
LEVEL_NAMES = {
    1: ("trace", "verbose", "vrb", "trc", "finest", "finer"),
    2: ("debug", "dbg", "fine"),
    3: ("information", "info", "informational", "inf", "notice"),
    4: ("warning", "warn", "wrn"),
    5: ("error", "err", "eror", "severe"),
    6: ("fatal", "critical", "crit", "ftl", "panic", "emerg", "emergency", "alert"),
}
_CODES = {name: code for code, names in LEVEL_NAMES.items() for name in names}


def level_code(text: str) -> int | None:
    return _CODES.get(text.strip().lower())


def level_from_severity(n: int) -> int | None:
    """The level of an OpenTelemetry severity number, four numbers to a level."""
    return (n + 3) // 4 if 1 <= n <= 24 else None


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends, as str.strip() has it; F.trim takes spaces only."""
    blank = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
    return F.regexp_replace(text, f"^{blank}|{blank}$", "")


def level_code_col(text: Column) -> Column:
    pairs = [F.lit(x) for kv in _CODES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(stripped(text))).cast("tinyint")


def level_name_col(code: Column) -> Column:
    return F.when(code.between(1, 6), F.element_at(F.array(*map(F.lit, LEVELS)), F.when(code.between(1, 6), code).cast("int")))


def normalise_id(text: str | None) -> str | None:
    """Hex in lower case, other text as it is; blank and all-zero ids are absent."""
    t = (text or "").strip()
    if not t or not t.strip("0"):
        return None
    return t.lower() if re.match(r"[0-9A-Fa-f]+\Z", t) else t


def normalise_id_col(text: Column) -> Column:
    t = stripped(text)
    return F.when(t.rlike("[^0]"), F.when(t.rlike("^[0-9A-Fa-f]+$"), F.lower(t)).otherwise(t))


def render_template(template: str, props: dict[str, Any]) -> str:
    """A message template with its holes filled; unknown names stay, doubled braces are one."""

    def fill(m: re.Match) -> str:
        if m[0] in ("{{", "}}"):
            return m[0][0]
        name = re.split("[:,]", m[1].lstrip("@$"), maxsplit=1)[0]
        missing = object()
        v = lookup(props, name, missing)
        return m[0] if v is missing else display(v)

    return re.sub(r"\{\{|\}\}|\{([^}]*)\}", fill, template)
