"""The header rules that text and spreadsheet files share."""

from __future__ import annotations

import enum
from collections.abc import Callable, Sequence

from tessella.errors import ArgumentError, FormatError
from tessella.names import ORDER


class HeaderMode(enum.Enum):
    """INFER: a header row, unless names are given. PRESENT: a header row, replaced by given names. ABSENT: none."""

    INFER = "infer"
    PRESENT = "present"
    ABSENT = "absent"


def has_header(mode: HeaderMode, names: Sequence[str] | None) -> bool:
    return mode is HeaderMode.PRESENT or mode is HeaderMode.INFER and names is None


def check_header(names: Sequence[str | None]) -> list[str]:
    """Names without blanks or case-insensitive repeats."""
    found, seen = [], set()
    for i, n in enumerate(names, 1):
        if n is None or not n.strip():
            raise FormatError(f"header {i} is blank")
        if n.lower() in seen or n.lower() == ORDER:
            raise FormatError(f"header {n!r} is used twice or reserved")
        seen.add(n.lower())
        found.append(n)
    return found


def column_names(mode: HeaderMode, names: Sequence[str] | None, width: int, header: Callable[[], Sequence[str | None]]) -> list[str]:
    """The column names of a table that is ``width`` wide."""
    if names is not None:
        if len(names) != width:
            raise ArgumentError(f"{len(names)} names for {width} columns")
        return check_header(names)
    if has_header(mode, names):
        return check_header(header())
    return [f"Column{i}" for i in range(1, width + 1)]
