"""Case-insensitive, unique column names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from tessella.errors import ArgumentError, MissingColumnError

#: Hidden column that carries the row order; never part of a user schema.
ORDER = "__ord"


def check_name(name: object, what: str = "column name") -> str:
    """Return ``name`` if it is a non-blank string that is not reserved."""
    if not isinstance(name, str):
        raise ArgumentError(f"{what} must be a string, got {type(name).__name__}")
    if not name.strip():
        raise ArgumentError(f"{what} must not be blank")
    if name.lower() == ORDER:
        raise ArgumentError(f"{what} {name!r} is reserved")
    return name


def check_unique(names: Iterable[str], what: str = "column") -> None:
    """Raise if two names are equal without regard to case."""
    seen: set[str] = set()
    for name in names:
        if name.lower() in seen:
            raise ArgumentError(f"duplicate {what}: {name!r}")
        seen.add(name.lower())


def resolve(columns: Sequence[str], name: str) -> str:
    """The canonical spelling of ``name`` in ``columns``."""
    check_name(name)
    for column in columns:
        if column.lower() == name.lower():
            return column
    raise MissingColumnError(f"column {name!r} does not exist; columns are {', '.join(columns)}")


def resolve_all(columns: Sequence[str], names: Sequence[str], what: str) -> list[str]:
    """Resolve one or more unique names."""
    if not names:
        raise ArgumentError(f"{what} needs at least one column")
    found = [resolve(columns, n) for n in names]
    check_unique(found, f"{what} column")
    return found


def quoted(name: str) -> str:
    """``name`` as an identifier that may hold dots and back-quotes."""
    return "`" + name.replace("`", "``") + "`"
