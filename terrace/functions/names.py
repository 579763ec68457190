"""Column names: quoting, and names that no column of the user has."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(stem: str, *taken: Iterable[str]) -> str:
    """``stem``, with underscores before it as long as one of the tables has such a column."""
    used = {c.lower() for columns in taken for c in columns}
    while stem.lower() in used:
        stem = f"_{stem}"
    return stem
