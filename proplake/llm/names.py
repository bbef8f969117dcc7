"""Names under which a caller's columns travel through an operator."""

from __future__ import annotations


def safe_names(columns: list[str], used: tuple[str, ...] = ()) -> list[str]:
    """A name for each column, by its place: those ``used`` keep theirs, none else is one that an operator gives a column."""
    return [c if c in used else f"given {i}" for i, c in enumerate(columns)]
