"""Names for columns that operators add to tables of any shape."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(names: list[str], columns: Iterable[str]) -> list[str]:
    """Each of names, lengthened until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
