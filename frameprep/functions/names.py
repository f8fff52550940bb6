"""Output column names that overwrite nothing."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(wanted: Iterable[str], taken: Iterable[str]) -> list[str]:
    """``wanted`` in order, with underscores added to a name that is taken already
    or was given before (names that differ in case alone are one to Spark)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
