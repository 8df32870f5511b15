"""Speaker names to the four canonical roles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from trainset.functions.text import strip
from trainset.schema import ROLE_ALIASES


def _literal_map(values: dict[str, str]) -> Column:
    quoted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in chain.from_iterable(values.items()))
    return F.expr(f"map({quoted})")


def canonical_role(role: Column) -> Column:
    """One of system/user/assistant/tool, or NULL for an unknown name."""
    names = _literal_map(ROLE_ALIASES)
    return F.coalesce(F.try_element_at(names, role), F.try_element_at(names, F.lower(strip(role))))


def mapped_role(role: Column, role_map: dict[str, str]) -> Column:
    """Apply a source-specific renaming; names without an entry pass through trimmed."""
    name = strip(role)
    if not role_map:
        return name
    return F.coalesce(F.try_element_at(_literal_map(role_map), name), name)
