"""Compute a value once inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often body uses it.

    A Python variable holding a Column is a macro: every use repeats the whole expression,
    and long rules explode. A one-element transform binds it to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body: Callable[[Column], Column], **values: Column) -> Column:
    """Bind several values at once; body receives a struct with one field per name."""
    return let(F.struct(*[c.alias(n) for n, c in values.items()]), body)


def compute_once(value: Column) -> Column:
    """The value itself, in a form that Catalyst does not copy.

    The optimizer substitutes deterministic expressions into every filter it pushes down and
    into several consumers. For rules that cost far more than the filter saves (and that would
    even move below a repartition), the always-true random test keeps them in their place.
    """
    return F.when(F.rand(0) * 2 >= 0, value)
