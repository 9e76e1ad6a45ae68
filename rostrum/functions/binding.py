"""Local names inside one row's expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda re-evaluates an outer expression for every element it visits;
    binding it to a lambda variable of a one-element array avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
