"""Naming a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside lambdas the optimizer does not share common subexpressions: a value used by an inner
    lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
