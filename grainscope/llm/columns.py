"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is evaluated once per row however often ``use`` mentions it, inside
    lambdas too (where expressions are evaluated anew for each element)."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)
