"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` uses it.

    Chained steps that each use their input several times would otherwise grow with every step as soon as the
    optimizer moves a filter below them.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
