"""Column functions: n-grams, hashes, sketches and similarities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it and whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]
