"""A value that an expression names more than once, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``. A plain column is copied to each place that names it; as a lambda's variable it isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
