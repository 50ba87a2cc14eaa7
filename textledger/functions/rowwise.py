"""Functions of whole texts, applied a row at a time.

Such a function gains nothing from columns, and a batch of Arrow holds 10,000
texts of any length with all that is made of them. Plain UDFs hand a worker a
hundred rows at a time, so its memory does not depend on the table's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_one(function: Callable, kind):
    """A UDF of one text; null in, null out."""
    return F.udf(lambda t: None if t is None else function(t), kind, useArrow=False)


def of_two(function: Callable, kind):
    """A UDF of two values; null where either is."""
    return F.udf(lambda s, t: None if s is None or t is None else function(s, t), kind, useArrow=False)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores before long work on each: a file of a few MB, which one task reads, may hold millions of them."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
