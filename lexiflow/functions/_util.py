from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    An expression written inside a higher-order-function lambda is evaluated per
    element; binding it here keeps it at one evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
