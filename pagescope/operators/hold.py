"""A step of a plan that is computed once, where it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hold(rows: DataFrame, *names: str) -> DataFrame:
    """The rows with these columns computed here: they leave a generator of one row, into which the optimizer does not look.

    Without it the arrays of 24 expressions would be put in each of the places that read an entry, and in the filter
    that Spark infers below a generator of such an array.
    """
    return rows.select(*[c for c in rows.columns if c not in names], F.inline(F.array(F.struct(*names))))
