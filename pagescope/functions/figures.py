"""Rounding of published figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(x: Column, digits: int, most: int = 100) -> Column:
    """Rounding half to even of the binary value, for 0 to most.

    Only a double next to a decimal tie needs care: its binary value lies a little
    above or below. Those doubles and what they round to are a table by place; any
    other is on the same side of a tie as its shortest decimal form.
    """
    if digits == 0:
        return F.bround(x, 0)
    scale = 10**digits
    ties = [(2 * k + 1) / (2 * scale) for k in range(most * scale)]
    place = F.floor(x * scale).cast("int")
    safe = F.when((place >= 0) & (place < len(ties)), place)
    return F.when(F.get(F.lit(ties), safe) == x, F.get(F.lit([round(t, digits) for t in ties]), safe)).otherwise(F.bround(x, digits))
