"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """A double rounded as SQL's ROUND on doubles does: scaled, halves away from zero, scaled back.

    Spark's own goes by the shortest decimal form, and so takes 2.0343335 up where the scaled double lies below the half.
    """
    scale = 10.0**digits
    near = F.floor(F.abs(x) * scale + 0.5) / scale
    return F.when(F.abs(x) < 1e15 / scale, F.when(x < 0, -near).otherwise(near) + 0.0).otherwise(F.round(x, digits))
