"""Distribution functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published polynomial for the normal tail (error below 7.5e-8).
TAIL_SCALE = 0.2316419
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
DENSITY = 0.3989422804014327


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal; null stays null."""
    t = 1 / (1 + TAIL_SCALE * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    tail = DENSITY * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)
