"""Log-space arithmetic as column expressions, and the piecewise approximations' exact forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the log of zero.
LOG_ZERO = -2e20
#: Differences of logs from which the smaller one has no effect.
UNDERFLOW = 7.5


def log_add(*xs: Column, compat: bool = False) -> Column:
    """log of the sum of exponentials. compat: terms UNDERFLOW or more below are ignored, as is LOG_ZERO."""

    def two(x: Column, y: Column) -> Column:
        high, low = F.greatest(x, y), F.least(x, y)
        full = high + F.log1p(F.exp(low - high))
        return F.when((low <= LOG_ZERO) | (high - low >= UNDERFLOW), high).otherwise(full) if compat else full

    return reduce(two, xs)


def exp_clipped(x: Column) -> Column:
    """Exponential that is 0 at -16 and below."""
    return F.when(x <= -16, F.lit(0.0)).otherwise(F.exp(x))


def log1p_exp(x: Column) -> Column:
    return F.log1p(F.exp(x))


def best_of_three(x: Column, y: Column, z: Column, names=("D", "L", "U")) -> Column:
    """Name of the largest; of equal ones the earlier."""
    return F.when((x >= y) & (x >= z), names[0]).when(y >= z, names[1]).otherwise(names[2])


def focal_loss(p: Column, cls: Column, alpha=(2.0, 3.0, 2.0, 1.0), gamma: float = 2.0, clip: float = 1e-7) -> Column:
    """Focal loss of the probability p given to the true class cls."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    weight = F.element_at(F.array(*map(F.lit, alpha)), cls + 1)
    return -weight * F.pow(1 - q, F.lit(gamma)) * F.log(q)
