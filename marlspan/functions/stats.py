"""Column builders for statistics that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

NORMAL_975 = 1.959964


def _over(c: Column, w: WindowSpec | None) -> Column:
    return c.over(w) if w is not None else c


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is zero."""
    return F.try_divide(a, b)


def safe_corr(a: Column, b: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs without a null, plain or windowed; null
    on a constant column, where the built-in one raises under ANSI."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(_over(F.covar_pop(x, y), w), _over(F.stddev_pop(x), w) * _over(F.stddev_pop(y), w))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held between two bounds; null stays null, which ``least`` and ``greatest`` pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def fisher_bound(r: Column, n: Column, sign: int) -> Column:
    """End of the 95 % interval of a correlation by Fisher's transformation."""
    z = F.atanh(clip(r, -0.999999, 0.999999))
    return F.tanh(z + sign * NORMAL_975 / F.sqrt(F.greatest(n - 3, F.lit(1e-9))))


def full(x: Column, n: Column, size: int) -> Column:
    """``x`` once a window holds ``size`` rows, else null."""
    return F.when(n >= size, x)
