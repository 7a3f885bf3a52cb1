"""Column builders for cross-sections and series. All null-safe and free of ANSI errors."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clean(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


def last_non_null(value: Column, order: Column) -> Column:
    """The value of the latest row that has one."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def compounded(ret: Column, w: WindowSpec) -> Column:
    """Running product of 1 + ret along w; a missing return counts as 0, a return of -1 gives 0 from there on."""
    return F.product(1 + F.coalesce(ret, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def quantiles(x: Column, *q: float) -> Column:
    """Exact quantiles with linear interpolation, nulls skipped."""
    return F.percentile(x, F.array(*[F.lit(float(p)) for p in q]))


def bin_of_rank(rank: Column, n: Column, bins: int = 10) -> Column:
    """The bin 0..bins-1 of rank 1..n with right-closed edges evenly spaced over the ranks; NULL if n is 1."""
    edge = F.ceil(bins * (rank - 1) / (n - 1).cast("double")) - 1
    return F.when(n > 1, F.greatest(F.lit(0), edge).cast("int"))


def value_bin(x: Column, edges: Column) -> Column:
    """The right-closed bin of a value between distinct sorted edges, the lowest edge included."""
    below = F.size(F.filter(edges, lambda e: e < x)) - 1
    return F.when(x.isNotNull() & (F.size(edges) > 1), F.greatest(below, F.lit(0)))


def average_rank(value: Column, keys: list[str]) -> Column:
    """Rank of value within keys, ties sharing the mean of their places; nulls keep NULL."""
    by, ties = Window.partitionBy(*keys), Window.partitionBy(*keys, value)
    return F.when(value.isNotNull(), F.rank().over(by.orderBy(value.asc_nulls_last())) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows; NULL for fewer than two rows or a constant side."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
