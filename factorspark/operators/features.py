"""From daily rows to the monthly feature panel. All steps by permno share one partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorspark.functions.xsection import at_least, clip, compounded, last_non_null, quantiles, ratio
from factorspark.schemas import FEATURES


def by_entity() -> WindowSpec:
    return Window.partitionBy("permno").orderBy("date")


def with_return_index(daily: DataFrame) -> DataFrame:
    return daily.withColumn("cum_ret_index", compounded(F.col("ret"), by_entity()))


def resample_to_monthly(daily: DataFrame) -> DataFrame:
    """(permno, calendar month end): last known index and cap, mean dollar volume, deviation of daily returns."""
    rows = with_return_index(daily).withColumn("month", F.last_day("date"))
    out = rows.groupBy("permno", "month").agg(
        last_non_null(F.col("cum_ret_index"), F.col("date")).alias("cum_ret_index"),
        last_non_null(F.col("mkt_cap"), F.col("date")).alias("mkt_cap"),
        F.avg("dollar_vol").alias("avg_dollar_vol"),
        F.stddev_samp("ret").alias("daily_ret_std"),
    )
    return out.withColumnRenamed("month", "date")


def add_momentum(monthly: DataFrame) -> DataFrame:
    """Changes over rows, not calendar months: an entity with a missing month spans longer."""
    c = F.col("cum_ret_index")
    back = lambda k: F.lag(c, k).over(by_entity())
    return monthly.withColumns({"mom_1m": ratio(c, back(1)) - 1, "mom_3m": ratio(c, back(3)) - 1, "mom_12m_ex1": ratio(back(1), back(12)) - 1})


def add_volatility(monthly: DataFrame) -> DataFrame:
    return monthly.withColumnRenamed("daily_ret_std", "realized_vol")


def add_size_and_liquidity(monthly: DataFrame) -> DataFrame:
    return monthly.withColumns({"log_mkt_cap": F.ln(at_least(F.col("mkt_cap"), 1.0)), "log_dollar_vol": F.ln(at_least(F.col("avg_dollar_vol"), 1.0))})


def add_forward_return(monthly: DataFrame, horizon: int = 1) -> DataFrame:
    c = F.col("cum_ret_index")
    return monthly.withColumn("fwd_ret", ratio(F.lead(c, horizon).over(by_entity()), c) - 1)


def filter_to_membership(monthly: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows of entities that were members on the row's date: an interval semi join, so overlapping spells add nothing."""
    m = membership.select(F.col("permno").alias("__p"), "start", "ending")
    return monthly.join(m, (F.col("permno") == F.col("__p")) & F.col("date").between(F.col("start"), F.col("ending")), "left_semi")


def winsorized(rows: DataFrame, columns: list[str], key: str = "date", low: float = 0.01, high: float = 0.99, suffix: str = "_w") -> DataFrame:
    """Adds each column clipped to its own quantiles within key.

    Quantiles are aggregated and joined back: partial aggregation instead of a window that would sort a whole
    cross-section in one task; the aggregate has a row a date, which adaptive execution broadcasts if it is small.
    """
    limits = rows.groupBy(key).agg(*[quantiles(F.col(c), low, high).alias(f"__q_{c}") for c in columns])
    joined = rows.join(limits, key)
    out = joined.withColumns({f"{c}{suffix}": clip(F.col(c), F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]) for c in columns})
    return out.drop(*[f"__q_{c}" for c in columns])


def cross_sectional_normalize(rows: DataFrame, columns: list[str] | tuple[str, ...] = FEATURES, key: str = "date") -> DataFrame:
    """Adds c_z for each column: winsorised, less its mean, over its sample deviation, within key; NULL where that is zero."""
    w = winsorized(rows, list(columns), key)
    stats = w.groupBy(key).agg(*[f(f"{c}_w").alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = w.join(stats, key)
    z = {f"{c}_z": F.when(F.col(f"__s_{c}") > 0, ratio(F.col(f"{c}_w") - F.col(f"__m_{c}"), F.col(f"__s_{c}"))) for c in columns}
    return joined.withColumns(z).drop(*[f"{c}_w" for c in columns], *[f"__{n}_{c}" for c in columns for n in "ms"])


def raw_features(daily: DataFrame, horizon: int = 1) -> DataFrame:
    return add_forward_return(add_size_and_liquidity(add_volatility(add_momentum(resample_to_monthly(daily)))), horizon)


def build_feature_panel(daily: DataFrame, membership: DataFrame, horizon: int = 1) -> DataFrame:
    """Lags see all months; the membership filter comes after them, normalisation after it, and rows without a target
    go last, so that they still count in their cross-section."""
    members = filter_to_membership(raw_features(daily, horizon), membership)
    return cross_sectional_normalize(members).dropna(subset=[*[f"{c}_z" for c in FEATURES], "fwd_ret"])
