"""Bootstrap test of a Sharpe ratio: seeded and bit-exact in one task a series, or spread over the cluster.

The order of the draws and the formulas of test_sharpe are fixed values: published figures come out to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sharpes(samples: np.ndarray, freq: float) -> np.ndarray:
    """Annualised Sharpe of each row, NaN where it does not vary."""
    spread = samples.std(axis=1, ddof=1) if samples.shape[1] > 1 else np.zeros(len(samples))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(spread > 0, samples.mean(axis=1) / spread * np.sqrt(freq), np.nan)


def test_sharpe(returns: np.ndarray, freq: float, n_bootstrap: int = 10_000, seed: int = 0) -> dict[str, float | None]:
    """95 % percentile interval from resampling, then the two-sided p-value from resampling the returns less their
    mean, both drawn from one generator in this order. A series whose Sharpe is undefined has NULLs throughout."""
    r = returns[~np.isnan(returns)]
    observed = sharpes(r[None, :], freq)[0] if len(r) else np.nan
    if np.isnan(observed):
        return {"sharpe_ci_low": None, "sharpe_ci_high": None, "sharpe_p_value": None}
    rng = np.random.default_rng(seed)
    resampled = sharpes(rng.choice(r, size=(n_bootstrap, len(r)), replace=True), freq)
    low, high = np.nanpercentile(resampled, [2.5, 97.5])
    null = sharpes(rng.choice(r - r.mean(), size=(n_bootstrap, len(r)), replace=True), freq)
    extreme = np.abs(null[~np.isnan(null)]) >= abs(observed)
    return {"sharpe_ci_low": float(low), "sharpe_ci_high": float(high), "sharpe_p_value": float(extreme.mean())}


test_sharpe.__test__ = False  # not a test case


def bootstrap_sharpe(port: DataFrame, ret: str, by: tuple[str, ...] = (), freq: float = 12.0, n_bootstrap: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, sharpe_ci_low, sharpe_ci_high, sharpe_p_value, n_bootstrap): one series a key, in date order.

    A series has a row a rebalance date, so it fits in a task; keys run in parallel.
    """
    keys = by or ("__all",)
    rows = port.select(*by, "date", F.col(ret).cast("double").alias("__ret"))
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sharpe_ci_low double, sharpe_ci_high double, sharpe_p_value double, n_bootstrap int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = test_sharpe(pdf.sort_values("date")["__ret"].to_numpy(np.float64), freq, n_bootstrap, seed)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **got, "n_bootstrap": n_bootstrap}])

    return rows.groupBy(*keys).applyInPandas(run, schema).drop(*([] if by else ["__all"]))


def bootstrap_sharpe_spread(returns: np.ndarray, spark, freq: float, n_bootstrap: int, seed: int = 0, parts: int = 16) -> DataFrame:
    """(draw, sharpe, null_sharpe): draws of a long series spread over tasks, each draw with a generator of its own."""
    shared = spark.sparkContext.broadcast(returns[~np.isnan(returns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            one, two = [], []
            for draw in pdf["id"]:
                rng = np.random.default_rng([seed, int(draw)])
                one.append(sharpes(rng.choice(r, size=(1, len(r))), freq)[0])
                two.append(sharpes(rng.choice(r - r.mean(), size=(1, len(r))), freq)[0])
            yield pd.DataFrame({"draw": pdf["id"], "sharpe": one, "null_sharpe": two})

    return spark.range(0, n_bootstrap, 1, parts).mapInPandas(run, "draw long, sharpe double, null_sharpe double")
