"""The data behind the figures, as long tables; drawing is optional and needs matplotlib."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.operators.backtest import equity_curve

METRICS = ("ann_return", "sharpe", "max_drawdown")
LABELS = {"long_short": "Long-short", "long_only": "Long only"}


def comparison_points(table: DataFrame, label: str) -> DataFrame:
    """(label, metric, gross, net): the ends of each dumbbell; turnover has one end."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("gross"), F.col(f"{m}_net").alias("net")) for m in METRICS]
    rows.append(F.struct(F.lit("turnover_mean").alias("metric"), F.col("turnover_mean").alias("gross"), F.lit(None).cast("double").alias("net")))
    return table.select(label, F.explode(F.array(*rows)).alias("x")).select(label, "x.*")


def sharpe_intervals(table: DataFrame, label: str) -> DataFrame:
    """(label, cost, low, high, p_value): the bootstrap interval of each Sharpe ratio, gross and net; NULLs without a bootstrap."""
    ends = [F.struct(F.lit(cost).alias("cost"), *[F.col(f"{p}_{c}").alias(a) for c, a in (("ci_low", "low"), ("ci_high", "high"), ("p_value", "p_value"))]) for cost, p in (("gross", "sharpe"), ("net", "sharpe_net"))]
    return table.select(label, F.explode(F.array(*ends)).alias("x")).select(label, "x.*")


def ic_series(ic: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, ic, ic_mean)."""
    mean = ic.groupBy(*keys).agg(F.avg("ic").alias("ic_mean"))
    return (ic.join(mean, list(keys)) if keys else ic.crossJoin(mean)).select(*keys, "date", "ic", "ic_mean")


def equity_points(port: DataFrame) -> DataFrame:
    """(construction, cost, date, wealth, drawdown): growth of 1, gross and net, of both constructions."""
    curves = [("long_short", "gross", "ls_ret"), ("long_short", "net", "ls_ret_net"), ("long_only", "gross", "long_ret"), ("long_only", "net", "long_ret_net")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("construction"), F.lit(k).alias("cost"), F.col(r).alias("ret")) for c, k, r in curves]))
    long_ = port.select("date", rows.alias("x")).select("x.construction", "x.cost", "date", "x.ret")
    return equity_curve(long_, "ret", ("construction", "cost")).drop("peak")


def _plotting():
    """matplotlib, or ImportError where it is not installed; the data functions above never need it."""
    import matplotlib.pyplot as plt

    return plt


def draw_equity(port: DataFrame, path: str) -> str:
    """Growth of 1 over drawdown, as a PNG."""
    plt = _plotting()
    points = equity_points(port).orderBy("date").toPandas()  # a row a rebalance date and curve
    figure, (top, bottom) = plt.subplots(2, 1, sharex=True)
    for (construction, cost), g in points.groupby(["construction", "cost"]):
        top.plot(g["date"], g["wealth"], label=f"{LABELS.get(construction, construction)}, {cost}")
        if cost == "net":
            bottom.plot(g["date"], g["drawdown"])
    top.legend()
    figure.savefig(path)
    return path


def draw_comparison(table: DataFrame, label: str, path: str) -> str:
    """A dumbbell from gross to net for each row and metric, as a PNG."""
    plt = _plotting()
    points = comparison_points(table, label).toPandas()  # a row a model and metric
    spans = sharpe_intervals(table, label).dropna(subset=["low", "high"]).toPandas()  # two rows a model
    figure, axes = plt.subplots(1, points["metric"].nunique())
    for axis, (metric, g) in zip(axes, points.groupby("metric"), strict=True):
        names = [LABELS.get(x, x) for x in g[label]]
        axis.hlines(names, g["gross"], g["net"].fillna(g["gross"]))
        axis.plot(g["gross"], names, "o")
        axis.plot(g["net"], names, "o")
        if metric == "sharpe":
            axis.hlines([LABELS.get(x, x) for x in spans[label]], spans["low"], spans["high"], alpha=0.3)
        axis.set_title(metric)
    figure.text(0, 0, "; ".join(f"{r[label]} {r['cost']}: p = {r['p_value']:.3f}" for _, r in spans.iterrows()))
    figure.savefig(path)
    return path


def draw_ic(ic: DataFrame, path: str, keys: tuple[str, ...] = ()) -> str:
    """Rank correlations over time with their mean, as a PNG."""
    plt = _plotting()
    points = ic_series(ic, keys).orderBy("date").toPandas()  # a row a date
    figure, axis = plt.subplots()
    for name, g in points.groupby(list(keys)) if keys else [("", points)]:
        axis.plot(g["date"], g["ic"], "o-", label=str(name))
        axis.axhline(g["ic_mean"].iloc[0])
    figure.savefig(path)
    return path
