"""Decile portfolios, turnover, costs, equity, drawdown and performance.

Every function takes predictions (date, permno, fwd_ret, pred) with any further key columns named in ``by`` (for
instance a model), and evaluates all keys in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorspark.functions.xsection import bin_of_rank, ratio

TOP, BOTTOM = 9, 0


def assign_deciles(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds decile 0..9 within each date: evenly sized bins of the rank by pred, ties by permno."""
    w = Window.partitionBy(*by, "date")
    ranked = predictions.withColumn("__r", F.row_number().over(w.orderBy("pred", "permno"))).withColumn("__n", F.count("*").over(w))
    return ranked.withColumn("decile", bin_of_rank(F.col("__r"), F.col("__n"))).drop("__r", "__n")


def portfolio_returns(deciled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, long_ret, short_ret, ls_ret): equal-weight legs; dates without both go. One aggregate, no join."""
    leg = lambda d: F.avg(F.when(F.col("decile") == d, F.col("fwd_ret")))
    legs = deciled.groupBy(*by, "date").agg(leg(TOP).alias("long_ret"), leg(BOTTOM).alias("short_ret")).dropna(subset=["long_ret", "short_ret"])
    return legs.withColumn("ls_ret", F.col("long_ret") - F.col("short_ret"))


def holdings(deciled: DataFrame, decile: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, held, added): the sorted holdings of a date and those that the date before with holdings had not."""
    held = deciled.where(F.col("decile") == decile).groupBy(*by, "date").agg(F.sort_array(F.collect_set("permno")).alias("held"))
    before = F.lag("held").over(Window.partitionBy(*by).orderBy("date"))
    return held.withColumn("added", F.array_except("held", before))


def turnover(deciled: DataFrame, decile: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, turnover): the share of holdings that are new; the first date has none and is absent."""
    share = F.size("added") / F.greatest(F.size("held"), F.lit(1))
    return holdings(deciled, decile, by).where(F.col("added").isNotNull()).select(*by, "date", share.alias("turnover"))


def apply_transaction_costs(port: DataFrame, deciled: DataFrame, cost_bps: float = 20.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds turnover_combined, cost_drag, ls_ret_net and long_ret_net; turnover that is not measured counts as 1 a leg."""
    keys = [*by, "date"]
    legs = [turnover(deciled, d, by).withColumnRenamed("turnover", f"__t{d}") for d in (TOP, BOTTOM)]
    joined = port.join(legs[0], keys, "left").join(legs[1], keys, "left")
    long_, short = (F.coalesce(F.col(f"__t{d}"), F.lit(1.0)) for d in (TOP, BOTTOM))
    rate = cost_bps / 10_000
    out = joined.withColumn("turnover_combined", long_ + short).withColumn("cost_drag", F.col("turnover_combined") * rate)
    return out.withColumn("ls_ret_net", F.col("ls_ret") - F.col("cost_drag")).withColumn("long_ret_net", F.col("long_ret") - long_ * rate).drop(f"__t{TOP}", f"__t{BOTTOM}")


def costed_returns(deciled: DataFrame, cost_bps: float = 20.0, by: tuple[str, ...] = ()) -> DataFrame:
    """portfolio_returns and apply_transaction_costs, with turnover_long and turnover_short, in one aggregate and one window
    over dates: the predictions are read once and nothing is joined."""
    leg, own = {"long": TOP, "short": BOTTOM}, lambda d, c: F.when(F.col("decile") == d, F.col(c))
    sums = deciled.groupBy(*by, "date").agg(
        *[F.avg(own(d, "fwd_ret")).alias(f"{n}_ret") for n, d in leg.items()],
        *[F.collect_set(own(d, "permno")).alias(f"__{n}") for n, d in leg.items()],
    )
    earlier = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    for n in leg:
        held = F.when(F.size(f"__{n}") > 0, F.col(f"__{n}"))
        before = F.last(held, ignorenulls=True).over(earlier)
        sums = sums.withColumn(f"turnover_{n}", F.when(held.isNotNull() & before.isNotNull(), F.size(F.array_except(held, before)) / F.size(held)))
    rows = sums.dropna(subset=["long_ret", "short_ret"]).withColumn("ls_ret", F.col("long_ret") - F.col("short_ret"))
    long_, short, rate = F.coalesce("turnover_long", F.lit(1.0)), F.coalesce("turnover_short", F.lit(1.0)), cost_bps / 10_000
    rows = rows.withColumn("turnover_combined", long_ + short).withColumn("cost_drag", F.col("turnover_combined") * rate)
    rows = rows.withColumn("ls_ret_net", F.col("ls_ret") - F.col("cost_drag")).withColumn("long_ret_net", F.col("long_ret") - long_ * rate)
    return rows.select(*by, "date", "long_ret", "short_ret", "ls_ret", "turnover_combined", "cost_drag", "ls_ret_net", "long_ret_net", "turnover_long", "turnover_short")


def equity_curve(port: DataFrame, ret: str = "ls_ret", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, wealth, peak, drawdown): growth of 1, its running maximum from the first period on, and the loss from it."""
    return _with_equity(port, ret, by).select(*by, "date", "wealth", "peak", "drawdown")


def _with_equity(port: DataFrame, ret: str, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = port.withColumn("wealth", F.when(F.col(ret).isNotNull(), F.product(1 + F.col(ret)).over(w)))
    rows = rows.withColumn("peak", F.max("wealth").over(w))
    return rows.withColumn("drawdown", ratio(F.col("wealth") - F.col("peak"), F.col("peak")))


def performance_summary(port: DataFrame, freq: float = 12.0, ret: str = "ls_ret", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ann_return, ann_vol, sharpe, max_drawdown, n_periods); periods count rows, null returns included."""
    r = F.col(ret)
    mean, vol = F.avg(r) * freq, F.stddev_samp(r) * F.sqrt(F.lit(float(freq)))
    rows = _with_equity(port.select(*by, "date", ret), ret, by)
    return rows.groupBy(*by).agg(mean.alias("ann_return"), vol.alias("ann_vol"), F.when(vol > 0, ratio(mean, vol)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.count("*").cast("int").alias("n_periods"))


def _series(port: DataFrame, pairs: dict[str, tuple[str, str, str]], by: tuple[str, ...]) -> DataFrame:
    """(by, construction, kind, date, ret, base): the gross and net return series of constructions, and the turnover they are charged on."""
    rows = [F.struct(F.lit(k).alias("construction"), F.lit(kind).alias("kind"), F.col(r).alias("ret"), F.expr(base).alias("base")) for k, (gross, net, base) in pairs.items() for kind, r in (("gross", gross), ("net", net))]
    return port.select(*by, "date", F.explode(F.array(*rows)).alias("x")).select(*by, "date", "x.*")


def _comparison(series: DataFrame, keys: tuple[str, ...], freq: float, cost_bps: float, n_bootstrap: int) -> DataFrame:
    """One row for keys: the gross figures, the net ones with a suffix, mean turnover and costs, in one pass over the series."""
    both = (*keys, "kind")
    mean, vol = F.avg("ret") * freq, F.stddev_samp("ret") * F.sqrt(F.lit(float(freq)))
    stats = _with_equity(series, "ret", both).groupBy(*both).agg(
        mean.alias("ann_return"), vol.alias("ann_vol"), F.when(vol > 0, ratio(mean, vol)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.count("*").cast("int").alias("n_periods"), F.avg("base").alias("turnover_mean")
    )
    if n_bootstrap:
        from factorspark.operators.bootstrap import bootstrap_sharpe

        stats = stats.join(bootstrap_sharpe(series, "ret", both, freq, n_bootstrap).drop("n_bootstrap"), list(both))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = [pick("gross", c).alias(c) for c in ("ann_return", "ann_vol", "sharpe", "max_drawdown", "n_periods", "turnover_mean")]
    out += [pick("net", c).alias(f"{c}_net") for c in ("ann_return", "sharpe", "max_drawdown")]
    if n_bootstrap:
        for c in ("ci_low", "ci_high", "p_value"):
            out += [pick("gross", f"sharpe_{c}").alias(f"sharpe_{c}"), pick("net", f"sharpe_{c}").alias(f"sharpe_net_{c}")]
    return stats.groupBy(*keys).agg(*out).withColumn("cost_bps", F.lit(float(cost_bps)))


def compare_models(predictions: DataFrame, freq: float = 12.0, cost_bps: float = 20.0, n_bootstrap: int = 0) -> DataFrame:
    """One row a model (predictions with a column model): gross and net long-short figures. turnover_mean is that of the
    long leg alone. Bootstrap columns are added if n_bootstrap is not 0."""
    by = ("model",)
    port = costed_returns(assign_deciles(predictions, by), cost_bps, by)
    return _comparison(_series(port, {"long_short": ("ls_ret", "ls_ret_net", "turnover_long")}, by).drop("construction"), by, freq, cost_bps, n_bootstrap)


def compare_constructions(predictions: DataFrame, freq: float = 12.0, cost_bps: float = 20.0, n_bootstrap: int = 0) -> DataFrame:
    """Rows long_short and long_only of one model's predictions; turnover_mean is what each row's costs are charged on,
    over the dates on which it is measured."""
    port = costed_returns(assign_deciles(predictions), cost_bps)
    pairs = {"long_short": ("ls_ret", "ls_ret_net", "turnover_long + turnover_short"), "long_only": ("long_ret", "long_ret_net", "turnover_long")}
    return _comparison(_series(port, pairs, ()), ("construction",), freq, cost_bps, n_bootstrap)


def final_returns(predictions: DataFrame, cost_bps: float = 20.0) -> DataFrame:
    """The return series that the run publishes: date, legs, turnover, costs and net returns."""
    return costed_returns(assign_deciles(predictions), cost_bps).drop("turnover_long", "turnover_short")
