"""Operators of the panel engine against hand-made frames, pandas, published figures and the SQL of the catalogue."""

import datetime as dt
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.functions.xsection import average_rank, bin_of_rank, correlation
from factorspark.operators import backtest as bt
from factorspark.operators import features as ft
from factorspark.operators import folds as fo
from factorspark.operators import models as md
from factorspark.operators.bootstrap import bootstrap_sharpe, bootstrap_sharpe_spread
from factorspark.operators.evaluate import information_coefficient
from factorspark.operators.lambdamart import Ranker
from factorspark.plans import catalogue
from factorspark.sources import panel as src
from tests.golden import FIGURES, SERIES

DAY = dt.date(2020, 1, 31)


def months(n, start=DAY):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


# Bins of ranks 1..n as the reference assigns them.
BINS = {3: [0, 4, 9], 5: [0, 2, 4, 7, 9], 9: [0, 1, 2, 3, 4, 6, 7, 8, 9], 15: [0, 0, 1, 2, 2, 3, 4, 4, 5, 6, 7, 7, 8, 9, 9]}


def test_bins_of_ranks(spark):
    df = spark.range(1, 1201).withColumnRenamed("id", "n").withColumn("r", F.explode(F.sequence(F.lit(1), "n"))).select("n", "r", bin_of_rank(F.col("r"), F.col("n")).alias("b"))
    got = df.where(F.col("n").isin([1, *BINS])).toPandas().sort_values(["n", "r"]).groupby("n").b.apply(list)
    assert all(got[n] == bins for n, bins in BINS.items()) and got[1] == [None] or np.isnan(got[1][0])
    sizes = df.where("n >= 10").groupBy("n", "b").count().groupBy("n").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k"))
    assert sizes.where("d > 1 or k <> 10").count() == 0


def test_ties_go_by_permno(spark):
    rows = spark.createDataFrame([(DAY, p, 0.0, 1.0) for p in random.Random(1).sample(range(100), 20)], "date date, permno int, fwd_ret double, pred double")
    got = bt.assign_deciles(rows).orderBy("permno").toPandas()
    assert got.decile.is_monotonic_increasing and got.decile.nunique() == 10


def test_average_rank_and_correlation(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.repeat([1, 2, 3], 40), "x": rng.integers(0, 9, 120).astype(float), "y": rng.normal(size=120)})
    got = spark.createDataFrame(pdf).select("k", "x", "y", average_rank(F.col("x"), ["k"]).alias("r")).toPandas()
    assert (got.groupby("k").x.rank() == got.r).all()
    ic = information_coefficient(spark.createDataFrame(pdf), ["k"], "x", "y").toPandas().set_index("k").ic
    for k, g in pdf.groupby("k"):
        assert abs(g.x.rank().corr(g.y.rank()) - ic[k]) < 1e-12
    flat = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 1.0)], "k int, x double, y double")
    assert [r.ic for r in information_coefficient(flat, ["k"], "x", "y").collect()] == [None, None]
    assert flat.agg(correlation(F.col("x"), F.col("y"))).first()[0] is None


def daily_frame(spark, rows):
    return spark.createDataFrame(rows, "permno int, date date, prc double, ret double, vol double, shrout double, cfacpr double, cfacshr double, mkt_cap double, dollar_vol double")


def test_monthly_resample_edges(spark):
    d = lambda x: dt.date.fromisoformat(x)
    rows = [(1, d("2020-01-02"), 1.0, 0.1, 1.0, 1.0, 1.0, 1.0, 10.0, 2.0), (1, d("2020-01-30"), 1.0, None, 1.0, 1.0, 1.0, 1.0, None, 4.0), (1, d("2020-03-05"), 1.0, -1.0, 1.0, 1.0, 1.0, 1.0, 5.0, None), (1, d("2020-04-05"), 1.0, 0.5, 1.0, 1.0, 1.0, 1.0, 5.0, 1.0)]
    got = {str(r.date): r for r in ft.add_momentum(ft.resample_to_monthly(daily_frame(spark, rows))).collect()}
    assert set(got) == {"2020-01-31", "2020-03-31", "2020-04-30"}  # month ends; a missing month has no row
    assert got["2020-01-31"].mkt_cap == 10.0 and got["2020-01-31"].daily_ret_std is None and got["2020-01-31"].avg_dollar_vol == 3.0
    assert got["2020-03-31"].cum_ret_index == 0.0 and got["2020-03-31"].mom_1m == -1.0 and got["2020-04-30"].mom_1m is None


def test_forward_return_stays_in_its_entity(spark):
    rows = [(p, m, float(p * 10 + i), 1.0, 1.0, 0.1) for p in (1, 2, 3) for i, m in enumerate(months(2 if p == 2 else 5))]
    monthly = spark.createDataFrame(rows, "permno int, date date, cum_ret_index double, mkt_cap double, avg_dollar_vol double, daily_ret_std double")
    got = ft.add_forward_return(monthly, 3).toPandas()
    assert got[got.permno == 2].fwd_ret.isna().all() and got[got.permno != 2].fwd_ret.notna().sum() == 4


def test_membership_is_an_interval_semi_join(spark):
    monthly = spark.createDataFrame([(1, m) for m in months(12)], "permno int, date date")
    spells = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2020, 3, 30)), (1, dt.date(2020, 2, 1), dt.date(2020, 3, 1)), (1, dt.date(2020, 6, 30), dt.date(2020, 7, 31)), (2, DAY, DAY)], "permno int, start date, ending date")
    got = sorted(str(r.date) for r in ft.filter_to_membership(monthly, spells).collect())
    assert got == ["2020-01-31", "2020-02-29", "2020-06-30", "2020-07-31"]


def test_normalisation_like_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"date": np.repeat(months(4), 50), "x": rng.standard_t(2, 200)})
    pdf.loc[3, "x"] = np.nan
    pdf.loc[150:, "x"] = 7.0
    df = spark.createDataFrame([(r.date, None if np.isnan(r.x) else float(r.x)) for r in pdf.itertuples()], "date date, x double")
    got = ft.cross_sectional_normalize(df, ["x"]).toPandas()

    def z(s):
        w = s.clip(s.quantile(0.01), s.quantile(0.99))
        return (w - w.mean()) / w.std() if w.std() > 1e-12 else w * np.nan

    want = pdf.groupby("date").x.transform(z)
    assert np.allclose(np.sort(got.x_z.dropna()), np.sort(want.dropna()), atol=1e-12) and got.x_z.isna().sum() == want.isna().sum()


def test_splits(spark):
    panel = spark.createDataFrame([(m,) for m in months(68)], "date date")
    got = fo.walk_forward_splits(panel, 36, 1, 3, 2).toPandas()
    assert got.fold.nunique() == 11
    first = got[got.fold == 0]
    assert (first.role == "train").sum() == 34 and (got[(got.fold == 1) & (got.role == "train")]).shape[0] == 36
    dates = months(68)
    for _, g in got.groupby("fold"):
        test = dates.index(g[g.role == "test"].date.iloc[0])
        assert max(map(dates.index, g[g.role == "train"].date)) == test - 3
    assert fo.walk_forward_splits(panel, 100).count() == 0
    growing = fo.walk_forward_splits(panel, None, 1, 4, 2).toPandas()
    for k, g in growing.groupby("fold"):
        test = dates.index(g[g.role == "test"].date.iloc[0])
        assert test == 12 + 4 * k and sorted(map(dates.index, g[g.role == "train"].date)) == list(range(test - 2))
    both = fo.walk_forward_splits(panel, 12, 2, 1).where("role = 'test'").toPandas()
    assert both.groupby("fold").size().eq(2).all() and both.groupby("date").size().max() == 2 and both.fold.nunique() == 55


def test_turnover_skips_dates_without_the_decile(spark):
    rows = []
    for i, (m, n) in enumerate(zip(months(3), (20, 1, 20), strict=True)):
        rows += [(m, p, 0.01 * p, float((p * (i + 1)) % 20)) for p in range(n)]
    preds = spark.createDataFrame(rows, "date date, permno int, fwd_ret double, pred double")
    dec = bt.assign_deciles(preds)
    got = bt.turnover(dec).toPandas()
    assert [str(d) for d in got.date] == ["2020-03-31"]
    one = bt.costed_returns(dec).drop("turnover_long", "turnover_short").toPandas().sort_values("date").reset_index(drop=True)
    two = bt.apply_transaction_costs(bt.portfolio_returns(dec), dec).select(*one.columns).toPandas().sort_values("date").reset_index(drop=True)
    pd.testing.assert_frame_equal(one, two)
    assert one.turnover_combined.iloc[0] == 2.0


def test_published_figures_are_reproduced(spark):
    port = spark.createDataFrame([(dt.date.fromisoformat(d), ls, lo, t) for d, ls, lo, t in SERIES], "date date, long_short double, long_only double, turnover double")
    for name, want in FIGURES.items():
        got = bt.performance_summary(port, 4.0, name).first()
        for k in ("ann_return", "ann_vol", "sharpe", "max_drawdown"):
            assert abs(got[k] - want[k]) < 1e-12, (name, k)
        test = bootstrap_sharpe(port, name, freq=4.0).first()
        assert (test.sharpe_ci_low, test.sharpe_ci_high, test.sharpe_p_value) == pytest.approx((want["sharpe_ci_low"], want["sharpe_ci_high"], want["sharpe_p_value"]), abs=1e-13)
    assert abs(np.mean([t for *_, t in SERIES[1:]]) - FIGURES["long_short"]["turnover_mean"]) < 1e-12


def test_bootstrap_of_a_constant_series_is_null(spark):
    port = spark.createDataFrame([(m, 0.5) for m in months(5)], "date date, r double")
    assert bootstrap_sharpe(port, "r", n_bootstrap=50).first().sharpe_p_value is None
    spread = bootstrap_sharpe_spread(np.random.default_rng(0).normal(0.01, 0.1, 60), spark, 12, 200).toPandas()
    assert len(spread) == 200 and abs(spread.null_sharpe.mean()) < 0.3 < spread.sharpe.mean() + 1


def test_ranker_learns_an_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    y = x[:, 2] - 0.5 * x[:, 4] + rng.normal(scale=0.3, size=600)
    label = np.concatenate([pd.qcut(y[i : i + 60], 10, labels=False) for i in range(0, 600, 60)]).astype(float)
    starts = np.arange(0, 601, 60)
    model = Ranker(min_child_weight=0.5, learning_rate=0.1, n_estimators=60).fit(x[:540], label[:540], starts[:10])
    assert pd.Series(model.predict(x[540:])).corr(pd.Series(y[540:]), method="pearson") > 0.6
    assert np.allclose(model.fitted, model.predict(x[:540]))
    assert len(Ranker(n_estimators=3).fit(x, label, starts).trees) == 3


def test_first_split_is_the_best_of_all():
    from factorspark.operators.lambdamart import RIDGE, Bins, Lists, gradients, grow

    rng = np.random.default_rng(6)
    x, label, starts = rng.normal(size=(240, 4)), rng.integers(0, 10, 240).astype(float), np.arange(0, 241, 60)
    g, h = gradients(rng.normal(size=240), Lists(label, starts))
    tree, fitted = grow(Bins(x), g, h, np.arange(240), np.arange(4), 1, 0.4, 0.1)
    best = (0.0, -1, 0.0)
    for c in range(4):
        for cut in np.unique(np.quantile(x[:, c], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, c] <= cut
            if min(h[left].sum(), h[~left].sum()) >= 0.4:
                gain = g[left].sum() ** 2 / (h[left].sum() + RIDGE) + g[~left].sum() ** 2 / (h[~left].sum() + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
                best = max(best, (gain, c, cut))
    assert (tree.feature[0], tree.threshold[0]) == best[1:] and best[0] > 0
    left = x[:, best[1]] <= best[2]
    assert np.allclose(fitted, np.where(left, -0.1 * g[left].sum() / (h[left].sum() + RIDGE), -0.1 * g[~left].sum() / (h[~left].sum() + RIDGE)))


def test_gradients_equal_pair_by_pair():
    from factorspark.operators.lambdamart import PAIRS_OF_TOP, Lists, gradients

    rng = np.random.default_rng(7)
    score, label, starts = rng.normal(size=130), rng.integers(0, 4, 130).astype(float), np.array([0, 1, 41, 130])
    g, h = gradients(score, Lists(label, starts))
    want_g, want_h = np.zeros(130), np.zeros(130)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        order = a + np.argsort(-score[a:b], kind="stable")
        gain = 2.0 ** label[order] - 1
        ideal = sum(w / np.log2(k + 2) for k, w in enumerate(sorted(gain, reverse=True)))
        for i in range(min(PAIRS_OF_TOP, b - a)):
            for j in range(i + 1, b - a):
                if label[order[i]] != label[order[j]]:
                    sign = np.sign(label[order[i]] - label[order[j]])
                    delta = abs(gain[i] - gain[j]) * abs(1 / np.log2(i + 2) - 1 / np.log2(j + 2)) / ideal
                    p = 1 / (1 + np.exp(sign * (score[order[i]] - score[order[j]])))
                    want_g[order[i]] -= sign * p * delta
                    want_g[order[j]] += sign * p * delta
                    want_h[[order[i], order[j]]] += p * (1 - p) * delta
    assert np.allclose(g, want_g, atol=1e-13) and np.allclose(h, want_h, atol=1e-13)


def test_comparison_with_bootstrap_equals_the_test_of_each_series(spark):
    from factorspark.operators.bootstrap import test_sharpe

    folder = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["q48_compare_with_bootstrap"](spark, folder).toPandas().set_index("construction")
    port = catalogue.port(spark, folder).toPandas().sort_values("date")
    for name, gross, net in (("long_short", "ls_ret", "ls_ret_net"), ("long_only", "long_ret", "long_ret_net")):
        for column, key in ((gross, "sharpe"), (net, "sharpe_net")):
            want = test_sharpe(port[column].to_numpy(), catalogue.FREQ)
            for part in ("ci_low", "ci_high", "p_value"):
                assert got.loc[name, f"{key}_{part}"] == pytest.approx(want[f"sharpe_{part}"], abs=2e-7)


def test_remote_reads_send_the_key_set(spark, tmp_path):
    asked = []

    def read(session, url, query, keys=None, **options):
        asked.append((query, keys))
        if "stocknames" in query:
            return session.createDataFrame([(1, "A", "Alpha", DAY, DAY)], "permno int, ticker string, comnam string, namedt date, nameenddt date")
        if "prc" in query:
            return session.createDataFrame([(1, DAY, -2.0, 0.1, 3.0, 4.0, 1.0, 1.0)], "permno int, date date, prc double, ret double, vol double, shrout double, cfacpr double, cfacshr double")
        return session.createDataFrame([(p, DAY, DAY) for p in range(1, 1202)], "permno int, start date, ending date")

    out = src.ingest_remote(spark, "jdbc:none", "2020-01-01", "2020-12-31", str(tmp_path), read)
    assert [k is None for _, k in asked] == [True, False, False] and len(asked[1][1]) == 3 and asked[1][1][2] == f"permno IN ({', '.join(map(str, range(1001, 1202)))})"
    assert spark.read.parquet(out["prices"]).first().mkt_cap == 8000.0 and spark.read.parquet(out["names"]).first().ticker == "A"
    assert src.key_lists([3, None, 1, 3], 1) == ["permno IN (1)", "permno IN (3)"]


def test_csv_columns_are_read_by_name(spark, tmp_path):
    names = ["PERMNO", "MbrStartDt", "MbrEndDt", "DlyCalDt", "DlyPrc", "DlyRet", "DlyVol", "ShrOut", "DlyCumFacPr", "DlyCumFacShr"]
    values = dict(zip(names, ["1", "2020-01-01", "2020-12-31", "2020-01-02", "5", "0.1", "10", "2", "1", "1"], strict=True))
    for k, order in enumerate((names, names[::-1])):
        row = values | {"PERMNO": str(k + 1)}
        (tmp_path / f"x_membership_prices_{k}.csv").write_text(",".join(order) + "\n" + ",".join(row[c] for c in order) + "\n")
    got = src.prices_of(src.read_combined(spark, str(tmp_path))).collect()
    assert sorted((r.permno, r.prc, r.ret, r.vol) for r in got) == [(1, 5.0, 0.1, 10.0), (2, 5.0, 0.1, 10.0)]
    (tmp_path / "y_membership_prices.csv").write_text("PERMNO\n1\n")
    with pytest.raises(ValueError):
        src.read_combined(spark, str(tmp_path))


def test_csv_ingest_keeps_the_first_row_in_file_order(spark, tmp_path):
    header = "EXTRA,PERMNO,MbrStartDt,MbrEndDt,DlyCalDt,DlyPrc,DlyRet,DlyVol,ShrOut,DlyCumFacPr,DlyCumFacShr\n"
    (tmp_path / "a_membership_prices_1.csv").write_text(header + "x,1,2020-01-01,2020-12-31,2020-01-02,-5,C,10,2,1,1\nx,1,2020-01-01,2020-12-31,2020-01-02,6,0.1,10,2,1,1\n")
    (tmp_path / "b_membership_prices_2.csv").write_text(header + "y,1,2020-01-01,2020-12-31,2020-01-02,7,0.2,10,2,1,1\ny,2,2020-01-01,2020-06-30,2020-01-03,,0.2,B,2,1,1\n")
    (tmp_path / "other.csv").write_text("PERMNO\n9\n")
    out = src.ingest_csv(spark, str(tmp_path), str(tmp_path / "out"))
    prices = {r.permno: r for r in spark.read.parquet(out["prices"]).collect()}
    assert (prices[1].prc, prices[1].ret, prices[1].mkt_cap, prices[1].dollar_vol) == (5.0, None, 10_000.0, 50.0)
    assert prices[2].prc is None and prices[2].vol is None and prices[2].mkt_cap is None
    assert spark.read.parquet(out["membership"]).count() == 2
    with pytest.raises(FileNotFoundError):
        src.read_combined(spark, str(tmp_path / "out"))


def test_remote_queries_push_the_overlap_down():
    q = src.membership_query("2000-01-01", "2001-01-01")
    assert "mbrenddt >= DATE '2000-01-01'" in q and "mbrstartdt <= DATE '2001-01-01'" in q


def test_future_data_does_not_reach_back(spark):
    folder = "/root/testdata/sf0.001"
    daily, spells = src.daily_panel(spark, folder), src.membership_spells(spark, folder)
    cut = "1998-06-30"
    changed = daily.withColumn("ret", F.when(F.col("date") > cut, F.col("ret") * 3).otherwise(F.col("ret")))
    names = ["permno", "date", "mom_1m", "mom_12m_ex1", "realized_vol", "log_mkt_cap"]
    a, b = (ft.filter_to_membership(ft.raw_features(x, 1), spells).where(F.col("date") <= cut).select(*names) for x in (daily, changed))
    assert a.exceptAll(b).count() == 0 and a.count() > 100


def test_results_are_read_in_their_schema(spark, tmp_path):
    from factorspark.plans.pipeline import write_csv
    from factorspark.schemas import IC

    write_csv(spark.createDataFrame([(DAY, 0.5), (dt.date(2020, 2, 29), None)], IC), f"{tmp_path}/ic")
    got = src.read_results(spark, f"{tmp_path}/ic", IC)
    assert got.schema == IC and sorted(got.collect(), key=lambda r: r.date) == [(DAY, 0.5), (dt.date(2020, 2, 29), None)]


def test_months_of_a_stream_equal_the_batch(spark, tmp_path):
    from factorspark.streaming.monthly import daily_stream, monthly_stream

    daily = src.daily_panel(spark, "/root/testdata/sf0.001")
    for i in range(2):
        daily.where(F.col("permno") % 2 == i).write.mode("append").parquet(f"{tmp_path}/in")
    q = monthly_stream(daily_stream(spark, f"{tmp_path}/in", daily.schema)).writeStream.outputMode("complete").format("memory").queryName("months").start()
    q.processAllAvailable()
    q.stop()
    a = spark.table("months").select("permno", "date", "mkt_cap", F.round("avg_dollar_vol", 4), F.round("daily_ret_std", 8))
    b = ft.resample_to_monthly(daily).select("permno", "date", "mkt_cap", F.round("avg_dollar_vol", 4), F.round("daily_ret_std", 8))
    assert a.count() == b.count() > 100 and a.exceptAll(b).count() == 0


def test_figures_need_only_their_data(spark):
    from factorspark.operators import plots

    port = catalogue.port(spark, "/root/testdata/sf0.001")
    points = plots.equity_points(port).toPandas()
    assert set(points.groupby(["construction", "cost"]).size()) == {port.count()}
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            plots.draw_equity(port, "x.png")


def test_semi_join_and_pushdown_in_the_plan(spark):
    plan = catalogue.members(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan


def test_run_writes_every_result(spark, tmp_path):
    from factorspark.plans import pipeline

    folder = "/root/testdata/sf0.001"
    src.daily_panel(spark, folder).write.parquet(f"{tmp_path}/prices.parquet")
    src.membership_spells(spark, folder).write.parquet(f"{tmp_path}/membership.parquet")
    out = pipeline.run(spark, str(tmp_path), f"{tmp_path}/out", pipeline.Settings(model="composite", n_bootstrap=100))
    table = spark.read.option("header", True).csv(out["model_comparison"]).first()
    assert table.model == "composite" and float(table.sharpe_p_value) >= 0
    log = md.sweep(spark, spark.read.parquet(out["feature_panel"]), "max_depth", [1, 2], {"n_estimators": 3, "min_child_weight": 0.1}, train_months=36, step_months=6, horizon=3)
    assert all(r.seconds > 0 and r.model_params["learning_rate"] == "0.01" for r in log.collect())
    md.append_log(log, f"{tmp_path}/log")
    md.append_log(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_tuning_appends_and_equal_configurations_share_a_fit(spark, tmp_path, caplog):
    from factorspark.plans import pipeline

    catalogue.panel(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/panel")
    grid = {"n_estimators": [2], "min_child_weight": [1, 30]}
    with caplog.at_level("INFO", "factorspark"):
        for _ in range(2):
            pipeline.tune(spark, f"{tmp_path}/panel", str(tmp_path), grid, train_months=36, step_months=12)
    rows = spark.read.option("header", True).csv(f"{tmp_path}/tuning_results").collect()
    assert sorted(r.label for r in rows) == ["min_child_weight=1", "min_child_weight=1", "min_child_weight=30", "min_child_weight=30", "n_estimators=2", "n_estimators=2"]
    assert spark.read.parquet(f"{tmp_path}/tuning_log").count() == 6 and "min_child_weight=30" in caplog.text


def test_equal_configurations_share_a_fit(spark):
    same = md.distinct_fits(md.grid_configs())
    assert sum(map(len, same)) == 17 and len(same) == 14
    assert ["max_depth=5", "min_child_weight=30", "subsample=1.0", "colsample_bytree=0.7"] in same
    configs = {"a": {"n_estimators": 2, "min_child_weight": 1}, "b": {"n_estimators": 3, "min_child_weight": 1}, "c": {"min_child_weight": 1.0, "n_estimators": 2}}
    panel = catalogue.panel(spark, "/root/testdata/sf0.001")
    scored = md.run_walk_forward(panel, 36, 1, 12, 3, configs).toPandas()
    by = {k: g.sort_values(["fold", "role", "date", "permno"])["pred"].to_numpy() for k, g in scored.groupby("label")}
    alone = md.run_walk_forward(panel, 36, 1, 12, 3, {"c": configs["c"]}).toPandas().sort_values(["fold", "role", "date", "permno"])["pred"].to_numpy()
    assert (by["a"] == by["c"]).all() and (by["c"] == alone).all() and not (by["a"] == by["b"]).all()


def test_long_lists_share_one_table_of_gaps():
    """Dates of many and different sizes: what a fit keeps beside its rows is one table, and a byte a value."""
    import tracemalloc

    from factorspark.operators.lambdamart import PAIRS_OF_TOP, Bins, Lists

    rng = np.random.default_rng(8)
    starts = np.concatenate([[0], np.cumsum(5_000 + np.arange(30))])
    label, x = rng.integers(0, 10, starts[-1]).astype(float), rng.normal(size=(starts[-1], 3))
    tracemalloc.start()
    lists, bins = Lists(label, starts), Bins(x)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(lists.parts) == 30 and bins.own.nbytes == x.size
    assert held < 2 * 8 * PAIRS_OF_TOP * 5_029 + 2 * label.nbytes


def test_rows_in_bins_go_where_their_values_go():
    from factorspark.operators.lambdamart import Bins

    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 3)), 1)  # many values equal to a cut
    bins = Bins(x)
    model = Ranker(min_child_weight=0.1, learning_rate=0.1, n_estimators=5, subsample=0.6).fit(None, rng.integers(0, 10, 400).astype(float), np.arange(0, 401, 100), bins)
    assert all((t.predict(x) == t.predict_binned(bins.own)).all() for t in model.trees) and (model.fitted == model.predict(x)).all()
    assert len({len(t.value) for t in model.trees} - {1})


def test_correlations_of_a_walk_are_those_of_its_rows(spark, monkeypatch):
    """A sweep keeps a row for each date, fold and configuration, whatever the number of entities."""
    configs = {"a": {"n_estimators": 3, "min_child_weight": 0.1}, "b": {"n_estimators": 3, "min_child_weight": 0.1, "subsample": 0.6}, "flat": {"n_estimators": 0}}
    panel = catalogue.panel(spark, "/root/testdata/sf0.001").persist()
    rows = md.run_walk_forward(panel, 36, 1, 12, 3, configs)
    want = {tuple(r)[:4]: r.ic for r in information_coefficient(rows, ["label", "fold", "role", "date"]).collect()}
    for sent in (md.SENT_ROWS, 1):  # several slices, and one
        monkeypatch.setattr(md, "SENT_ROWS", sent)
        got = {tuple(r)[:4]: r.ic for r in md.walk_forward_ics(panel, 36, 1, 12, 3, configs).collect()}
        assert got.keys() == want.keys() and len(got) > 100
        assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-12 for k, v in want.items())
        assert {got[k] for k in got if k[0] == "flat"} == {None}
    panel.unpersist()


def test_sharpe_intervals(spark):
    from factorspark.operators import plots

    table = spark.createDataFrame([("m", 0.1, 0.9, 0.02, 0.0, 0.8, 0.04)], "model string, sharpe_ci_low double, sharpe_ci_high double, sharpe_p_value double, sharpe_net_ci_low double, sharpe_net_ci_high double, sharpe_net_p_value double")
    assert [tuple(r) for r in plots.sharpe_intervals(table, "model").collect()] == [("m", "gross", 0.1, 0.9, 0.02), ("m", "net", 0.0, 0.8, 0.04)]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def flat(df):
        out = df[sorted(df.columns)].copy()
        for c in out:
            if str(out[c].dtype).startswith("datetime") or out[c].map(lambda v: isinstance(v, dt.date)).any():
                out[c] = pd.to_datetime(out[c])
        return out.sort_values(list(out.columns)).reset_index(drop=True)

    a, b = flat(got), flat(want)
    for c in a:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-8, rtol=1e-9, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
