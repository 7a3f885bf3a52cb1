"""The queries of the engine over the star-schema adapter, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.operators import backtest as bt
from factorspark.operators import evaluate as ev
from factorspark.operators import features as ft
from factorspark.operators import folds as fo
from factorspark.operators import models as md
from factorspark.operators import plots
from factorspark.operators.bootstrap import bootstrap_sharpe
from factorspark.schemas import FEATURES
from factorspark.sources import panel as src

HORIZON, TRAIN, STEP, FREQ, BPS = 3, 36, 3, 4.0, 20.0
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Far below the last digit kept: products of two-decimal returns are often exact ties, which noise would round either way.
NUDGE = 1e-11


def rounded(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Doubles to fixed decimals, so that the last bits of sums in another order do not count."""
    return df.select(*[F.round(F.col(c) + NUDGE, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def daily(s, d):
    return src.daily_panel(s, d)


def spells(s, d):
    return src.membership_spells(s, d)


def panel(s, d):
    return ft.build_feature_panel(daily(s, d), spells(s, d), HORIZON)


def members(s, d):
    return ft.filter_to_membership(ft.raw_features(daily(s, d), HORIZON), spells(s, d))


def composite(s, d):
    return md.composite(panel(s, d))


def deciled(s, d):
    return bt.assign_deciles(composite(s, d))


def port(s, d):
    return bt.final_returns(composite(s, d), BPS)


#: The panel that the last query kept.
_HELD: list[DataFrame] = []


def shared_panel(s, d):
    """The panel where a query reads it several times. One is kept at a time: the next query releases it."""
    while _HELD:
        _HELD.pop().unpersist()
    _HELD.append(panel(s, d).persist())
    return _HELD[0]


def splits(p):
    return fo.walk_forward_splits(p, TRAIN, 1, STEP, fo.embargo(HORIZON))


def weighted(s, d):
    p = shared_panel(s, d)
    return md.ic_weighted(p, splits(p))


def two_models(s, d):
    p = shared_panel(s, d)
    test = md.predictions(md.ic_weighted(p, splits(p))).withColumn("model", F.lit("ic_weighted"))
    return md.composite(p).withColumn("model", F.lit("composite")).unionByName(test)


# ---------------------------------------------------------------------------------------------------------------
# SQL building blocks, each a named relation over those before it.
# ---------------------------------------------------------------------------------------------------------------


def _per_feature(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(f=f) for f in FEATURES)


SIGNED = " + ".join(f"{f}_z * {s:.1f}" for f, s in md.SIGNS.items())


@lru_cache(maxsize=1)
def relations() -> dict[str, str]:
    return {
        "daily_raw": """
    SELECT CAST(l_suppkey AS INTEGER) AS permno, CAST(l_shipdate AS DATE) AS date,
      (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice / l_quantity AS prc,
      CASE WHEN l_linenumber <> 7 THEN l_discount - CAST(0.05 AS DOUBLE) END AS ret, l_quantity * 100 AS vol,
      CAST(1000.0 AS DOUBLE) + 10 * (l_suppkey % 97) AS shrout, CAST(1.0 AS DOUBLE) AS cfacpr, CAST(1.0 AS DOUBLE) AS cfacshr,
      row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth
    FROM lineitem""",
        "daily": "SELECT permno, date, abs(prc) AS prc, ret, vol, shrout, cfacpr, cfacshr, abs(prc) * shrout * 1000 AS mkt_cap, abs(prc) * vol AS dollar_vol FROM daily_raw WHERE nth = 1",
        "spells": """
    SELECT DISTINCT * FROM (
      SELECT CAST(s_suppkey AS INTEGER) AS permno, CAST(DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INTEGER)) AS DATE) AS start,
        CASE WHEN s_suppkey % 5 = 0 THEN DATE '1998-12-31' ELSE DATE '2001-12-31' END AS ending FROM supplier
      UNION ALL SELECT CAST(s_suppkey AS INTEGER), DATE '1999-07-01', DATE '2001-12-31' FROM supplier WHERE s_suppkey % 5 = 0
      UNION ALL SELECT CAST(s_suppkey AS INTEGER), DATE '1996-01-01', DATE '1997-12-31' FROM supplier WHERE s_suppkey % 11 = 0)""",
        "indexed": "SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY permno ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum_ret_index FROM daily",
        "monthly": """
    SELECT permno, last_day(date) AS date, arg_max(cum_ret_index, date) AS cum_ret_index, arg_max(mkt_cap, date) FILTER (mkt_cap IS NOT NULL) AS mkt_cap,
      avg(dollar_vol) AS avg_dollar_vol, stddev_samp(ret) AS daily_ret_std FROM indexed GROUP BY ALL""",
        "feats": """
    SELECT *, daily_ret_std AS realized_vol, ln(greatest(mkt_cap, 1)) AS log_mkt_cap, ln(greatest(avg_dollar_vol, 1)) AS log_dollar_vol,
      cum_ret_index / nullif(lag(cum_ret_index) OVER w, 0) - 1 AS mom_1m, cum_ret_index / nullif(lag(cum_ret_index, 3) OVER w, 0) - 1 AS mom_3m,
      lag(cum_ret_index) OVER w / nullif(lag(cum_ret_index, 12) OVER w, 0) - 1 AS mom_12m_ex1,
      lead(cum_ret_index) OVER w / nullif(cum_ret_index, 0) - 1 AS fwd_ret_1, lead(cum_ret_index, 3) OVER w / nullif(cum_ret_index, 0) - 1 AS fwd_ret
    FROM monthly WINDOW w AS (PARTITION BY permno ORDER BY date)""",
        "members": "SELECT * FROM feats f WHERE EXISTS (SELECT 1 FROM spells s WHERE s.permno = f.permno AND f.date BETWEEN s.start AND s.ending)",
        "limits": "SELECT date, " + _per_feature("quantile_cont({f}, CAST(0.01 AS DOUBLE)) AS {f}_lo, quantile_cont({f}, CAST(0.99 AS DOUBLE)) AS {f}_hi") + " FROM members GROUP BY date",
        "wins": "SELECT m.*, " + _per_feature("CASE WHEN {f} IS NOT NULL THEN greatest(least({f}, {f}_hi), {f}_lo) END AS {f}_w") + " FROM members m JOIN limits USING (date)",
        "moments": "SELECT date, " + _per_feature("avg({f}_w) AS {f}_m, stddev_samp({f}_w) AS {f}_s") + " FROM wins GROUP BY date",
        "scaled": "SELECT w.*, " + _per_feature("CASE WHEN {f}_s > 0 THEN ({f}_w - {f}_m) / {f}_s END AS {f}_z") + " FROM wins w JOIN moments USING (date)",
        "panel": "SELECT * FROM scaled WHERE fwd_ret IS NOT NULL AND " + _per_feature("{f}_z IS NOT NULL", " AND "),
        "preds": f"SELECT date, permno, fwd_ret, round(({SIGNED}) / 6, 10) AS pred FROM panel",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, permno) AS r, count(*) OVER (PARTITION BY date) AS n FROM preds",
        "dec": "SELECT *, CASE WHEN n > 1 THEN CAST(greatest(0, ceil(10 * (r - 1) / CAST(n - 1 AS DOUBLE)) - 1) AS INTEGER) END AS decile FROM ranked",
        "legs": "SELECT date, long_ret, short_ret, long_ret - short_ret AS ls_ret FROM (SELECT date, avg(fwd_ret) FILTER (decile = 9) AS long_ret, avg(fwd_ret) FILTER (decile = 0) AS short_ret FROM dec GROUP BY date) WHERE long_ret IS NOT NULL AND short_ret IS NOT NULL",
        "held": "SELECT decile, date, list_sort(list(permno)) AS held FROM dec WHERE decile IN (0, 9) GROUP BY ALL",
        "held_before": "SELECT *, lag(held) OVER (PARTITION BY decile ORDER BY date) AS before FROM held",
        "turn": "SELECT decile, date, len(list_filter(held, lambda x: NOT list_contains(before, x))) / CAST(greatest(len(held), 1) AS DOUBLE) AS turnover FROM held_before WHERE before IS NOT NULL",
        "costed": """
    SELECT l.*, coalesce(a.turnover, 1) + coalesce(b.turnover, 1) AS turnover_combined, (coalesce(a.turnover, 1) + coalesce(b.turnover, 1)) * CAST(0.002 AS DOUBLE) AS cost_drag,
      ls_ret - (coalesce(a.turnover, 1) + coalesce(b.turnover, 1)) * CAST(0.002 AS DOUBLE) AS ls_ret_net, long_ret - coalesce(a.turnover, 1) * CAST(0.002 AS DOUBLE) AS long_ret_net
    FROM legs l LEFT JOIN turn a ON a.date = l.date AND a.decile = 9 LEFT JOIN turn b ON b.date = l.date AND b.decile = 0""",
        "days": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM panel)",
        "starts": f"SELECT unnest(range({TRAIN}, (SELECT count(*) FROM days), {STEP})) AS i",
        "splits": f"""
    SELECT CAST((i - {TRAIN}) / {STEP} AS INTEGER) AS fold, CASE WHEN idx = i THEN 'test' ELSE 'train' END AS role, date
    FROM starts JOIN days ON idx = i OR (idx >= greatest(0, i - {HORIZON - 1} - {TRAIN}) AND idx < i - {HORIZON - 1})""",
        "good": """
    SELECT fold FROM splits JOIN panel USING (date) GROUP BY fold HAVING count(*) FILTER (role = 'train') >= 100 AND count(*) FILTER (role = 'test') > 0""",
        "long_z": " UNION ALL ".join(f"SELECT date, '{f}' AS feature, {f}_z AS z, fwd_ret FROM panel" for f in FEATURES),
        "rank_z": """
    SELECT date, feature, rank() OVER (PARTITION BY date, feature ORDER BY round(z, 10)) + (count(*) OVER (PARTITION BY date, feature, round(z, 10)) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY date, feature ORDER BY round(fwd_ret, 10)) + (count(*) OVER (PARTITION BY date, feature, round(fwd_ret, 10)) - 1) / 2.0 AS b FROM long_z""",
        "ic_z": "SELECT date, feature, CASE WHEN count(*) >= 2 THEN covar_samp(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) / nullif(stddev_samp(CAST(a AS DOUBLE)) * stddev_samp(CAST(b AS DOUBLE)), 0) END AS ic FROM rank_z GROUP BY ALL",
        "w": "SELECT fold, " + _per_feature("coalesce(avg(ic) FILTER (feature = '{f}'), 0) AS w_{f}") + " FROM splits JOIN ic_z USING (date) WHERE role = 'train' AND fold IN (FROM good) GROUP BY fold",
        "wf": "SELECT s.fold, s.role, p.date, permno, fwd_ret, round(" + _per_feature("w_{f} * {f}_z", " + ") + ", 10) AS pred FROM panel p JOIN splits s USING (date) JOIN w USING (fold)",
        "wf_rank": """
    SELECT fold, role, date, rank() OVER (PARTITION BY fold, role, date ORDER BY pred) + (count(*) OVER (PARTITION BY fold, role, date, pred) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY fold, role, date ORDER BY round(fwd_ret, 10)) + (count(*) OVER (PARTITION BY fold, role, date, round(fwd_ret, 10)) - 1) / 2.0 AS b FROM wf""",
        "wf_ic": "SELECT fold, role, date, CASE WHEN count(*) >= 2 THEN covar_samp(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) / nullif(stddev_samp(CAST(a AS DOUBLE)) * stddev_samp(CAST(b AS DOUBLE)), 0) END AS ic FROM wf_rank GROUP BY ALL",
        "ranks": """
    SELECT date, permno, pred, rank() OVER (PARTITION BY date ORDER BY pred) + (count(*) OVER (PARTITION BY date, pred) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY date ORDER BY round(fwd_ret, 10)) + (count(*) OVER (PARTITION BY date, round(fwd_ret, 10)) - 1) / 2.0 AS b FROM preds""",
        "ic": "SELECT date, CASE WHEN count(*) >= 2 THEN covar_samp(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) / nullif(stddev_samp(CAST(a AS DOUBLE)) * stddev_samp(CAST(b AS DOUBLE)), 0) END AS ic FROM ranks GROUP BY date",
        "target_limits": "SELECT date, quantile_cont(fwd_ret, CAST(0.01 AS DOUBLE)) AS lo, quantile_cont(fwd_ret, CAST(0.99 AS DOUBLE)) AS hi FROM panel GROUP BY date",
        "targets": "SELECT date, permno, greatest(least(fwd_ret, hi), lo) AS target_w FROM panel JOIN target_limits USING (date)",
        "edges": "SELECT date, list_sort(list_distinct(quantile_cont(target_w, [" + ", ".join(f"CAST({k / 10} AS DOUBLE)" for k in range(11)) + "]))) AS e FROM targets GROUP BY date",
        "labels_": "SELECT date, permno, target_w, CASE WHEN len(e) > 1 THEN greatest(len(list_filter(e, lambda x: x < target_w)) - 1, 0) END AS label FROM targets JOIN edges USING (date)",
    }


def curve(ret: str, rel: str = "costed", keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    w = f"({part}ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"SELECT *, (wealth - peak) / nullif(peak, 0) AS drawdown FROM (SELECT *, max(wealth) OVER {w} AS peak FROM (SELECT *, product(1 + {ret}) OVER {w} AS wealth FROM {rel}))"


def summary(ret: str, freq: float, rel: str = "costed", keys: str = "", suffix: str = "") -> str:
    f = f"CAST({freq} AS DOUBLE)"
    k, g = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {k}avg({ret}) * {f} AS ann_return{suffix}, stddev_samp({ret}) * sqrt({f}) AS ann_vol{suffix}, avg({ret}) * {f} / nullif(stddev_samp({ret}) * sqrt({f}), 0) AS sharpe{suffix}, min(drawdown) AS max_drawdown{suffix}, CAST(count(*) AS INTEGER) AS n_periods FROM ({curve(ret, rel, keys)}){g}"


def sql(select: str, **more: str) -> str:
    rel = relations() | more
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in rel.items()) + "\n" + select


def query(name: str, oracle: str | None = None, **more: str):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **more)
        return f

    return register


def R(*columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c} + 1e-11, {digits}) AS {c}" for c in columns)


DAILY_COLUMNS = "permno, date, round(prc + 1e-11, 6) AS prc, round(ret + 1e-11, 6) AS ret, vol, shrout, cfacpr, cfacshr, round(mkt_cap + 1e-11, 2) AS mkt_cap, round(dollar_vol + 1e-11, 4) AS dollar_vol"


@query("q01_daily_clean", f"SELECT {DAILY_COLUMNS} FROM daily")
def q01(s, d):
    return rounded(daily(s, d), 6, mkt_cap=2, dollar_vol=4)


@query("q02_membership_spells", "SELECT * FROM spells")
def q02(s, d):
    return spells(s, d)


@query("q03_membership_overlap_scan", "SELECT * FROM spells WHERE ending >= DATE '1996-06-01' AND start <= DATE '1996-09-30'")
def q03(s, d):
    return src.overlapping_spells(spells(s, d), "1996-06-01", "1996-09-30")


@query("q04_universe_stats", "SELECT count(DISTINCT permno) AS n_entities, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM daily")
def q04(s, d):
    return daily(s, d).agg(F.countDistinct("permno").alias("n_entities"), F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("q05_price_key_restriction", f"SELECT {DAILY_COLUMNS} FROM daily WHERE permno IN (SELECT permno FROM spells WHERE ending <= DATE '1999-01-01') AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def q05(s, d):
    rows = daily(s, d).where(F.col("date").between("1997-01-01", "1997-12-31"))
    return rounded(src.restrict_to(rows, spells(s, d).where("ending <= date'1999-01-01'")), 6, mkt_cap=2, dollar_vol=4)


@query("q06_name_map_asof_label", "SELECT p.date, p.permno, 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS comnam, round(pred + 1e-11, 8) AS pred FROM dec p JOIN supplier ON s_suppkey = p.permno WHERE decile = 9 AND p.date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'")
def q06(s, d):
    n = src.name_map(s, d)
    rows = deciled(s, d).where("decile = 9").join(n, "permno").where(F.col("date").between(F.col("namedt"), F.col("nameenddt")))
    return rounded(rows.select("date", "permno", "ticker", "comnam", "pred"))


@query("q07_cum_return_index", "SELECT permno, date, round(cum_ret_index + 1e-11, 8) AS cum_ret_index FROM indexed")
def q07(s, d):
    return rounded(ft.with_return_index(daily(s, d)).select("permno", "date", "cum_ret_index"))


@query("q08_monthly_resample", f"SELECT permno, date, {R('cum_ret_index', 'daily_ret_std')}, round(mkt_cap + 1e-11, 2) AS mkt_cap, round(avg_dollar_vol + 1e-11, 4) AS avg_dollar_vol FROM monthly")
def q08(s, d):
    return rounded(ft.resample_to_monthly(daily(s, d)), 8, mkt_cap=2, avg_dollar_vol=4)


@query("q09_momentum", f"SELECT permno, date, {R('mom_1m', 'mom_3m', 'mom_12m_ex1')} FROM feats")
def q09(s, d):
    return rounded(ft.add_momentum(ft.resample_to_monthly(daily(s, d))).select("permno", "date", "mom_1m", "mom_3m", "mom_12m_ex1"))


@query("q10_realized_vol", f"SELECT permno, date, {R('realized_vol')} FROM feats")
def q10(s, d):
    return rounded(ft.add_volatility(ft.resample_to_monthly(daily(s, d))).select("permno", "date", "realized_vol"))


@query("q11_size_liquidity", f"SELECT permno, date, {R('log_mkt_cap', 'log_dollar_vol')} FROM feats")
def q11(s, d):
    return rounded(ft.add_size_and_liquidity(ft.resample_to_monthly(daily(s, d))).select("permno", "date", "log_mkt_cap", "log_dollar_vol"))


@query("q12_fwd_ret_h1", "SELECT permno, date, round(fwd_ret_1 + 1e-11, 8) AS fwd_ret FROM feats")
def q12(s, d):
    return rounded(ft.add_forward_return(ft.resample_to_monthly(daily(s, d)), 1).select("permno", "date", "fwd_ret"))


@query("q13_fwd_ret_h3", f"SELECT permno, date, {R('fwd_ret')} FROM feats")
def q13(s, d):
    return rounded(ft.add_forward_return(ft.resample_to_monthly(daily(s, d)), 3).select("permno", "date", "fwd_ret"))


@query("q14_pit_filter", f"SELECT permno, date, {R('cum_ret_index')} FROM members")
def q14(s, d):
    return rounded(ft.filter_to_membership(ft.resample_to_monthly(daily(s, d)), spells(s, d)).select("permno", "date", "cum_ret_index"))


@query("q15_pit_members_per_date", "SELECT date, count(*) AS n FROM members GROUP BY date")
def q15(s, d):
    return ft.filter_to_membership(ft.resample_to_monthly(daily(s, d)), spells(s, d)).groupBy("date").agg(F.count("*").alias("n"))


@query("q16_winsorized", f"SELECT permno, date, {R(*[f'{f}_w' for f in FEATURES])} FROM wins")
def q16(s, d):
    return rounded(ft.winsorized(members(s, d), list(FEATURES)).select("permno", "date", *[f"{f}_w" for f in FEATURES]))


@query("q17_zscores", f"SELECT permno, date, {R(*[f'{f}_z' for f in FEATURES], digits=7)} FROM scaled")
def q17(s, d):
    return rounded(ft.cross_sectional_normalize(members(s, d)).select("permno", "date", *[f"{f}_z" for f in FEATURES]), 7)


PANEL_COLUMNS = ("permno", "date", *FEATURES, "fwd_ret", *[f"{f}_z" for f in FEATURES])


@query("q18_feature_panel", f"SELECT permno, date, {R(*PANEL_COLUMNS[2:], digits=7)} FROM panel")
def q18(s, d):
    return rounded(panel(s, d).select(*PANEL_COLUMNS), 7)


@query("q19_qcut_labels", f"SELECT date, permno, {R('target_w')}, CAST(label AS INTEGER) AS label FROM labels_")
def q19(s, d):
    return rounded(md.training_labels(panel(s, d)).select("date", "permno", "target_w", "label"))


@query("q20_deciles", "SELECT date, permno, round(pred + 1e-11, 8) AS pred, decile FROM dec")
def q20(s, d):
    return rounded(deciled(s, d).select("date", "permno", "pred", "decile"))


@query("q21_decile_sizes", "SELECT date, decile, count(*) AS n FROM dec GROUP BY ALL")
def q21(s, d):
    return deciled(s, d).groupBy("date", "decile").agg(F.count("*").alias("n"))


@query("q22_avg_rank", "SELECT date, permno, CAST(a AS DOUBLE) AS pred_rank, CAST(b AS DOUBLE) AS ret_rank FROM ranks")
def q22(s, d):
    from factorspark.functions.xsection import average_rank

    return composite(s, d).select("date", "permno", average_rank(F.col("pred"), ["date"]).alias("pred_rank"), average_rank(F.round("fwd_ret", 10), ["date"]).alias("ret_rank"))


@query("q23_ic_by_date", f"SELECT date, {R('ic')} FROM ic")
def q23(s, d):
    return rounded(ev.information_coefficient(composite(s, d), ["date"]))


@query("q24_ic_summary", "SELECT round(avg(ic) + 1e-11, 8) AS ic_mean, round(stddev_samp(ic) + 1e-11, 8) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0) + 1e-11, 7) AS ic_ir, count(*) AS n_dates FROM ic")
def q24(s, d):
    return rounded(ev.summarize_ic(ev.information_coefficient(composite(s, d), ["date"])), 8, ic_ir=7)


@query("q25_fold_table", f"""SELECT CAST((i - {TRAIN}) / {STEP} AS INTEGER) AS fold, CASE WHEN idx = i THEN 'test' ELSE 'train' END AS role, date
    FROM starts JOIN days ON idx BETWEEN i - {TRAIN} AND i""")
def q25(s, d):
    return fo.walk_forward_splits(panel(s, d), TRAIN, 1, STEP, 0)


@query("q26_fold_table_embargo", "SELECT * FROM splits")
def q26(s, d):
    return splits(panel(s, d))


@query("q27_train_labels_by_fold", "SELECT fold, CAST(label AS INTEGER) AS label, count(*) AS n, round(avg(target_w) + 1e-11, 8) AS mean_target FROM labels_ JOIN splits USING (date) WHERE role = 'train' AND fold IN (FROM good) GROUP BY ALL")
def q27(s, d):
    p = shared_panel(s, d)
    rows = md.training_labels(p).join(md.usable_folds(p, splits(p)).where("role = 'train'"), "date")
    return rounded(rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.avg("target_w").alias("mean_target")))


@query("q28_wf_ic_weighted_preds", "SELECT fold, date, permno, round(fwd_ret + 1e-11, 8) AS fwd_ret, round(pred + 1e-11, 8) AS pred FROM wf WHERE role = 'test'")
def q28(s, d):
    return rounded(weighted(s, d).where("role = 'test'").select("fold", "date", "permno", "fwd_ret", "pred"))


@query("q29_fold_diagnostics", """
    SELECT a.*, round(ins + 1e-11, 6) AS in_sample_ic, round(oos + 1e-11, 6) AS oos_ic, round(ins - oos + 1e-11, 6) AS gap FROM (
      SELECT fold, min(date) FILTER (role = 'train') AS train_start, max(date) FILTER (role = 'train') AS train_end,
        CAST(count(DISTINCT date) FILTER (role = 'train') AS INTEGER) AS n_train_months, count(*) FILTER (role = 'train') AS n_train_rows,
        min(date) FILTER (role = 'test') AS test_start, max(date) FILTER (role = 'test') AS test_end FROM wf GROUP BY fold) a
    JOIN (SELECT fold, avg(ic) FILTER (role = 'train') AS ins, avg(ic) FILTER (role = 'test') AS oos FROM wf_ic GROUP BY fold) b USING (fold)""")
def q29(s, d):
    return rounded(md.diagnostics(weighted(s, d)), 6)


@query("q30_leg_returns", f"SELECT date, {R('long_ret', 'short_ret', 'ls_ret')} FROM legs")
def q30(s, d):
    return rounded(bt.portfolio_returns(deciled(s, d)))


@query("q31_turnover_long", f"SELECT date, {R('turnover')} FROM turn WHERE decile = 9")
def q31(s, d):
    return rounded(bt.turnover(deciled(s, d), bt.TOP))


@query("q32_turnover_short", f"SELECT date, {R('turnover')} FROM turn WHERE decile = 0")
def q32(s, d):
    return rounded(bt.turnover(deciled(s, d), bt.BOTTOM))


@query("q33_costed_returns", f"SELECT date, {R('long_ret', 'short_ret', 'ls_ret', 'turnover_combined', 'cost_drag', 'ls_ret_net', 'long_ret_net')} FROM costed")
def q33(s, d):
    dec = deciled(s, d)
    return rounded(bt.apply_transaction_costs(bt.portfolio_returns(dec), dec, BPS))


EQUITY = " UNION ALL ".join(f"SELECT '{c}' AS construction, '{k}' AS cost, date, {r} AS ret FROM costed" for c, k, r in (("long_short", "gross", "ls_ret"), ("long_short", "net", "ls_ret_net"), ("long_only", "gross", "long_ret"), ("long_only", "net", "long_ret_net")))


@query("q34_equity_curve", f"SELECT construction, cost, date, {R('wealth', 'drawdown')} FROM ({curve('ret', 'curves', 'construction, cost')})", curves=EQUITY)
def q34(s, d):
    return rounded(plots.equity_points(port(s, d)))


@query("q35_drawdown", f"SELECT date, {R('wealth', 'peak', 'drawdown')} FROM ({curve('ls_ret')})")
def q35(s, d):
    return rounded(bt.equity_curve(port(s, d)))


PERF = R("ann_return", "ann_vol", "sharpe", "max_drawdown", digits=7) + ", n_periods"


@query("q36_performance_gross", f"SELECT {PERF} FROM ({summary('ls_ret', FREQ)})")
def q36(s, d):
    return rounded(bt.performance_summary(port(s, d), FREQ), 7)


@query("q37_performance_net", f"SELECT {PERF} FROM ({summary('ls_ret_net', FREQ)})")
def q37(s, d):
    return rounded(bt.performance_summary(port(s, d), FREQ, "ls_ret_net"), 7)


def _model_sql() -> tuple[str, dict[str, str]]:
    """compare_models over the two models: the single-model relations again, with the model as a key."""
    r = relations()
    more = {"preds2": "SELECT 'composite' AS model, * FROM preds UNION ALL SELECT 'ic_weighted', date, permno, fwd_ret, pred FROM wf WHERE role = 'test'"}
    for name, old in (("ranked", "preds"), ("dec", "ranked"), ("legs", "dec"), ("held", "dec"), ("held_before", "held"), ("turn", "held_before")):
        q = r[name].replace(f"FROM {old}", f"FROM {old}2").replace("PARTITION BY date", "PARTITION BY model, date").replace("PARTITION BY decile", "PARTITION BY model, decile").replace("GROUP BY date", "GROUP BY model, date")
        more[f"{name}2"] = q.replace("SELECT date", "SELECT model, date").replace("SELECT decile", "SELECT model, decile")
    more["costed2"] = r["costed"].replace("FROM legs l", "FROM legs2 l").replace("JOIN turn a ON", "JOIN turn2 a ON a.model = l.model AND").replace("JOIN turn b ON", "JOIN turn2 b ON b.model = l.model AND")
    gross, net = summary("ls_ret", FREQ, "costed2", "model"), summary("ls_ret_net", FREQ, "costed2", "model", "_net")
    out = R("ann_return", "ann_vol", "sharpe", "max_drawdown", "ann_return_net", "sharpe_net", "max_drawdown_net", "turnover_mean", digits=7)
    return f"SELECT model, {out}, a.n_periods, CAST({BPS} AS DOUBLE) AS cost_bps FROM ({gross}) a JOIN ({net}) b USING (model) JOIN (SELECT model, avg(turnover) AS turnover_mean FROM turn2 WHERE decile = 9 GROUP BY model) c USING (model)", more


_select, _more = _model_sql()


@query("q38_compare_models", _select, **_more)
def q38(s, d):
    return rounded(bt.compare_models(two_models(s, d), FREQ, BPS), 7)


@query("q39_compare_constructions", f"""SELECT construction, {R('ann_return', 'ann_vol', 'sharpe', 'max_drawdown', 'ann_return_net', 'sharpe_net', 'max_drawdown_net', 'turnover_mean', digits=7)}, a.n_periods, CAST({BPS} AS DOUBLE) AS cost_bps
    FROM ({summary('gross', FREQ, 'pairs', 'construction')}) a JOIN ({summary('net', FREQ, 'pairs', 'construction', '_net')}) b USING (construction)
    JOIN (SELECT 'long_short' AS construction, avg(x.turnover + y.turnover) AS turnover_mean FROM (FROM turn WHERE decile = 9) x FULL JOIN (FROM turn WHERE decile = 0) y USING (date)
      UNION ALL SELECT 'long_only', avg(turnover) FROM turn WHERE decile = 9) c USING (construction)""",
    pairs="SELECT 'long_short' AS construction, date, ls_ret AS gross, ls_ret_net AS net FROM costed UNION ALL SELECT 'long_only', date, long_ret, long_ret_net FROM costed")
def q39(s, d):
    return rounded(bt.compare_constructions(composite(s, d), FREQ, BPS), 7)


@query("q40_holdings_diff", "SELECT date, len(held) AS n_held, len(list_filter(held, lambda x: NOT list_contains(before, x))) AS n_added, list_sum(list_filter(held, lambda x: NOT list_contains(before, x))) AS added_sum FROM held_before WHERE decile = 9 AND before IS NOT NULL")
def q40(s, d):
    rows = bt.holdings(deciled(s, d), bt.TOP).where("added is not null")
    total = F.when(F.size("added") > 0, F.aggregate("added", F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.select("date", F.size("held").cast("long").alias("n_held"), F.size("added").cast("long").alias("n_added"), total.alias("added_sum"))


@query("q41_bootstrap_sharpe")
def q41(s, d):
    return bootstrap_sharpe(port(s, d), "ls_ret", freq=FREQ)


@query("q42_wf_lambdamart")
def q42(s, d):
    rows = md.run_walk_forward(shared_panel(s, d), TRAIN, 1, STEP, HORIZON, {"default": {"min_child_weight": 1.0}})
    return md.predictions(rows)


@query("q43_sweep")
def q43(s, d):
    """All 17 configurations of the grid, each with its own parameters and the model's defaults, in one job."""
    configs = md.grid_configs()
    return md.log_of(s, shared_panel(s, d), configs, train_months=TRAIN, step_months=STEP, horizon=HORIZON)


@query("q44_tuning_log_shape", """
    SELECT CAST(count(*) AS INTEGER) AS n_folds, round(avg(oos) + 1e-11, 6) AS oos_ic_mean, round(stddev_samp(oos) + 1e-11, 6) AS oos_ic_std, round(avg(ins) + 1e-11, 6) AS in_sample_ic_mean, round(avg(ins - oos) + 1e-11, 6) AS gap_mean,
      array_to_string(list_transform(list(oos ORDER BY fold), lambda x: printf('%.4f', round(x, 4))), ',') AS per_fold_oos_ic
    FROM (SELECT fold, avg(ic) FILTER (role = 'train') AS ins, avg(ic) FILTER (role = 'test') AS oos FROM wf_ic GROUP BY fold)""")
def q44(s, d):
    log = md.tuning_log(s, weighted(s, d).withColumn("label", F.lit("ic_weighted")), {"ic_weighted": {}})
    text = F.array_join(F.transform("per_fold_oos_ic", lambda x: F.format_string("%.4f", x)), ",")
    return rounded(log.select("n_folds", "oos_ic_mean", "oos_ic_std", "in_sample_ic_mean", "gap_mean", text.alias("per_fold_oos_ic")), 6)


@query("q45_comparison_points", " UNION ALL ".join(f"SELECT construction, '{m}' AS metric, {m} AS gross, {net} AS net FROM compared" for m, net in [*((m, f"{m}_net") for m in plots.METRICS), ("turnover_mean", "CAST(NULL AS DOUBLE)")]),
    compared=ORACLES["q39_compare_constructions"])
def q45(s, d):
    return rounded(plots.comparison_points(bt.compare_constructions(composite(s, d), FREQ, BPS), "construction"), 7)


@query("q46_ic_series", "SELECT date, round(ic + 1e-11, 8) AS ic, round(avg(ic) OVER () + 1e-11, 8) AS ic_mean FROM ic")
def q46(s, d):
    return rounded(plots.ic_series(ev.information_coefficient(composite(s, d), ["date"])))


@query("q47_final_returns", f"SELECT date, {R('long_ret', 'short_ret', 'ls_ret', 'turnover_combined', 'cost_drag', 'ls_ret_net', 'long_ret_net')} FROM costed")
def q47(s, d):
    return rounded(bt.final_returns(composite(s, d), BPS))


@query("q48_compare_with_bootstrap")
def q48(s, d):
    """The comparison of constructions with all its columns: 10,000 seeded draws for each series."""
    return rounded(bt.compare_constructions(composite(s, d), FREQ, BPS, n_bootstrap=10_000), 7)


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship plan: daily rows to leg returns of the composite's deciles."""
    return rounded(bt.portfolio_returns(deciled(spark, folder)))
