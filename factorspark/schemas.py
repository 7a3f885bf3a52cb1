"""Fixed schemas of the tables that the engine reads and writes. Missing values are NULL, never NaN."""

from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _table(**columns) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


_I, _L, _D, _S, _DT = IntegerType(), LongType(), DoubleType(), StringType(), DateType()

MEMBERSHIP = _table(permno=_I, start=_DT, ending=_DT)
DAILY = _table(permno=_I, date=_DT, prc=_D, ret=_D, vol=_D, shrout=_D, cfacpr=_D, cfacshr=_D, mkt_cap=_D, dollar_vol=_D)
#: Column names of the combined export files, a fixed input format, and the names used here.
RAW_COLUMNS = {
    "PERMNO": "permno",
    "MbrStartDt": "start",
    "MbrEndDt": "ending",
    "DlyCalDt": "date",
    "DlyPrc": "prc",
    "DlyRet": "ret",
    "DlyVol": "vol",
    "ShrOut": "shrout",
    "DlyCumFacPr": "cfacpr",
    "DlyCumFacShr": "cfacshr",
}
NAMES = _table(permno=_I, ticker=_S, comnam=_S, namedt=_DT, nameenddt=_DT)
MONTHLY = _table(permno=_I, date=_DT, cum_ret_index=_D, mkt_cap=_D, avg_dollar_vol=_D, daily_ret_std=_D)
PREDICTIONS = _table(date=_DT, permno=_I, fwd_ret=_D, pred=_D)
IC = _table(date=_DT, ic=_D)
PORTFOLIO = _table(date=_DT, long_ret=_D, short_ret=_D, ls_ret=_D, turnover_combined=_D, cost_drag=_D, ls_ret_net=_D, long_ret_net=_D)
FOLD_DIAGNOSTICS = _table(fold=_I, train_start=_DT, train_end=_DT, n_train_months=_I, n_train_rows=_L, test_start=_DT, test_end=_DT, in_sample_ic=_D, oos_ic=_D, gap=_D)
TUNING_LOG = _table(label=_S, model_params=MapType(_S, _S), oos_ic_mean=_D, oos_ic_std=_D, oos_ic_ir=_D, in_sample_ic_mean=_D, gap_mean=_D, n_folds=_I, per_fold_oos_ic=ArrayType(_D), seconds=_D)

FEATURES = ("mom_1m", "mom_3m", "mom_12m_ex1", "realized_vol", "log_mkt_cap", "log_dollar_vol")
MODEL_INPUTS = tuple(f"{f}_z" for f in FEATURES)
TARGET = "fwd_ret"
COMPARISON = ("ann_return", "ann_vol", "sharpe", "sharpe_ci_low", "sharpe_ci_high", "sharpe_p_value", "max_drawdown", "ann_return_net", "sharpe_net", "sharpe_net_ci_low", "sharpe_net_ci_high", "sharpe_net_p_value", "max_drawdown_net", "turnover_mean", "cost_bps", "n_periods")
