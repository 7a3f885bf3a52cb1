"""Walk-forward models: a fixed composite, rank-correlation weights (both all in DataFrames), and LambdaMART by fold."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.xsection import quantiles, ratio, value_bin
from factorspark.operators.evaluate import information_coefficient
from factorspark.operators.features import winsorized
from factorspark.operators.folds import embargo, walk_forward_splits
from factorspark.operators.lambdamart import DEFAULTS, Bins, Ranker
from factorspark.schemas import FEATURES, MODEL_INPUTS

#: What a high value of each feature is taken to say about the next return.
SIGNS = dict(zip(FEATURES, (-1.0, 1.0, 1.0, -1.0, -1.0, 1.0), strict=True))
LEAST_TRAIN_ROWS = 100
#: Groups into which the configurations of a fold are dealt at most: each gets the fold's rows once.
SLICES = 4
#: Rows that all slices of all folds hold together at most; where they would hold more, fewer slices are made, one at least.
SENT_ROWS = 8_000_000


def composite(panel: DataFrame) -> DataFrame:
    """(date, permno, fwd_ret, pred): the mean of the signed z-scores, to ten decimals."""
    total = sum(F.col(f"{f}_z") * s for f, s in SIGNS.items())
    return panel.select("date", "permno", "fwd_ret", F.round(total / len(SIGNS), 10).alias("pred"))


def training_labels(panel: DataFrame, bins: int = 10) -> DataFrame:
    """Adds target_w, the return winsorised within its date, and label, its decile by value. Both depend on the date alone,
    so they serve every fold. Evaluation uses fwd_ret, never these."""
    w = winsorized(panel, ["fwd_ret"], suffix="__w").withColumnRenamed("fwd_ret__w", "target_w")
    edges = w.groupBy("date").agg(F.array_distinct(quantiles(F.col("target_w"), *[k / bins for k in range(bins + 1)])).alias("__edges"))
    return w.join(edges, "date").withColumn("label", value_bin(F.col("target_w"), F.col("__edges"))).drop("__edges")


def usable_folds(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits of folds with at least LEAST_TRAIN_ROWS training rows and any test row.

    They are found at once and kept by the driver, a row a fold and date: what follows joins them without counting anew.
    """
    sizes = splits.join(panel.groupBy("date").agg(F.count("*").alias("n")), "date")
    count = lambda role: F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0))
    good = sizes.groupBy("fold").agg(count("train").alias("train"), count("test").alias("test")).where(f"train >= {LEAST_TRAIN_ROWS} and test > 0")
    rows = splits.join(good.select("fold"), "fold", "left_semi").orderBy("fold", "date").collect()
    return panel.sparkSession.createDataFrame(rows, "fold int, role string, date date")


def feature_ics(panel: DataFrame) -> DataFrame:
    """(date, feature, ic): the rank correlation of each feature with the return, by date."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_z").alias("z")) for f in FEATURES]))
    return information_coefficient(panel.select("date", "fwd_ret", rows.alias("x")).select("date", "fwd_ret", "x.feature", "x.z"), ["date", "feature"], "z")


def ic_weights(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """(fold, w_feature...): each feature's mean rank correlation over the fold's training dates. Correlations are made
    once a date, not once a fold."""
    train = splits.where("role = 'train'").join(feature_ics(panel), "date")
    return train.groupBy("fold").agg(*[F.coalesce(F.avg(F.when(F.col("feature") == f, F.col("ic"))), F.lit(0.0)).alias(f"w_{f}") for f in FEATURES])


def score_with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    total = sum(F.col(f"w_{f}") * F.col(f"{f}_z") for f in FEATURES)
    return rows.join(weights, "fold").select("fold", "role", "date", "permno", "fwd_ret", F.round(total, 10).alias("pred"))


def ic_weighted(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """(fold, role, date, permno, fwd_ret, pred) for train and test rows of usable folds."""
    splits = usable_folds(panel, splits)
    return score_with_weights(panel.join(splits, "date"), ic_weights(panel, splits))


def diagnostics(scored: DataFrame) -> DataFrame:
    """One row a fold: windows, sizes, the mean rank correlation in and out of sample and their gap."""
    ic = information_coefficient(scored, ["fold", "role", "date"])
    by_role = ic.groupBy("fold").agg(F.avg(F.when(F.col("role") == "train", F.col("ic"))).alias("in_sample_ic"), F.avg(F.when(F.col("role") == "test", F.col("ic"))).alias("oos_ic"))
    train, test = F.when(F.col("role") == "train", F.col("date")), F.when(F.col("role") == "test", F.col("date"))
    windows = scored.groupBy("fold").agg(
        F.min(train).alias("train_start"), F.max(train).alias("train_end"), F.countDistinct(train).cast("int").alias("n_train_months"), F.count(train).alias("n_train_rows"),
        F.min(test).alias("test_start"), F.max(test).alias("test_end"),
    )
    return windows.join(by_role, "fold").withColumn("gap", F.col("in_sample_ic") - F.col("oos_ic"))


def run_walk_forward(panel: DataFrame, train_months: int | None = 60, test_months: int = 1, step_months: int = 1, horizon: int = 1, configs: dict[str, dict] | None = None, engine: str = "lambdamart") -> DataFrame:
    """(label, fold, role, date, permno, fwd_ret, pred, seconds) of a ranking model fitted anew for each fold and configuration;
    seconds are those of the fit, the same on all its rows. Configurations of equal parameters share one fit.

    A task holds a fold with a slice of the configurations: a row is sent once for each slice, not for each
    configuration, and the training window is cut into bins once, of which the fits work. engine "xgboost" uses that
    library where it is installed.
    """

    def rows(name: str, fold: int, part: _Part, pred: np.ndarray, seconds: float) -> pa.RecordBatch:
        n = len(pred)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(name, n), pa.repeat(pa.scalar(fold, pa.int32()), n), pa.repeat(part.role, n), pa.repeat(pa.scalar(part.day, pa.date32()), n), pa.array(part.permno), pa.array(part.ret, from_pandas=True), pa.array(pred), pa.repeat(seconds, n)],
            names=["label", "fold", "role", "date", "permno", "fwd_ret", "pred", "seconds"],
        )

    return _fitted(panel, train_months, test_months, step_months, horizon, configs, engine, F.col("fwd_ret"), rows, "label string, fold int, role string, date date, permno int, fwd_ret double, pred double, seconds double")


def walk_forward_ics(panel: DataFrame, train_months: int | None = 60, test_months: int = 1, step_months: int = 1, horizon: int = 1, configs: dict[str, dict] | None = None, engine: str = "lambdamart") -> DataFrame:
    """(label, fold, role, date, ic, seconds): the rank correlations of what run_walk_forward gives, made where the fits are, so that
    no rows of every configuration are kept. As information_coefficient has them, but for the last bits."""

    def row(name: str, fold: int, part: _Part, pred: np.ndarray, seconds: float) -> pa.RecordBatch:
        values = (name, pa.scalar(fold, pa.int32()), part.role, pa.scalar(part.day, pa.date32()), pa.scalar(spearman(pred, part.ret), pa.float64()), seconds)
        return pa.RecordBatch.from_arrays([pa.repeat(v, 1) for v in values], names=["label", "fold", "role", "date", "ic", "seconds"])

    # Spark rounds what NumPy would round otherwise where a decimal lies half way.
    return _fitted(panel, train_months, test_months, step_months, horizon, configs, engine, F.round("fwd_ret", 10), row, "label string, fold int, role string, date date, ic double, seconds double")


def spearman(a: np.ndarray, b: np.ndarray) -> float | None:
    """Rank correlation over the places where b is a number, ties sharing the mean of their places; None for fewer than two or a constant side."""
    some = ~np.isnan(b)
    x, y = (_mean_ranks(v[some]) for v in (a, b))
    if len(x) < 2:
        return None
    x, y = x - x.mean(), y - y.mean()
    scale = float(np.sqrt((x * x).sum() * (y * y).sum()))
    return float((x * y).sum()) / scale if scale else None


def _mean_ranks(v: np.ndarray) -> np.ndarray:
    _, at, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[at]


@dataclass
class _Part:
    """A date of a fold: its role, its rows' entities and returns."""

    role: str
    day: int
    permno: np.ndarray
    ret: np.ndarray


def _fitted(panel: DataFrame, train_months, test_months, step_months, horizon, configs, engine: str, ret: Column, emit, schema: str) -> DataFrame:
    """What emit makes of each date, fold and configuration; ret is the return that it gets."""
    configs = configs or {"default": {}}
    splits = usable_folds(panel, walk_forward_splits(panel, train_months, test_months, step_months, embargo(horizon)))
    labelled = training_labels(panel).select("date", "permno", ret.alias("ret"), F.col("label").cast("byte").alias("label"), *MODEL_INPUTS)
    fits = distinct_fits(configs)
    folds, sent = splits.join(panel.groupBy("date").agg(F.count("*").alias("n")), "date").agg(F.max("fold"), F.sum("n")).first()
    slices = max(1, min(len(fits), SLICES, SENT_ROWS // max(sent or 0, 1)))
    rows = labelled.join(splits.withColumn("test", F.col("role") != "train").drop("role"), "date")
    rows = rows.withColumn("slice", F.explode(F.array(*[F.lit(k) for k in range(slices)])))

    def fit(fold: int, slice_: int, chunks: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        take = lambda name: np.concatenate(chunks.pop(name))
        test, day, permno, returns, y = (take(c) for c in ("test", "date", "permno", "ret", "label"))
        edges = [0, *(np.flatnonzero((np.diff(day) != 0) | (np.diff(test) != 0)) + 1).tolist(), len(day)]
        lists = np.array([b - a for a, b in zip(edges[:-1], edges[1:], strict=True) if not test[a]])
        # Training rows come first. A feature at a time is whole: the fits need no more of it than its bins.
        held, train, after = int((~test).sum()), [], []

        def columns() -> Iterator[np.ndarray]:
            for c in MODEL_INPUTS:
                x = take(c)
                after.append(x[held:].copy())
                if engine == "xgboost":
                    train.append(x[:held])
                yield x[:held]

        bins = Bins(columns())
        x = np.stack(train, axis=1) if train else None
        tests = np.stack(after, axis=1)
        for names in fits[slice_::slices]:
            began = time.perf_counter()
            fitted, predict = _ranker(engine, configs[names[0]], x, y[:held].astype(np.float64), lists, bins)
            seconds = time.perf_counter() - began
            pred = np.round(np.concatenate([fitted, predict(tests)]).astype(np.float64), 10)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = _Part("test" if test[a] else "train", int(day[a]), permno[a:b], returns[a:b])
                for name in names:
                    yield emit(name, fold, part, pred[a:b], seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks = None, {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "slice")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (key := tuple(keys[a].tolist())) != now:
                    if now:
                        yield from fit(*now, chunks)
                    now, chunks = key, {c: [] for c in ("test", "date", "permno", "ret", "label", *MODEL_INPUTS)}
                for c, parts in chunks.items():
                    column = batch.column(c).slice(a, b - a)
                    parts.append(np.array((column.cast(pa.int32()) if c == "date" else column).to_numpy(zero_copy_only=False)))
        if now:
            yield from fit(*now, chunks)

    # A group is much work for few bytes: each is a task of its own, where a hash would put several into one and none into others.
    rows = rows.withColumn("group", (F.col("fold") * slices + F.col("slice")).cast("int")).repartitionById(((folds or 0) + 1) * slices, F.col("group"))
    return rows.drop("group").sortWithinPartitions("fold", "slice", "test", "date", "permno").mapInArrow(run, schema)


def distinct_fits(configs: dict[str, dict]) -> list[list[str]]:
    """Names of configurations, those together whose whole parameters are equal (sweeps of several parameters all hold the
    default once): a fit depends on parameters, seed and rows alone, so they share one."""
    groups: dict[tuple, list[str]] = {}
    for name, params in configs.items():
        groups.setdefault(tuple(sorted((k, v if isinstance(v, int | float) else repr(v)) for k, v in (DEFAULTS | params).items())), []).append(name)
    return list(groups.values())


def _ranker(engine: str, params: dict, x: np.ndarray | None, y: np.ndarray, lists: np.ndarray, bins: Bins):
    """What the model gives on its training rows, and a function for others. x is there for xgboost alone."""
    if engine == "xgboost":
        from xgboost import XGBRanker

        model = XGBRanker(objective="rank:ndcg", **params).fit(x, y, group=lists)
        return model.predict(x), model.predict
    model = Ranker(**params).fit(x, y, np.concatenate([[0], np.cumsum(lists)]), bins)
    return model.fitted, model.predict


def predictions(scored: DataFrame) -> DataFrame:
    """The test rows: (date, permno, fwd_ret, pred)."""
    return scored.where("role = 'test'").select("date", "permno", "fwd_ret", "pred")


# -- tuning ----------------------------------------------------------------------------------------------------


def tuning_log(spark: SparkSession, scored: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """One row a configuration: its whole parameters, mean, deviation and ratio of the folds' rank correlations, gap, the list
    by fold, and the seconds of its fits together (NULL where scored has no seconds). scored: rows with predictions, or
    their rank correlations."""
    ic = scored if "ic" in scored.columns else information_coefficient(scored, ["label", "fold", "role", "date"])
    folds = ic.groupBy("label", "fold").agg(F.avg(F.when(F.col("role") == "train", F.col("ic"))).alias("ins"), F.avg(F.when(F.col("role") == "test", F.col("ic"))).alias("oos"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("fold", "oos"))), lambda x: F.round(x.oos, 4))
    out = folds.groupBy("label").agg(
        F.avg("oos").alias("oos_ic_mean"), F.stddev_samp("oos").alias("oos_ic_std"), ratio(F.avg("oos"), F.stddev_samp("oos")).alias("oos_ic_ir"),
        F.avg("ins").alias("in_sample_ic_mean"), F.avg(F.col("ins") - F.col("oos")).alias("gap_mean"), F.count("*").cast("int").alias("n_folds"), listed.alias("per_fold_oos_ic"),
    )
    params = [(k, {a: str(b) for a, b in v.items()}) for k, v in configs.items()]
    named = spark.createDataFrame(params, "label string, model_params map<string,string>").join(out, "label")
    if "seconds" not in scored.columns:
        return named.withColumn("seconds", F.lit(None).cast("double"))
    took = scored.groupBy("label", "fold").agg(F.max("seconds").alias("seconds")).groupBy("label").agg(F.round(F.sum("seconds"), 3).alias("seconds"))
    return named.join(took, "label")


def sweep_configs(param: str, values: list, base: dict | None = None) -> dict[str, dict]:
    """One configuration a value, named param=value; what neither sets has the model's default."""
    return {f"{param}={v}": {**DEFAULTS, **(base or {}), param: v} for v in values}


def grid_configs(grid: dict[str, list] | None = None, base: dict | None = None) -> dict[str, dict]:
    """The configurations of all sweeps of a grid."""
    return {k: v for param, values in (grid or GRID).items() for k, v in sweep_configs(param, values, base).items()}


#: The first tier of the reference's sweep.
GRID = {"max_depth": [2, 3, 4, 5, 6], "min_child_weight": [5, 15, 30, 60], "subsample": [0.6, 0.7, 0.8, 1.0], "colsample_bytree": [0.6, 0.7, 0.8, 1.0]}


def sweep(spark: SparkSession, panel: DataFrame, param: str, values: list, base: dict | None = None, **walk) -> DataFrame:
    """All values of one parameter in one job over (configuration, fold)."""
    return log_of(spark, panel, sweep_configs(param, values, base), **walk)


def log_of(spark: SparkSession, panel: DataFrame, configs: dict[str, dict], **walk) -> DataFrame:
    """The tuning log of configurations, fitted in one job over (fold, slice of the configurations)."""
    # The fits are many times what their rows are to keep: without it each part of the log would fit anew.
    scored = walk_forward_ics(panel, configs=configs, **walk).persist()
    log = tuning_log(spark, scored, configs)
    rows = log.collect()  # a row a configuration
    scored.unpersist()
    return spark.createDataFrame(rows, log.schema)


def append_log(log: DataFrame, path: str) -> None:
    """Appends to the log's folder; nested cells keep their types."""
    log.write.mode("append").parquet(path)


def log_as_text(log: DataFrame) -> DataFrame:
    """Nested cells as JSON, for CSV."""
    return log.withColumn("model_params", F.to_json("model_params")).withColumn("per_fold_oos_ic", F.to_json("per_fold_oos_ic"))
