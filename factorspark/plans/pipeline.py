"""End-to-end plans: ingestion to feature panel to predictions to result tables, and the command line."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.operators import plots
from factorspark.operators.backtest import compare_constructions, compare_models, final_returns
from factorspark.operators.evaluate import information_coefficient, summarize_ic
from factorspark.operators.features import build_feature_panel
from factorspark.operators.models import GRID, append_log, composite, log_as_text, predictions, run_walk_forward, sweep
from factorspark.sources.panel import ingest_csv, ingest_remote

LOG = logging.getLogger("factorspark")


@dataclass(frozen=True)
class Settings:
    horizon: int = 3
    train_months: int = 60
    step_months: int = 3
    cost_bps: float = 20.0
    n_bootstrap: int = 10_000
    model: str = "lambdamart"

    @property
    def freq(self) -> float:
        return 12 / self.horizon


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small result table as one CSV file; mode "append" adds a file of its own header beside those there, none is rewritten."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def report(title: str, table: DataFrame) -> None:
    """Logs a small result table, a line a row."""
    for row in table.collect():
        LOG.info("%s: %s", title, ", ".join(f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}" for k, v in row.asDict().items()))


def draw(what: str, figure, *args) -> str | None:
    """The path of a figure, or nothing (logged) where no drawing library is installed."""
    try:
        return figure(*args)
    except ImportError as e:
        LOG.info("no figure of the %s: %s", what, e)
        return None


def run(spark: SparkSession, data: str, out: str, settings: Settings | None = None, figures: str | None = None) -> dict[str, str]:
    """Membership and prices under data; writes the panel, predictions and result tables under out and returns their paths.
    figures: a folder of the driver's own for drawings, if any are wanted.

    The panel and the predictions are written and read again because several results use them.
    """
    s = settings or Settings()
    paths = {n: f"{out}/{n}" for n in ("feature_panel", "predictions", "ic", "model_comparison", "construction_comparison", "portfolio_returns")}
    build_feature_panel(spark.read.parquet(f"{data}/prices.parquet"), spark.read.parquet(f"{data}/membership.parquet"), s.horizon).write.mode("overwrite").parquet(paths["feature_panel"])
    panel = spark.read.parquet(paths["feature_panel"])
    LOG.info("panel: %d columns, %d rows from %s to %s, %d dates, %d entities", len(panel.columns), *panel.agg(F.count("*"), F.min("date"), F.max("date"), F.countDistinct("date"), F.countDistinct("permno")).first())
    if s.model == "composite":
        preds = composite(panel)
    else:
        preds = predictions(run_walk_forward(panel, s.train_months, 1, s.step_months, s.horizon, engine=s.model))
    preds.write.mode("overwrite").parquet(paths["predictions"])
    preds = spark.read.parquet(paths["predictions"])
    ic = information_coefficient(preds, ["date"])
    write_csv(ic.orderBy("date"), paths["ic"])
    report("ic", summarize_ic(ic))
    tables = {
        "model_comparison": compare_models(preds.withColumn("model", F.lit(s.model)), s.freq, s.cost_bps, s.n_bootstrap),
        "construction_comparison": compare_constructions(preds, s.freq, s.cost_bps, s.n_bootstrap),
        "portfolio_returns": final_returns(preds, s.cost_bps).orderBy("date"),
    }
    read = {}
    for name, made in tables.items():
        write_csv(made, paths[name])
        read[name] = spark.read.schema(made.schema).option("header", True).csv(paths[name])  # what was written, not made anew
    report("models", read["model_comparison"])
    report("constructions", read["construction_comparison"])
    if figures:
        draw("comparison", plots.draw_comparison, read["model_comparison"], "model", f"{figures}/model_comparison.png")
        draw("rank correlations", plots.draw_ic, ic, f"{figures}/ic_timeseries.png")
        draw("equity curve", plots.draw_equity, read["portfolio_returns"], f"{figures}/equity_curve.png")
    return paths


def tune(spark: SparkSession, panel_path: str, out: str, grid: dict[str, list] | None = None, **walk) -> str:
    """Coordinate sweeps over the grid; the panel is read once and cached. Each sweep is appended to the log and to its CSV form
    as soon as it is done, so an interrupted run keeps what it has, and later runs add to it."""
    panel = spark.read.parquet(panel_path).cache()
    walk = {"train_months": 60, "step_months": 3, "horizon": 3} | walk
    for param, values in (grid or GRID).items():
        log = sweep(spark, panel, param, values, **walk)
        append_log(log, f"{out}/tuning_log")
        write_csv(log_as_text(log), f"{out}/tuning_results", "append")
        report("tuning", log.select("label", "oos_ic_mean", "oos_ic_ir", "in_sample_ic_mean", "gap_mean", "seconds"))
    panel.unpersist()
    return f"{out}/tuning_log"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factorspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {"ingest-csv": ("folder", "out"), "ingest-remote": ("url", "start", "end", "out"), "run": ("data", "out"), "tune": ("panel", "out")}.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
    sub.choices["run"].add_argument("--model", default="lambdamart", choices=["lambdamart", "xgboost", "composite"])
    sub.choices["run"].add_argument("--figures", help="folder for drawings")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("factorspark").getOrCreate()
    try:
        if a.command == "ingest-csv":
            ingest_csv(spark, a.folder, a.out)
        elif a.command == "ingest-remote":
            ingest_remote(spark, a.url, a.start, a.end, a.out)
        elif a.command == "run":
            run(spark, a.data, a.out, Settings(model=a.model), a.figures)
        else:
            tune(spark, a.panel, a.out)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
