"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is run in full (all columns, written to the noop sink) with nothing cached before it; the fits, which are timed
apart from the feature panel, have that at hand.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factorspark.operators import models as md
from factorspark.plans import catalogue as c

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def walk_forward(spark, panel):
    return md.predictions(md.run_walk_forward(panel, c.TRAIN, 1, c.STEP, c.HORIZON))


def sweep_17(spark, panel):
    return md.log_of(spark, panel, md.grid_configs(), train_months=c.TRAIN, step_months=c.STEP, horizon=c.HORIZON)


def backtest(spark, d):
    from factorspark.operators.backtest import compare_constructions

    return compare_constructions(c.composite(spark, d), c.FREQ, c.BPS, n_bootstrap=10_000)


HEADLINE = {
    "daily_clean": c.QUERIES["q01_daily_clean"],
    "monthly_resample": c.QUERIES["q08_monthly_resample"],
    "feature_panel": c.QUERIES["q18_feature_panel"],
    "deciles": c.QUERIES["q20_deciles"],
    "ic_by_date": c.QUERIES["q23_ic_by_date"],
    "costed_returns": c.QUERIES["q47_final_returns"],
    "ic_weighted_walk_forward": c.QUERIES["q28_wf_ic_weighted_preds"],
    "compare_models": c.QUERIES["q38_compare_models"],
    "backtest_with_bootstrap": backtest,
}
FITS = {"lambdamart_walk_forward": walk_forward, "lambdamart_sweep_17": sweep_17}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).agg(F.sum("id")).collect()
    took, only = {}, sys.argv[1:]
    for name, query in (HEADLINE | FITS).items():
        if only and name not in only:
            continue
        spark.catalog.clearCache()
        given = SF_DIR
        if name in FITS:
            given = c.shared_panel(spark, SF_DIR)
            given.count()
        began = time.time()
        query(spark, given).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
