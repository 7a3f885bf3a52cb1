"""An extension: month-end aggregates over a stream of daily rows. The batch operators have no streaming counterpart elsewhere.

Only order-free aggregates stream; the return index needs all earlier rows and stays a batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorspark.functions.xsection import last_non_null


def daily_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def monthly_stream(daily: DataFrame) -> DataFrame:
    """(permno, date, mkt_cap, avg_dollar_vol, daily_ret_std), for update or complete output: a month's row changes as its days come in."""
    return daily.groupBy("permno", F.last_day("date").alias("date")).agg(
        last_non_null(F.col("mkt_cap"), F.col("date")).alias("mkt_cap"),
        F.avg("dollar_vol").alias("avg_dollar_vol"),
        F.stddev_samp("ret").alias("daily_ret_std"),
    )
