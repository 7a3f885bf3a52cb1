"""Sources: combined CSV exports, JDBC, Parquet, and the adapter that derives the panel tables from a star schema."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from factorspark.functions.xsection import clean
from factorspark.schemas import RAW_COLUMNS

PATTERN = "*membership_prices*.csv"


def with_derived_prices(rows: DataFrame) -> DataFrame:
    """Negative prices are midpoint quotes: abs. mkt_cap from shares in thousands, dollar_vol from the day's volume."""
    rows = rows.withColumn("prc", F.abs("prc"))
    return rows.withColumn("mkt_cap", F.col("prc") * F.col("shrout") * 1000).withColumn("dollar_vol", F.col("prc") * F.col("vol"))


def keep_first(rows: DataFrame, keys: Iterable[str], order: Iterable) -> DataFrame:
    """One row a key: the first in order. A rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


# -- combined CSV exports ---------------------------------------------------------------------------------------


def read_combined(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """The ten known columns as strings, with file and position for keep-first; other columns are never parsed.

    Columns are taken by name: files may have them in different orders, and those with one header are one scan.
    Raises FileNotFoundError if no file matches, ValueError if a file lacks a column.
    """
    files = _headers(spark, folder, pattern)
    if not files:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    scans = []
    for header, paths in files.items():
        names = spark.read.option("header", True).csv(paths[0]).columns
        missing = [c for c in RAW_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"columns missing in {paths[0]}: {missing}")
        rows = spark.read.option("header", True).schema(StructType([StructField(c, StringType()) for c in names])).csv(paths)
        scans.append(rows.select(*[F.col(a).alias(b) for a, b in RAW_COLUMNS.items()], F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")))
    return functools.reduce(DataFrame.unionByName, scans)


def _headers(spark: SparkSession, folder: str, pattern: str) -> dict[str, list[str]]:
    """The matching files by their first line, which the driver reads of each."""
    jvm, files = spark.sparkContext._jvm, {}
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or ():
        stream = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(status.getPath()), "UTF-8"))
        files.setdefault(stream.readLine() or "", []).append(status.getPath().toString())
        stream.close()
    return files


def membership_of(combined: DataFrame) -> DataFrame:
    """Distinct spells (permno, start, ending)."""
    return combined.select(F.col("permno").try_cast("int").alias("permno"), F.col("start").try_cast("date").alias("start"), F.col("ending").try_cast("date").alias("ending")).distinct()


def prices_of(combined: DataFrame) -> DataFrame:
    """Daily rows, first of a (permno, date) in file order; tokens that are no numbers become NULL."""
    number = [clean(F.col(c).try_cast("double")).alias(c) for c in ("prc", "ret", "vol", "shrout", "cfacpr", "cfacshr")]
    rows = combined.select(F.col("permno").try_cast("int").alias("permno"), F.col("date").try_cast("date").alias("date"), *number, "__file", "__block", "__row")
    return with_derived_prices(keep_first(rows, ("permno", "date"), ("__file", "__block", "__row")).drop("__file", "__block", "__row"))


def ingest_csv(spark: SparkSession, folder: str, out: str) -> dict[str, str]:
    """Writes membership and prices as Parquet under out; returns their paths."""
    combined = read_combined(spark, folder)
    paths = {"membership": f"{out}/membership.parquet", "prices": f"{out}/prices.parquet"}
    membership_of(combined).write.mode("overwrite").parquet(paths["membership"])
    prices_of(combined).write.mode("overwrite").parquet(paths["prices"])
    return paths


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A result table that was written as CSV with a header, in its fixed schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


# -- remote database (a contract: there is no network here) -----------------------------------------------------


def membership_query(start: str, end: str, relation: str = "membership") -> str:
    """Spells that overlap [start, end]."""
    return f"SELECT permno, mbrstartdt AS start, mbrenddt AS ending FROM {relation} WHERE mbrenddt >= DATE '{start}' AND mbrstartdt <= DATE '{end}'"


#: Entities in one key list.
KEYS = 500


def key_lists(permnos: Iterable[int], most: int = KEYS) -> list[str]:
    """Conditions that together hold for these entities, each for most of them: a part of a remote read each."""
    keys = sorted({int(p) for p in permnos if p is not None})
    return [f"permno IN ({', '.join(map(str, keys[i : i + most]))})" for i in range(0, len(keys), most)]


def price_query(start: str, end: str, relation: str = "daily") -> str:
    return f"SELECT permno, date, prc, ret, vol, shrout, cfacpr, cfacshr FROM {relation} WHERE date BETWEEN DATE '{start}' AND DATE '{end}'"


def names_query(relation: str = "stocknames") -> str:
    """Labels of entities and the days on which they hold."""
    return f"SELECT permno, ticker, comnam, namedt, nameenddt FROM {relation}"


def read_jdbc(spark: SparkSession, url: str, query: str, keys: list[str] | None = None, **options: str) -> DataFrame:
    """A query pushed to the database; with keys, a part for each key list, which the database applies too."""
    if keys is None:
        return spark.read.format("jdbc").option("url", url).options(**options).option("query", query).load()
    return spark.read.jdbc(url, f"({query}) q", predicates=keys or ["1 = 0"], properties=options)


def ingest_remote(spark: SparkSession, url: str, start: str, end: str, out: str, read=read_jdbc, **options: str) -> dict[str, str]:
    """Members, their prices and names as Parquet. What is read of prices and names is that of members alone: their key set, a
    number an entity, is sent along in lists. read stands for the database in tests."""
    paths = {n: f"{out}/{n}.parquet" for n in ("membership", "prices", "names")}
    read(spark, url, membership_query(start, end), **options).write.mode("overwrite").parquet(paths["membership"])
    keys = key_lists(r.permno for r in spark.read.parquet(paths["membership"]).select("permno").distinct().toLocalIterator())
    with_derived_prices(read(spark, url, price_query(start, end), keys, **options)).write.mode("overwrite").parquet(paths["prices"])
    read(spark, url, names_query(), keys, **options).write.mode("overwrite").parquet(paths["names"])
    return paths


def restrict_to(prices: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose permno has a spell at all."""
    return prices.join(members.select("permno").distinct(), "permno", "left_semi")


def overlapping_spells(members: DataFrame, start: str, end: str) -> DataFrame:
    return members.where((F.col("ending") >= F.lit(start).cast("date")) & (F.col("start") <= F.lit(end).cast("date")))


# -- the panel tables of a star schema (lineitem, supplier) -----------------------------------------------------


def raw_daily(spark: SparkSession, folder: str) -> DataFrame:
    x = spark.read.parquet(f"{folder}/lineitem.parquet")
    return x.select(
        F.col("l_suppkey").cast("int").alias("permno"), F.col("l_shipdate").cast("date").alias("date"),
        (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_extendedprice") / F.col("l_quantity")).alias("prc"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount") - 0.05).alias("ret"), (F.col("l_quantity") * 100).alias("vol"),
        (F.lit(1000.0) + 10 * (F.col("l_suppkey") % 97)).alias("shrout"), F.lit(1.0).alias("cfacpr"), F.lit(1.0).alias("cfacshr"), "l_orderkey", "l_linenumber", "l_partkey",
    )


def daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One exchange by permno up front serves the dedup here and the windows and aggregates by permno that follow."""
    order = ("l_orderkey", "l_linenumber", "l_partkey")
    return with_derived_prices(keep_first(raw_daily(spark, folder).repartition("permno"), ("permno", "date"), order).drop(*order))


def membership_spells(spark: SparkSession, folder: str) -> DataFrame:
    s = spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("permno"))
    day = lambda x: F.lit(x).cast("date")
    five = F.col("permno") % 5 == 0
    first = s.select("permno", F.add_months(day("1995-01-01"), F.col("permno") % 24).alias("start"), F.when(five, day("1998-12-31")).otherwise(day("2001-12-31")).alias("ending"))
    again = s.where(five).select("permno", day("1999-07-01").alias("start"), day("2001-12-31").alias("ending"))
    overlap = s.where(F.col("permno") % 11 == 0).select("permno", day("1996-01-01").alias("start"), day("1997-12-31").alias("ending"))
    return first.unionByName(again).unionByName(overlap).distinct()


def name_map(spark: SparkSession, folder: str) -> DataFrame:
    s = spark.read.parquet(f"{folder}/supplier.parquet")
    return s.select(F.col("s_suppkey").cast("int").alias("permno"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("comnam"), F.lit("1995-01-01").cast("date").alias("namedt"), F.lit("2001-12-31").cast("date").alias("nameenddt"))
