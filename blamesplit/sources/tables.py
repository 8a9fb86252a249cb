"""Table loading: projection, column contracts, day partitions, caps and checks."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from blamesplit.functions.columns import nan_to_null
from blamesplit.functions.local import local_table
from blamesplit.functions.ordered import first_rows

THIN_PARTITION = 1000


class DataMissing(RuntimeError):
    """A table or a required column is not there; the message names it."""


class Tables:
    """Parquet tables of one folder by name; NaN is null from here on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._scans: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = nan_to_null(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        return self._scans[name]


def canonical_columns(df: DataFrame, canonical: Iterable[str]) -> DataFrame:
    """Rename columns that match a canonical name except for case."""
    names = list(canonical)
    by_lower = {c.lower(): c for c in names}
    return df.toDF(
        *[c if c in names else by_lower.get(c.lower(), c) for c in df.columns]
    )


def require_columns(df: DataFrame, required: Iterable[str], table: str) -> DataFrame:
    """Project to the contract; fail with all missing names at once."""
    required = list(required)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise DataMissing(f"{table} is missing required columns: {missing}")
    return df.select(*required)


def contract(df: DataFrame, required: Iterable[str], table: str) -> DataFrame:
    """(table, column, present, filled): the contract as data, with non-null counts per column."""
    required = list(required)
    have = [c for c in required if c in df.columns]
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in have])
    cells = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(c in have).alias("present"),
            (F.col(f"c_{c}") if c in have else F.lit(0).cast("long")).alias("filled"),
        )
        for c in required
    ]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def load(
    tables: Tables, name: str, required: Iterable[str]
) -> DataFrame:
    """Scan one table through the column contract; only the contract's columns are read."""
    required = list(required)
    try:
        df = tables(name)
    except Exception as err:  # the reader's error for a missing path
        raise DataMissing(f"missing table {name} in {tables.folder}") from err
    return require_columns(canonical_columns(df, required), required, name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, null: str = "") -> DataFrame:
    """CSV with a header and a declared schema; `null` is the text that means missing."""
    return spark.read.option("header", True).option("nullValue", null).schema(schema).csv(path)


def event_time(column: str, kind: str) -> Column:
    """The column as a timestamp; text that does not parse is null."""
    return F.expr(f"try_cast(`{column}` AS TIMESTAMP_NTZ)") if kind == "string" else F.col(column)


def on_day(df: DataFrame, column: str, day: date) -> DataFrame:
    """Rows of one calendar day by content; a half-open range that reaches the scan."""
    ts = event_time(column, dict(df.dtypes)[column])
    low = F.lit(str(day)).cast("timestamp_ntz")
    high = F.lit(str(day + timedelta(days=1))).cast("timestamp_ntz")
    return df.where((ts >= low) & (ts < high))


def load_day(
    df: DataFrame, column: str, day: date, order: list[str], max_rows: int | None = None
) -> DataFrame:
    """One day's partition; `max_rows` keeps its first rows in a total order."""
    rows = on_day(df, column, day)
    if max_rows is None:
        return rows
    daily = rows.withColumn("__day", F.to_date(column))
    return first_rows(daily, ["__day"], order, max_rows).drop("__day")


def cap_days(df: DataFrame, column: str, order: list[str], max_rows: int) -> DataFrame:
    """The same cap for every day of a table in one plan."""
    return first_rows(df.withColumn("day", F.to_date(column)), ["day"], order, max_rows)


def partition_census(df: DataFrame, column: str, days: Iterable[date], thin: int = THIN_PARTITION):
    """(day, n_rows, thin) for each requested day, also those without rows."""
    days = list(days)
    asked = local_table(df.sparkSession, "day date", [(d,) for d in days])
    low = F.lit(str(min(days))).cast("timestamp_ntz")
    high = F.lit(str(max(days) + timedelta(days=1))).cast("timestamp_ntz")
    counted = (
        df.where((F.col(column) >= low) & (F.col(column) < high))
        .groupBy(F.to_date(column).alias("day"))
        .agg(F.count("*").alias("n_rows"))
    )
    n = F.coalesce("n_rows", F.lit(0))
    return asked.join(counted, "day", "left").select("day", n.alias("n_rows"), (n < thin).alias("thin"))
