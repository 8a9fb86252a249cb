"""Report and table files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

MODE = "overwrite"


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table of any size, one file per task; kind is parquet or csv (with header)."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown table format {kind!r}")
    writer = df.write.mode(MODE)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_csv_report(rows: DataFrame, path: str) -> None:
    """A report (scenarios x methods, a few rows) as one CSV file with a header."""
    rows.coalesce(1).write.mode(MODE).option("header", True).csv(path)


def read_csv_report(
    spark: SparkSession, path: str, casts: Mapping[str, str], valid: str | None = None
) -> DataFrame:
    """Read a CSV report again: keep rows whose `valid` column is true, cast the named columns.

    Without such a column every row counts as valid.
    """
    raw = spark.read.option("header", True).csv(path)
    if valid is not None and valid in raw.columns:
        raw = raw.where(F.lower(valid) == "true")
    return raw.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in casts.items()})


def write_incident_json(card: DataFrame, path: str, facts: Iterable[str]) -> None:
    """The incident card as one JSON object: its facts, and blame, culprits and sources nested.

    `card` is one incident's ranked rows; a card has one row per operator, so it fits one object.
    """
    facts = list(facts)
    blame = F.map_from_entries(F.sort_array(F.collect_list(F.struct("op", "phi"))))
    named = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("op"))))
    card.groupBy(*facts).agg(
        blame.alias("attribution"),
        named("is_culprit").alias("culprits"),
        named("anchored").alias("sources"),
    ).coalesce(1).write.mode(MODE).json(path)
