"""Small driver-side tables (pipeline metadata) as Spark local relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

MAX_LOCAL_ROWS = 100_000


def local_table(spark: SparkSession, schema: str | StructType, rows: list[tuple]) -> DataFrame:
    """Metadata rows as a LocalRelation, so the planner knows the size of the table."""
    if len(rows) > MAX_LOCAL_ROWS:
        raise ValueError(f"{len(rows)} rows are data, not metadata; write them as a table")
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(arrow))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=struct)
