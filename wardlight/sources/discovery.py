"""What can be queried — tables, their columns, and which carry a tenant column.

Only schemas travel to the driver (one row per column), never data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_COLS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("ordinal_position", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
])


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views visible to the session."""
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, table_type string, is_temporary boolean")


def table_columns(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """One row per column of each frame, in schema order (1-based ordinal)."""
    rows = [(name, f.name, i + 1, f.dataType.simpleString())
            for name, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, _COLS_SCHEMA)


def tenant_tables(spark: SparkSession, frames: dict[str, DataFrame],
                  tenant_column: str = "tenant_id") -> DataFrame:
    """The tables a tenant can query — those having the tenant column."""
    return table_columns(spark, frames).where(f"column_name = '{tenant_column}'") \
        .select("table_name", "column_name")
