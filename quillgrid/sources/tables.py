"""Relational tables of users and tokens over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.operators.entities import public


def read_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **properties: str,
) -> dict[str, str]:
    """JDBC options; a partition column splits the read into parallel range queries."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("partition_column needs lower and upper")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, options: dict[str, str], *, with_secrets: bool = False) -> DataFrame:
    """A table without its secret columns, unless asked for."""
    df = spark.read.format("jdbc").options(**options).load()
    return df if with_secrets else public(df)


def write_table(df: DataFrame, options: dict[str, str], mode: str = "append", batch_size: int = 10_000) -> None:
    df.write.format("jdbc").options(**options).option("batchsize", str(batch_size)).mode(mode).save()
