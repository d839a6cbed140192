"""Reading documents: tables, and JSON text with a schema or as variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; without a schema one ``variant`` column ``doc``, which keeps every value's type."""
    if schema:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("doc"))
