"""Scans and sinks of Parquet tables, text and JSON datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.records import only_new


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): each text file as one page."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.lit(1).alias("page"), F.col("value").alias("text"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold arrays or objects over several lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def append_new(rows: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append rows whose keys the table lacks, so that a repeated write adds nothing; `work` is applied to them first, if given."""
    rows.sparkSession.catalog.refreshByPath(path)
    try:
        held = rows.sparkSession.read.parquet(path).select(*keys)
    except Exception as error:  # a table that isn't there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        held = rows.select(*keys).where("false")
    left = only_new(rows, held, keys)
    (work(left) if work else left).write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
