"""URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """The column url of a CSV with a header, without empty ones; other columns are ignored.  ValueError if there is none.

    Fields may be quoted, with doubled quotes and line ends inside; so one file is read by one task."""
    table = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    if "url" not in table.columns:
        raise ValueError(f"the CSV has no column 'url', only {table.columns}")
    return table.select("url").where("url <> ''")
