"""JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def line(df: DataFrame, raw: tuple[str, ...] = ()) -> Column:
    """A row as JSON, nulls included.  raw: columns that hold JSON, which is taken as it is."""

    def member(c: str) -> Column:
        whole = F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"})
        if c in raw:
            return F.concat(F.to_json(F.array(F.lit(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(c)))) - 2), F.lit(":"), F.coalesce(c, F.lit("null")))
        return whole.substr(F.lit(2), F.length(whole) - 2)

    return F.concat(F.lit("{"), F.concat_ws(",", *map(member, df.columns)), F.lit("}"))


def lines(df: DataFrame, raw: tuple[str, ...] = ()) -> DataFrame:
    """(value): each row as one line."""
    return df.select(line(df, raw).alias("value"))


def write_jsonl(df: DataFrame, path: str, raw: tuple[str, ...] = ()) -> None:
    """A folder of files with a line per row, in the order of the partitions."""
    lines(df, raw).write.mode("overwrite").text(path)


def to_jsonl(df: DataFrame, order: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """(jsonl): all rows in one string, for results that are small enough for that."""
    rows = df.select(F.col(order).alias("_o"), line(df, raw).alias("_l"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]), "\n").alias("jsonl"))
