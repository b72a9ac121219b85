"""Shared plumbing of the text operators: checkpoints, Arrow batch mapping, skew-proof joins, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievemill.plans.lineage import cut, written

__all__ = ["attach", "components", "cut", "documents", "map_texts", "q", "text_of", "unused", "written"]

#: Bytes of text handed to an operator's function at once; one longer text is handed over alone.
SLICE_BYTES = 4 << 20
#: A key with more than rows / HOT_SHARE rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 2_000
#: So few edges may meet in one task.
FEW_EDGES = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q(name: str) -> str:
    """A column name, quoted."""
    return "`" + name.replace("`", "``") + "`"


def text_of(name: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(q(name)).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (letter case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_texts(
    df: DataFrame,
    fn: Callable[[list[str]], dict[str, list]],
    added: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """df with the columns that fn computes from slices of its texts (null: empty).

    keep: the columns to carry along (default: all).  A column that fn adds replaces one of that name.
    fn gets at most SLICE_BYTES of text at once, so memory doesn't depend on the number of rows in a batch.
    """
    names = [f.name for f in added]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    carried = text in kept and isinstance(df.schema[text].dataType, T.StringType)
    source = df.select(*[F.col(q(c)) for c in kept], *([] if carried else [text_of(text).alias("_text")]))
    at = kept.index(text) if carried else len(kept)
    schema = T.StructType([source.schema[c] for c in kept] + added)
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(at), "")
            sizes = pc.binary_length(column).to_pylist()
            start = 0
            while start < len(sizes):
                end, total = start, 0
                while end < len(sizes) and (end == start or total + sizes[end] <= SLICE_BYTES):
                    total += sizes[end]
                    end += 1
                out = fn(column.slice(start, end - start).to_pylist())
                arrays = [batch.column(k).slice(start, end - start) for k in range(len(kept))]
                arrays += [pa.array(out[n], type=t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)
                start = end

    return source.mapInArrow(run, schema)


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int, nulls: bool = False) -> DataFrame:
    """left join right on key, where right has a key once and weight says how many rows of left have it.

    Keys with over rows / HOT_SHARE rows are broadcast (there are fewer than HOT_SHARE of them); the others
    are shuffled, and none of those is heavy.  Rows without a partner get nulls.  nulls: left has null keys; those
    rows have no partner and don't move.  left is read twice, with nulls three times.
    """
    limit = max(1_000, rows // HOT_SHARE)
    hot = right.where(F.col(weight) > limit)
    cold = right.where(F.col(weight) <= limit)
    keys = F.broadcast(hot.select(key))
    named = left.where(F.col(key).isNotNull()) if nulls else left
    found = named.join(F.broadcast(hot), key, "inner").unionByName(
        named.join(keys, key, "left_anti").join(cold, key, "left")
    )
    return found.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True) if nulls else found


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges: root is the smallest node that can be reached.

    Large-star and small-star steps in turn, each round kept by a checkpoint, until the edges stay the same.
    Every step is an aggregation with partial sums and a join; of more than FEW_EDGES edges one by `attach`, so a node of
    any degree, also the centre of a star, is spread over all tasks.
    """

    def with_least(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
        return attach(edges, cut(least), key, "n", total) if total > FEW_EDGES else edges.join(least, key)

    now = cut(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    )
    total, seen = now.count(), None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
        least = least.select(F.col("u").alias("lo"), F.least("u", "v").alias("m"), "n")
        large = with_least(now, "lo", least).select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = cut(large) if total > FEW_EDGES else large
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        pairs = with_least(large, "hi", least).select(
            F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")
        )
        now = cut(pairs.select("e.hi", "e.lo").where("hi <> lo").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        total, seen = state[0], tuple(state)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select("lo", "lo").distinct()
    )
