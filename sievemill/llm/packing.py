"""Best-fit packing into bins of several permitted lengths (operator 4)."""

from __future__ import annotations

import base64
import hashlib
import sys
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievemill.llm.common import cut, documents, map_texts, q, text_of

#: Permitted sequence lengths, in tokens.
LENGTHS = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence beside its length, in tokens.
OVERHEAD = 32
#: Pieces that are packed together by one task, on average.
GROUP = 4_096
#: More than the bins of any group; sets their numbers apart.
GROUP_BINS = 1 << 24


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(ranks: bytes):
    """The byte-pair encoder of a file of ranks, built once in each Python process (kept in sys, as the globals of this
    module travel with every task)."""
    import public_tokenizers
    import tiktoken

    loaded = sys.__dict__.setdefault("_sievemill_encoders", {})
    key = hashlib.sha256(ranks).hexdigest()
    if key not in loaded:
        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        loaded[key] = tiktoken.Encoding(key, pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={})
    return loaded[key]


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, ranks: str | None = None) -> DataFrame:
    """df with tokens: the tokens of the whole text and an end mark, so a null or empty text has one.

    ranks: path of a file of byte-pair ranks; the driver reads it and it travels with the tasks."""
    with open(ranks or default_ranks(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: list[str]) -> dict[str, list]:
        encode = _encoder(shared.value).encode_ordinary
        return {"tokens": [len(encode(x)) + 1 for x in texts]}

    return map_texts(df, run, [T.StructField("tokens", T.LongType())], text, keep)


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, and the length of each bin.

    Largest first (ties by position), into the open bin that it fills best (ties: the oldest).  Where none has
    room, a bin of the length is opened that costs least for what it can be expected to hold: itself, and as much
    of the sizes still to come as fits, less half of their mean for the gap that stays at its end.  Last, each bin
    is cut down to the least permitted length that holds its contents.
    """
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    if order and sizes[order[0]] > lengths[-1]:
        raise ValueError(f"a size is over {lengths[-1]}")
    rest, left = sum(sizes), len(sizes)
    bins: list[int] = [0] * len(sizes)
    offsets: list[int] = [0] * len(sizes)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for k in order:
        size = sizes[k]
        rest, left = rest - size, left - 1
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            gap = rest / left / 2 if left else 0.0

            def cost(length: int) -> tuple[float, int]:
                more = min(rest, length - size)
                held = size + (more if more == rest else max(0.0, more - gap))
                return (length + overhead) / held, length

            free, b = min((x for x in lengths if x >= size), key=cost), len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets, [next(x for x in lengths if x >= u) for u in used]


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP,
    ranks: str | None = None,
) -> DataFrame:
    """One row per piece of a document: id, piece, start (its first token in the document), length, bin_id, bin_offset, bin_length.

    A document of more than the longest permitted length is cut into full pieces and a rest; no token is dropped.
    Pieces are dealt out evenly over groups of about `group` pieces, by a hash of id, text, number among the rows that
    repeat both, and piece; so bins don't depend on how the input is split, and no group can be large.  Each group is
    packed on its own.  A null or empty text has its end mark only; repeated rows are packed as often as they come.
    An empty table gives no rows; other columns are not read.  Texts are read once: ids and token counts are kept.
    """
    lengths = tuple(sorted(set(lengths)))
    longest = lengths[-1]
    source = df.select(F.col(q(id_col)).alias("id"), F.xxhash64(text_of(text)).alias("hash"), text_of(text).alias("text"))
    docs = cut(count_tokens(source, "text", ["id", "hash"], ranks).groupBy("id", "hash", "tokens").count())
    total = docs.agg(F.sum(F.col("count") * F.ceil(F.col("tokens") / longest))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    first = F.lit(1).cast("long")
    pieces = docs.select("id", "hash", "tokens", F.explode(F.sequence(first, F.col("count"))).alias("number"))
    pieces = pieces.select(
        "id", "hash", "number", "tokens", F.posexplode(F.sequence(first - 1, F.col("tokens") - 1, F.lit(longest).cast("long"))).alias("piece", "start")
    ).select(
        F.xxhash64("id", "hash", "number", "piece").alias("k"), "id", "piece", "start", F.least(F.col("tokens") - F.col("start"), F.lit(longest)).alias("length")
    )
    pieces = pieces.withColumn("g", F.pmod("k", F.lit(groups)))
    schema = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType)]
        + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()))]
        + [T.StructField(n, t) for n, t in (("bin_id", T.LongType()), ("bin_offset", T.IntegerType()), ("bin_length", T.IntegerType()))]
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("k", "piece", "length")])
        bins, offsets, sizes = pack(rows["length"].to_pylist(), lengths, overhead)
        first = rows["g"][0].as_py() * GROUP_BINS
        return pa.table(
            {
                "id": rows["id"], "piece": rows["piece"], "start": rows["start"], "length": rows["length"],
                "bin_id": pa.array([first + b for b in bins], type=pa.int64()), "bin_offset": pa.array(offsets, type=pa.int32()),
                "bin_length": pa.array([sizes[b] for b in bins], type=pa.int32()),
            }
        )

    return pieces.groupBy("g").applyInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"))
