"""Sharding by minimax contiguous partition (operator 2).  DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sievemill.llm.common import cut, documents, q, text_of

#: Bits of the group hash that the first cells share, and that each level of refinement adds.
FIRST_BITS, MORE_BITS = 16, 8
#: About so many rows are numbered by one task.
SLOT_ROWS = 50_000


def cuts(sizes: list[int], shards: int, capacity: int, sums: list[int]) -> list[int] | None:
    """Greedy check: the first indices of shards 2, 3, ... when each takes atoms while it has room; None if it
    takes over `shards`.  sums: 0 and the running sums of sizes."""
    out, at = [], 0
    while True:
        at = bisect_right(sums, sums[at] + capacity) - 1
        if at >= len(sizes):
            return out
        if len(out) == shards - 1:
            return None
        out.append(at)


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest feasible capacity for ordered atoms, by binary search."""
    sums = [0, *accumulate(sizes)]
    low = max([-(-sums[-1] // shards), *sizes])
    high = low + max(sizes, default=0)
    while cuts(sizes, shards, high, sums) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if cuts(sizes, shards, mid, sums) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts within the capacity that leave no shard idle: a shard closes where it comes nearest to an equal part of
    what remains, unless the shards after it then couldn't hold the rest."""
    sums = [0, *accumulate(sizes)]
    latest, end = [], len(sizes)  # the earliest start from which the last k shards can hold the rest
    for _ in range(shards - 1):
        end = max(0, _first_at_least(sums, sums[end] - capacity))
        latest.append(end)
    out, at = [], 0
    for k in range(1, shards):
        left = shards - k
        goal = sums[at] + (sums[-1] - sums[at]) / (left + 1)
        x = bisect_right(sums, goal) - 1
        if x + 1 < len(sums) and sums[x + 1] - goal < goal - sums[x]:
            x += 1
        x = min(x, bisect_right(sums, sums[at] + capacity) - 1)
        at = max(at, x, latest[left - 1])
        out.append(at)
    return out


def _greedy(sums: list[int], shards: int, capacity: int) -> list[int]:
    """Where a greedy pass of this capacity cuts, feasible or not."""
    out, at = [], 0
    for _ in range(shards - 1):
        at = min(bisect_right(sums, sums[at] + capacity) - 1, len(sums) - 1)
        out.append(at)
    return out


def _first_at_least(sums: list[int], value: int) -> int:
    k = bisect_right(sums, value)
    while k and sums[k - 1] >= value:
        k -= 1
    return k


def shard_edges(groups: DataFrame, shards: int) -> list[int]:
    """groups: (h: unsigned 64-bit order as a signed long, bytes).  The hashes before which shards 2, 3, ... begin.

    The atoms are groups in the order of their hash.  Atoms are first summed into cells of equal hash prefix, at
    most 2 ** LEVEL_BITS of them, so what comes to the driver doesn't grow with the input.  The capacity found
    over cells bounds the true one to within the largest cell; only cells in which a cut can fall for a capacity
    within the bounds are then split by further bits, until these hold single groups: some dozens of cells for each
    cut, so at most some hundred thousand finer ones at a time.
    """
    def level(bits: int, inside: DataFrame | None, parent_bits: int) -> list:
        prefix = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
        source = groups
        if inside is not None:
            source = source.withColumn("p", F.shiftright("h", 64 - parent_bits)).join(F.broadcast(inside), "p", "left_semi")
        rows = source.groupBy(prefix.alias("p")).agg(
            F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.count(F.lit(1)).alias("n")
        ).collect()
        return sorted((r["p"] << (64 - bits), 64 - bits, r["bytes"], r["largest"], r["n"]) for r in rows)

    cells = level(FIRST_BITS, None, 0)
    spark = groups.sparkSession
    while True:
        sizes = [c[2] for c in cells]
        if not cells:
            return []
        sums = [0, *accumulate(sizes)]
        high = smallest_capacity(sizes, shards)
        mixed = [k for k, c in enumerate(cells) if c[4] > 1 and c[1] > 0]
        slack = max([0] + [cells[k][2] for k in mixed])
        low = max([-(-sums[-1] // shards), high - slack, *(c[3] for c in cells)])
        even = even_cuts(sizes, shards, high)
        active: set[int] = set()  # the cells in which a cut can fall: of the even ones, or for any capacity within the bounds
        for e in even:
            active.update(k for k in (e - 1, e, e + 1) if 0 <= k < len(cells))
        first, last = _greedy(sums, shards, low), _greedy(sums, shards, high)
        for x, y in zip(first, last, strict=True):
            active.update(range(max(0, x - 1), min(len(cells), max(x, y) + 2)))
        split = sorted(active.intersection(mixed))
        if not split:
            return [cells[k][0] if k < len(cells) else 1 << 63 for k in even]
        shift = max(cells[k][1] for k in split)
        chosen = [k for k in split if cells[k][1] == shift]
        listed = F.split(F.lit(",".join(str(cells[k][0] >> shift) for k in chosen)), ",")
        inside = spark.range(1).select(F.explode(listed.cast("array<long>")).alias("p"))
        finer = level(64 - shift + MORE_BITS, inside, 64 - shift)
        gone = set(chosen)
        cells = sorted([c for k, c in enumerate(cells) if k not in gone] + finer)


def assign_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, size (UTF-8 bytes of the text + 16), text_crc32, shard, slot.

    Rows of equal text stay together (a null text is as an empty one; its size is 16).  The largest shard is as
    small as any cut of the groups, ordered by hash, allows; within that bound the cuts are put where the shards are
    nearest to equal.  Different texts of equal xxhash64 would be one group.  A group larger than an even share is a bound for its shard alone.  Slots run from 0
    without gaps.  Repeated rows get a slot each, numbered by one task for each pair of id and text; an empty table gives no rows; other columns aren't read.
    """
    size = F.octet_length(text_of(text)).cast("long") + 16
    rows = cut(
        df.select(F.col(q(id_col)).alias("id"), size.alias("size"), F.crc32(text_of(text)).alias("text_crc32"), F.xxhash64(text_of(text)).alias("h"))
    )
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    edges = shard_edges(groups, shards)
    shard = F.lit(0)
    for e in edges:
        if e < 1 << 63:
            shard = shard + (F.col("h") >= F.lit(e).cast("long")).cast("int")
    placed = rows.withColumn("shard", shard)
    count = rows.count()
    parts = max(4, -(-count // (shards * SLOT_ROWS)))
    part = F.pmod(F.xxhash64("id", "h"), F.lit(parts)).cast("int")
    placed = placed.withColumn("part", part)
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy("id", "h"))
    return placed.withColumn("k", number).join(offsets, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("k") - 1 + F.col("before")).cast("long").alias("slot")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
