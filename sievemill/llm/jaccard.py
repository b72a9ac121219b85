"""Near-duplicates by SimHash fingerprints, verified by the Jaccard similarity of word shingles, and complete (near_dedup
stage of the pipeline)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from sievemill.llm.common import attach, components, cut, map_texts, q, text_of
from sievemill.llm.exact import BROADCAST_KEYS
from sievemill.llm.simhash import links, majority, runs, within

#: Words in a shingle, and the least similarity of a pair as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: Sets whose fingerprints differ in up to so many bits are compared first.
DIFFER = 2
SEED = 42
#: Texts that share a shingle are compared pairwise if they are up to so many.
BUCKET = 48
#: About so many members of a crowd with a difference in common meet in one task.
SALTED = 1_000
#: The sets of leaders are broadcast up to so many shingles (32 MB).
BROADCAST_SHINGLES = 4_000_000
#: One of so many texts tells which shingles are frequent; those in SEEN of them at least come last in the order, up to
#: FREQUENT (3 MB); those in 1 / COMMON of them never meet by a shuffle.
SAMPLE, SEEN, FREQUENT, COMMON = 8, 3, 200_000, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of a text, sorted (fewer words: one shingle; no word: none)."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    width = min(words, len(tokens))
    hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in tokens], dtype=np.uint64)
    count = len(tokens) - width + 1
    code = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        code = (code ^ (code >> np.uint64(32))) * _MIX + hashes[k : k + count]
    code = (code ^ (code >> np.uint64(32))) * _MIX
    return np.unique((code ^ (code >> np.uint64(29))).view(np.int64))


def signature(found: np.ndarray) -> int:
    """A number for a set of shingles, as a signed integer."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], dtype=np.uint64).view(np.int64)[0])


def ordered(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the one order for all sets: rare shingles before the frequent ones (sorted, with their ranks from 1),
    then by hash."""
    at = np.minimum(np.searchsorted(frequent, found), max(0, len(frequent) - 1))
    ranks = np.where(frequent[at] == found, rank[at], 0) if len(frequent) else np.zeros(len(found), dtype=np.int64)
    return found[np.lexsort((found, ranks))]


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The first shingles of a set.

    A pair of at least the similarity t has at least t * n shingles of either set in common, so of the first
    n - ceil(t * n) + 1 of each, in one order for all sets, one is in common too, whatever the order is.
    """
    n = len(found)
    return ordered(found, frequent, rank)[: n + (-similar[0] * n // similar[1]) + 1] if n else found


def sketch(found: np.ndarray) -> bytes:
    """A bit for each hash class of a set that has a shingle, of 2 to 4 classes for each shingle."""
    bits = np.zeros(max(64, 2 << max(0, len(found) - 1).bit_length()), dtype=bool)
    bits[found & (len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def most_common(na: int, a: bytes, nb: int, b: bytes) -> int:
    """A bound on the shingles in common of two sets, from their sizes and sketches: each class that only one of them
    has holds a shingle that the other has not."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def _near_fingerprints(marks: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most max_bits bits.  marks: (sig, fingerprint), a node once.

    Of the nodes with one fingerprint the least stands for it in the links to other fingerprints, and is paired with
    the others; so pairs are as many as these nodes and the links of distinct fingerprints.
    """
    least = cut(marks.groupBy("fingerprint").agg(F.min("sig").alias("least"), F.count(F.lit(1)).alias("n")))
    same = attach(marks, least.where("n > 1"), "fingerprint", "n", marks.count()).select(F.col("least").alias("a"), F.col("sig").alias("b"))
    of = lambda k: least.select(F.col("fingerprint").alias(k), F.col("least").alias(f"n{k}"))
    linked = cut(links(least.select("fingerprint"), max_bits)).join(of("a"), "a").join(of("b"), "b")
    return cut(_pairs(same.union(linked.select("na", "nb"))))


def _bounded(pairs: DataFrame, sketches: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """pairs (a, b) with na, nb and most, the sizes of their sets and the bound of most_common; without the pairs within
    one component of parts (node, root), which need no comparison."""
    weights = pairs.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").count()
    known = sketches.join(weights, "sig").withColumn("own", F.col("sig"))
    if parts is not None:
        known = known.join(parts.withColumnRenamed("node", "sig"), "sig", "left").withColumn("own", F.coalesce("root", "sig"))
    known = cut(known)
    total = pairs.count()
    of = lambda k: known.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"), F.col("own").alias(f"o{k}"), F.col("count").alias(f"w{k}"))
    both = attach(attach(pairs, of("a"), "a", "wa", total), of("b"), "b", "wb", total)
    both = both.where("oa <> ob").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = batch.columns
            most = [most_common(*x) for x in zip(na.to_pylist(), sa.to_pylist(), nb.to_pylist(), sb.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, na, nb, pa.array(most, type=pa.int64())], names=["a", "b", "na", "nb", "most"])

    return cut(both.mapInArrow(run, "a long, b long, na long, nb long, most long"))


def _with_few(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """left join right, a small table that is broadcast up to BROADCAST_KEYS rows."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_KEYS else right, key, how)


def _sets(wanted: DataFrame, source: DataFrame, nodes: DataFrame, words: int, order: Broadcast) -> DataFrame:
    """(sig, set in order) of the wanted nodes (column sig).

    nodes: (sig, text_hash).  Only their texts are read again, so sets are never kept for the whole table.
    """
    hashes = cut(nodes.join(wanted, "sig", "left_semi").select("text_hash").distinct())
    texts = _with_few(source, hashes, "text_hash", "left_semi")

    def sets_of(texts: list[str]) -> dict[str, list]:
        sets = [shingles(t, words) for t in texts]
        return {"sig": [signature(s) for s in sets], "set": [ordered(s, *order.value) for s in sets]}

    fields = [T.StructField("sig", T.LongType()), T.StructField("set", T.ArrayType(T.LongType(), False))]
    return map_texts(texts, sets_of, fields, keep=[]).groupBy("sig").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, source: DataFrame, nodes: DataFrame, words: int, order: Broadcast) -> DataFrame:
    """pairs (a, b) with na, nb and same, the sizes of their sets of shingles and of the intersection."""
    weights = cut(pairs.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").count())
    sets = cut(_sets(weights, source, nodes, words, order).join(weights, "sig"))
    total = pairs.count()
    of = lambda k: sets.select(F.col("sig").alias(k), F.col("set").alias(f"s{k}"), F.col("count").alias(f"w{k}"))
    both = attach(attach(pairs, of("a"), "a", "wa", total), of("b"), "b", "wb", total)
    return cut(both.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("same")))


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _meetings(bucket: int, similar: tuple[int, int]):
    """A function on Arrow batches of (key, node, where: size of the set and place of the key in it), sorted by key.

    Gives (null, a, b, null) for the pairs of nodes of a key with up to `bucket` of them, but for those that are too far
    apart in size, or meet too late in their sets, to be similar, and (key, node, null, size) for the members of
    larger keys.  It holds one batch and one small key at most, whatever the number of members.
    """
    over, under = similar

    def split(keys: np.ndarray, nodes: np.ndarray, where: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """keys: whole ones."""
        number, size = runs(keys)
        few, many = (size > 1) & (size <= bucket), size > bucket
        some, n, place, pairs = nodes[few], where[few] >> 32, where[few] & 0xFFFFFFFF, []
        for k, j in within(number[few]):
            most = 1 + np.minimum(n[k] - 1 - place[k], n[j] - 1 - place[j])  # shingles in common, if this is the first
            good = (n[k] * over <= n[j] * under) & (n[j] * over <= n[k] * under) & (most * (over + under) >= over * (n[k] + n[j]))
            pairs.append(np.stack([some[k[good]], some[j[good]]]))
        return pairs, np.stack([keys[many], nodes[many], where[many]])

    def batch_of(pairs: list[np.ndarray], crowds: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate([np.zeros((2, 0), dtype=np.int64), *pairs], axis=1)
        crowd = np.concatenate([np.zeros((3, 0), dtype=np.int64), *crowds], axis=1)
        zero, alone = np.zeros(both.shape[1], dtype=np.int64), np.r_[np.zeros(both.shape[1], bool), np.ones(crowd.shape[1], bool)]
        columns = (np.r_[zero, crowd[0]], ~alone), (np.r_[both[0], crowd[1]], None), (np.r_[both[1], crowd[1]], alone), (np.r_[zero, crowd[2] >> 32], ~alone)
        return pa.RecordBatch.from_arrays([pa.array(x, mask=m) for x, m in columns], names=["key", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        full = None  # the key at the end of the last batch, once it has given out its members
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            early: list[np.ndarray] = []
            if full is not None:
                stop = int(np.argmin(np.r_[rows[0] == full, False]))
                early.append(rows[:, :stop])
                rows = rows[:, stop:]
            if rows.shape[1]:
                rows, full = np.concatenate([held, rows], axis=1), None
                cutoff = int(np.searchsorted(rows[0], rows[0, -1]))
                pairs, crowd = split(*rows[:, :cutoff])
                held = rows[:, cutoff:]
                early.append(crowd)
                if held.shape[1] > bucket:
                    full = held[0, -1]
                    early.append(held)
                    held = held[:, :0]
                yield batch_of(pairs, early)
            else:
                yield batch_of([], early)
        pairs, crowd = split(*held)
        yield batch_of(pairs, [crowd])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches sorted by their first column that have a neighbour with the same value there."""
    held, same = None, False
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        again = keys[1:] == keys[:-1]
        keep = np.r_[same, again][:-1] | again
        yield batch.slice(0, len(batch) - 1).filter(pa.array(keep))
        same = bool(again[-1]) if len(again) else same
        held = batch.slice(len(batch) - 1)
    if held is not None and same:
        yield held


def _led(many: DataFrame) -> DataFrame:
    """(leader, node) for the members (key, node, n) of crowded keys.  The leader of a key is its member with the most
    crowded keys for its size, a text of few rare shingles, as the middle of a crowd of near copies is."""
    many = cut(many)
    weights = many.groupBy("node").agg((F.count(F.lit(1)) / F.first("n")).alias("weight"))
    leaders = many.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("best"), F.count(F.lit(1)).alias("n"))
    led = attach(many.select("key", "node"), cut(leaders.select("key", "n", F.col("best.node").alias("leader"))), "key", "n", many.count())
    return cut(led.where("node <> leader").select("leader", "node").distinct())


def _crowd_pairs(led: DataFrame, source: DataFrame, nodes: DataFrame, words: int, similar: tuple[int, int], order: Broadcast) -> tuple[DataFrame, DataFrame]:
    """(links of a leader and a member, candidates for links between members), both (a, b).

    Members whose set is similar to the leader's are in its component, so pairs of them need no comparison.  Any other
    pair is found by what the members differ in from the leader: D, the shingles that only one of both has.  With
    r = (1 - t) / (1 + t), similar sets A and B differ in at most r (|A| + |B|) <= (1 - t) / t |B| shingles, which are also
    those that only one of D(A) and D(B) has.  So all but that many of D(B) are in D(A) too, of the smaller D all but
    half as many, and, as one of them is not similar to the leader, at least t / (1 + t) of the smaller.  So the first
    few of D(A) and D(B), rare shingles first, have one in common: an index of these finds all pairs, and the place of
    what they share bounds what they can have in common.
    """
    over, under = similar
    counts = led.groupBy("leader").agg(F.count(F.lit(1)).alias("weight"))
    sets = lambda k: _sets(cut(led.select(F.col(k).alias("sig")).distinct()), source, nodes, words, order)
    middle = cut(sets("leader").select(F.col("sig").alias("leader"), F.col("set").alias("middle")).join(counts, "leader"))
    both = led.join(sets("node").select(F.col("sig").alias("node"), "set"), "node")
    if (middle.agg(F.sum(F.size("middle"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        both = both.join(F.broadcast(middle), "leader")
    else:
        both = attach(cut(both), middle, "leader", "weight", led.count())
    both = both.select(
        "leader", "node", F.size("set").alias("na"), F.size("middle").alias("nl"),
        F.concat(F.array_except("set", "middle"), F.array_except("middle", "set")).alias("d"),
    ).withColumn("nd", F.size("d"))
    both = both.withColumn("close", F.expr(f"nd * {under + over} <= {under - over} * (na + nl)"))
    shared = f"greatest(1, nd - cast(floor(na * {under - over} / {over}) AS int))"
    shared_small = f"greatest(1, ceil(nd * {over} / {under + over}), nd - floor(na * {under - over} / {2 * over}))"
    both = both.withColumn("small", F.expr(f"cast(nd - {shared_small} + 1 AS int)"))
    members = cut(both.select("leader", "node", "na", "nd", "close", "small", F.expr(f"slice(d, 1, greatest(0, nd - {shared} + 1))").alias("d")))

    index = members.where("nd > 0").select("node", "na", "nd", "close", "small", "leader", F.posexplode("d").alias("place", "e"))
    index = index.select(F.xxhash64("leader", "e").alias("k"), "node", "na", "nd", "close", "small", "place")
    index = cut(index.repartition("k").sortWithinPartitions("k").mapInArrow(_repeated, index.schema))
    crowds = index.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("close")).alias("open"), F.bool_or(F.expr("place < small")).alias("starts"))
    crowds = cut(crowds.where("n > 1 AND open AND starts").select("k", "n", F.ceil(F.col("n") / SALTED).cast("int").alias("salts")))
    index = attach(index, crowds, "k", "n", index.count()).where("salts IS NOT NULL").drop("n")
    side = lambda x, salt: index.select("k", salt.alias("salt"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "na", "nd", "close", "small", "place")])
    left = side("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("place_a < small_a")
    right = side("b", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    pairs = left.join(right, ["k", "salt"]).where(
        "(nd_a < nd_b OR nd_a = nd_b AND node_a < node_b) AND NOT (close_a AND close_b)"
        f" AND na_a * {over} <= na_b * {under} AND na_b * {over} <= na_a * {under}"
        f" AND 2 * (1 + least(nd_a - 1 - place_a, nd_b - 1 - place_b)) * {under + over} >= (nd_a + nd_b) * {under + over} - {under - over} * (na_a + na_b)"
    )
    return members.where("close").select(F.col("leader").alias("a"), F.col("node").alias("b")), _pairs(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR, bucket: int = BUCKET, max_bits: int = DIFFER
) -> DataFrame:
    """(id, text_hash: xxhash64 of the text, sig, fingerprint, component_id, kept) for each row of df, repeated rows included.

    Rows whose sets of shingles have at least the similarity are linked; component_id is the smallest id of the
    rows that can be reached over links.  Of a component one row is kept, that with the smallest id (null last), then
    hash of the text, then row number.  Equal sets, also empty ones, are one node from the start.

    Each set has a SimHash fingerprint.  Sets whose fingerprints differ in at most max_bits (1 or 2) bits, found by the
    deletion variants of `simhash.links`, are verified on the whole sets and give the first components.  Most pairs of the
    similarity differ in more bits, so the others are sought too, in all sets: candidates are
    the pairs that share a shingle of their prefixes, which misses none; those that are not in one component yet, and
    that a bound on sketches doesn't exclude, are verified in the same way.

    Of a shingle that is in over `bucket` prefixes, or common in a sample of the texts, each text is compared with one of them, the leader.  Those that link to
    it are in one component; other pairs are found by what they differ in from the leader (`_crowd_pairs`), so a crowd of
    near copies isn't compared pairwise.
    """
    over, under = similar
    close, possible = (f"(na + nb - {k}) * {over} <= {k} * {under}" for k in ("same", "most"))
    source = df.select(F.col(q(id_col)).alias("id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    total = df.count()
    part = source.where(F.pmod(F.xxhash64("text_hash"), F.lit(SAMPLE)) == 0)
    counted = map_texts(
        part, lambda texts: {"set": [shingles(t, words) for t in texts]}, [T.StructField("set", T.ArrayType(T.LongType(), False))], keep=[]
    )
    counted = counted.select(F.explode("set").alias("s")).groupBy("s").count().where(F.col("count") >= SEEN)
    often = counted.orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()
    most = max(SEEN, total // (SAMPLE * COMMON))
    order = np.argsort(often["s"].to_numpy(dtype=np.int64))
    frequent, rank = often["s"].to_numpy(dtype=np.int64)[order], often["count"].to_numpy(dtype=np.int64)[order]
    shared = df.sparkSession.sparkContext.broadcast((frequent, rank))

    def keys_of(texts: list[str]) -> dict[str, list]:
        frequent, rank = shared.value
        common = frequent[rank >= most]
        sets = [shingles(t, words) for t in texts]
        firsts = [prefix(s, frequent, rank, similar) for s in sets]
        hot = [np.isin(x, common, kind="sort") for x in firsts]
        return {
            "sig": [signature(s) for s in sets], "fingerprint": [majority(s) for s in sets], "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets],
            "keys": [x[~h] for x, h in zip(firsts, hot, strict=True)], "common": [x[h] for x, h in zip(firsts, hot, strict=True)],
        }

    several = T.ArrayType(T.LongType(), False)
    added = [T.StructField("sig", T.LongType()), T.StructField("fingerprint", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("keys", several), T.StructField("common", several)]
    found = cut(map_texts(source, keys_of, added, keep=["id", "text_hash"]).withColumn("row", F.monotonically_increasing_id()))
    rows = found.select("id", "text_hash", "sig", "fingerprint", "row")

    repeated = cut(found.groupBy("sig").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", "first"))
    nodes = _with_few(found, repeated, "sig", "left").where("first IS NULL OR first = row").select("sig", "fingerprint", "text_hash", "keys", "common", "n", "sketch")
    texts, sketches = nodes.select("sig", "text_hash"), nodes.select("sig", "n", "sketch")

    alike = _near_fingerprints(cut(nodes.select("sig", "fingerprint")), max_bits)
    likely = _bounded(alike, sketches).where(possible).select("a", "b")
    settled = _verified(likely, source, texts, words, shared).where(close).select("a", "b")

    keyed = nodes.select(F.posexplode("keys").alias("place", "key"), F.col("sig").alias("node"), "n")
    keyed = keyed.select("key", "node", F.shiftleft("n", 32).bitwiseOR(F.col("place").cast("long")).alias("where"))
    meet = _meetings(bucket, similar)
    met = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "key long, a long, b long, n long"))
    many = met.where("b IS NULL").select("key", F.col("a").alias("node"), "n")
    many = many.union(nodes.select(F.explode("common").alias("key"), F.col("sig").alias("node"), "n"))
    candidates = met.where("b IS NOT NULL").select("a", "b")
    near, crowded = _crowd_pairs(_led(many), source, texts, words, similar, shared)
    candidates = cut(_pairs(candidates.union(crowded)))
    likely = _bounded(candidates, sketches, components(settled)).where(possible).select("a", "b")
    linked = _verified(likely, source, texts, words, shared).where(close).select("a", "b").union(near).union(settled)

    parts = components(linked)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "row")).alias("best")
    distinct = rows.groupBy("sig").agg(first, F.count(F.lit(1)).alias("weight"))
    groups = distinct.join(parts.withColumnRenamed("node", "sig"), "sig", "left").where("weight > 1 OR root IS NOT NULL")
    groups = cut(groups.select("sig", "weight", "best", F.coalesce("root", "sig").alias("root")))
    best = groups.groupBy("root").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    best = cut(best.select("root", "n", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep_row")))
    groups = cut(attach(groups, best, "root", "n", groups.count()).select("sig", "weight", "component_id", "keep_row"))
    return attach(rows, groups, "sig", "weight", total).select(
        F.col("id").alias(id_col),
        "text_hash",
        "sig",
        "fingerprint",
        F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
    )
