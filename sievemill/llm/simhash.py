"""Near-duplicate detection with SimHash fingerprints and deletion-variant signatures (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sievemill.llm.common import attach, components, cut, documents, map_texts, q, text_of

BITS, SEED = 64, 42
#: Variants with up to so many fingerprints are compared pairwise; the fingerprints of others take the way of two bytes.
BUCKET = 64
#: So many fingerprints of one key are held at once.
MOST = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes, as a signed integer (no hash: 0)."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a text, as a signed integer (no word: 0)."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    return majority(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64))


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """df with the column fingerprint (long).  Null and empty texts get 0, long texts are taken whole."""
    return map_texts(
        df,
        lambda texts: {"fingerprint": [fingerprint(x, words) for x in texts]},
        [T.StructField("fingerprint", T.LongType())],
        text,
        keep,
    )


def _segments(max_bits: int) -> list[int]:
    """The masks of max_bits // 2 + 1 equal segments: of max_bits differing bits, one segment has at most one."""
    width = BITS // (max_bits // 2 + 1)
    return [((1 << width) - 1) << low for low in range(0, BITS, width)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(values: DataFrame, masks: list[int]) -> DataFrame:
    """(k1: number of a mask, k2: the bits of the fingerprint under it, fingerprint), for each mask."""
    value = F.col("fingerprint")
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k1"), value.bitwiseAND(F.lit(_signed(m))).alias("k2")) for k, m in enumerate(masks)])
    return values.select(F.explode(keys).alias("k"), "fingerprint").select("k.k1", "k.k2", "fingerprint")


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted codes the number of its run of equal codes and the size of that run."""
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[start, len(codes)])
    return np.repeat(np.arange(len(size)), size), np.repeat(size, size)


def within(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (k, j) of all pairs of the same run, a step of j - k at a time."""
    step = 1
    while len(same := np.flatnonzero(run[step:] == run[:-step])):
        yield same, same + step
        step += 1


def _one_wildcard(max_bits: int, bucket: int):
    """For whole keys (a byte left out of a segment, the segment's other bits): pairs by the one-wildcard variants of
    that byte.  A pair is given only under the first variant that finds it.  Gives pairs and dense values, those of
    variants that over `bucket` values have."""
    segments = np.array(_segments(max_bits), dtype=np.uint64)
    bytes_in = BITS // len(segments) // 8

    def emit(k1: np.ndarray, run: np.ndarray, value: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        bits, pairs, dense = value.view(np.uint64), [], []
        left_out = (bits >> (8 * k1).astype(np.uint64)) & np.uint64(255)
        for wild in range(8):
            code = run * 256 + (left_out & np.uint64(255 ^ (1 << wild))).astype(np.int64)
            order = np.argsort(code, kind="stable")
            sub, size = runs(code[order])
            dense.append(value[order[size > bucket]])
            at = order[size <= bucket]
            for k, j in within(sub[size <= bucket]):
                x, y, where = bits[at[k]], bits[at[j]], k1[at[k]]
                differ, segment = x ^ y, where // bytes_in
                own = differ & segments[segment]
                first = (own == np.uint64(1) << (8 * where + wild).astype(np.uint64)) | ((own == 0) & (where % bytes_in == 0) & (wild == 0))
                for s in range(len(segments) - 1):
                    first &= (segment <= s) | (np.bitwise_count(differ & segments[s]) > 1)
                near = first & (np.bitwise_count(differ) <= max_bits)
                pairs.append(np.stack([x[near], y[near]]).view(np.int64))
        return pairs, dense

    return emit


def _wildcard_pairs(max_bits: int, bucket: int):
    """For whole keys (two bytes left out of a fingerprint, the other bits): the pairs, found once each.  Values of a
    key differ in those bytes only, so a key has at most 65,536; the values of keys with over `bucket` are
    compared under each choice of two wildcards among the 16 bits, where at most four agree."""
    places = np.array(list(combinations(range(8), 2)), dtype=np.uint64)

    def ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the lowest and the highest of one or two set bits; for one bit k, 0 and k (bit 0: 0 and 1)."""
        low = x & (~x + np.uint64(1))
        at = lambda b: np.bitwise_count(b - np.uint64(1)).astype(np.uint64)
        rest = x ^ low
        one = rest == 0
        return np.where(one, 0, at(low)).astype(np.uint64), np.where(one, np.maximum(at(low), 1), at(np.maximum(rest, 1))).astype(np.uint64)

    def emit(k1: np.ndarray, run: np.ndarray, value: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        bits, pairs = value.view(np.uint64), []
        i, j = (np.uint64(8) * places[k1, k] for k in (0, 1))
        free = (bits >> i & np.uint64(255)) | (bits >> j & np.uint64(255)) << np.uint64(8)

        def found(a: np.ndarray, b: np.ndarray, wild: tuple[int, int] | None) -> None:
            differ = free[a] ^ free[b]
            near = (np.bitwise_count(differ) <= max_bits) & (differ != 0)
            a, b, differ = a[near], b[near], differ[near]
            octets = ((differ & np.uint64(255)) != 0).astype(np.uint64) << (i[a] // np.uint64(8)) | ((differ >> np.uint64(8)) != 0).astype(np.uint64) << (j[a] // np.uint64(8))
            low, high = ends(octets)
            first = (low == i[a] // np.uint64(8)) & (high == j[a] // np.uint64(8))
            if wild is not None:
                low, high = ends(differ)
                first &= (low == wild[0]) & (high == wild[1])
            pairs.append(np.stack([bits[a[first]], bits[b[first]]]).view(np.int64))

        _, size = runs(run)
        few = np.flatnonzero(size <= bucket)
        for k, m in within(run[few]):
            found(few[k], few[m], None)
        many = np.flatnonzero(size > bucket)
        for wild in combinations(range(16), 2) if len(many) else ():
            mask = np.uint64(0xFFFF ^ (1 << wild[0]) ^ (1 << wild[1]))
            code = run[many] << 16 | (free[many] & mask).astype(np.int64)
            order = np.argsort(code, kind="stable")
            sub, _ = runs(code[order])
            for k, m in within(sub):
                found(many[order[k]], many[order[m]], wild)
        return pairs, []

    return emit


def _close_pairs(emit, most: int):
    """A function on Arrow batches of (k1, k2, value), sorted by key: gives the pairs (a, b) that `emit` finds among the
    values of a key, and (a, null) for each dense value.  Values of a key with over `most` are dense; so it holds
    one batch and at most `most` values, however many a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        full = None  # the key at the end of the last batch, once it has given out its values as dense

        def emitted(rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
            """rows: whole keys."""
            if not rows.shape[1]:
                return [], []
            start = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)])
            size = np.diff(np.r_[start, rows.shape[1]])
            number, size = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
            some = (size > 1) & (size <= most)
            pairs, dense = emit(rows[0, some], number[some], rows[2, some])
            return pairs, [*dense, rows[2, size > most]]

        def batch_of(pairs: list[np.ndarray], dense: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate([np.zeros((2, 0), dtype=np.int64), *pairs], axis=1)
            lone = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *dense]))
            a = np.r_[both[0], lone]
            null = np.r_[np.zeros(both.shape[1], bool), np.ones(len(lone), bool)]
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(np.r_[both[1], lone], mask=null)], names=["a", "b"]
            )

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            early: list[np.ndarray] = []
            if full is not None:
                stop = int(np.argmin(np.r_[(rows[0] == full[0]) & (rows[1] == full[1]), False]))
                early.append(rows[2, :stop])
                rows = rows[:, stop:]
                if not rows.shape[1]:
                    yield batch_of([], early)
                    continue
                full = None
            rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            cutoff = rows.shape[1] - int(last.sum())
            pairs, dense = emitted(rows[:, :cutoff])
            held = rows[:, cutoff:]
            if held.shape[1] > most:
                full = (held[0, -1], held[1, -1])
                dense.append(held[2])
                held = held[:, :0]
            yield batch_of(pairs, early + dense)
        yield batch_of(*emitted(held))

    return run


def _joined(keyed: DataFrame, emit, most: int) -> DataFrame:
    """The equality join of (k1, k2, value) with itself on the key: one shuffle, one sort, one pass."""
    return keyed.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_close_pairs(emit, most), "a long, b long")


def links(values: DataFrame, max_bits: int = 2, bucket: int = BUCKET, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of distinct values (column fingerprint, long) with at most max_bits (1 or 2) differing bits.

    Of max_bits differing bits, one segment has at most one, so all its bytes but one are exact: each value is
    shuffled once for each of the eight bytes, under the other bytes of its segment.  There the one-wildcard
    variants of that byte are built, joined by equality and verified; a pair comes from the first variant alone.
    Values under a variant of over `bucket` values, or under exact bytes of over `most`, are dense.  Dense values are
    shuffled under all but two of their bytes, for each two: all close pairs of them meet there, among at most 65,536
    values.  So no link is lost, nothing is quadratic, and rows are 8 for a value (28 more for a dense one).
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    octet = [255 << 8 * k for k in range(8)]
    segments = _segments(max_bits)
    masks = [next(s for s in segments if s & b) & ~b for b in octet]
    found = cut(_joined(_keyed(values, masks), _one_wildcard(max_bits, bucket), most))
    dense = found.where("b IS NULL").select(F.col("a").alias("fingerprint")).distinct()
    masks = [((1 << BITS) - 1) & ~(a | b) for a, b in combinations(octet, 2)]
    return found.where("b IS NOT NULL").union(_joined(_keyed(dense, masks), _wildcard_pairs(max_bits, bucket), 1 << 16))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2, bucket: int = BUCKET
) -> DataFrame:
    """(id, text_hash: xxhash64 of the text, fingerprint long, component_id) for each row of df, repeated rows included.

    component_id: the smallest id of the rows that can be reached over links.  Texts without a word (null, empty,
    blank) have fingerprint 0 and link like any other.  A null id gets a row too, and is never a component_id
    unless its component has no other.  An empty table gives none.  Other columns are not read.
    """
    source = df.select(F.col(q(id_col)).alias("id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    rows = cut(fingerprints(source, "text", words, ["id", "text_hash"]))
    total = rows.count()
    distinct = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight")))
    parts = components(links(distinct.select("fingerprint"), max_bits, bucket))
    linked = cut(parts.join(distinct, F.col("node") == F.col("fingerprint")).select("node", "root", "least"))
    roots = cut(linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n")))
    linked = attach(linked, roots, "root", "n", linked.count()).select(F.col("node").alias("fingerprint"), "component")
    groups = distinct.join(linked, "fingerprint", "left").where("weight > 1 OR component IS NOT NULL")
    groups = cut(groups.select("fingerprint", "weight", F.coalesce("component", "least").alias("component_id")))
    return attach(rows, groups, "fingerprint", "weight", total).select(
        F.col("id").alias(id_col), "text_hash", "fingerprint", F.coalesce("component_id", "id").alias("component_id")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
