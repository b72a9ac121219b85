"""Exact deduplication by progressive refinement (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievemill.llm.common import attach, cut, documents, q, text_of, unused

#: Characters that don't count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
PREFIX = 128
#: So many keys of rows to drop are broadcast at most (about 40 MB).
BROADCAST_KEYS = 500_000
#: Words of 64 bits that say which keys survive a stage: what is broadcast has this size, however many survive.
SLOTS = 1 << 18


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), BLANKS, "")


def _survivors(keys: DataFrame, *columns: str) -> DataFrame:
    """(slot, bits): a bit set for the hash of each key that several rows have; at most SLOTS rows."""
    code = F.xxhash64(*columns)
    several = keys.groupBy(*columns).count().where("count > 1")
    bits = several.select(F.pmod(code, F.lit(SLOTS)).alias("slot"), _bit(code).alias("bit"))
    return cut(bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")))


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(code, 58).cast("int"))


def _alive(rows: DataFrame, survivors: DataFrame, *columns: str) -> DataFrame:
    """rows, each with a flag `alive`, false where its key surely has no other row.

    A row whose key shares its bit with one that survives goes on too, which costs a hash and changes no result.
    """
    code = F.xxhash64(*columns)
    slotted = rows.withColumn("slot", F.pmod(code, F.lit(SLOTS))).withColumn("bit", _bit(code))
    flagged = slotted.join(F.broadcast(survivors), "slot", "left")
    return flagged.withColumn("alive", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).drop("slot", "bit", "bits")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of df: id, text_hash (xxhash64 of the original text), keep_id, group_size, kept, full_hash.

    Texts are equal when they are after deleting blanks; null counts as empty.  Of each group the row with the most
    code points in its original text stays, then that with the smallest id (null last); of rows that repeat text
    and id, one.

    Three passes over the texts.  The first counts normalised lengths.  The second hashes the first PREFIX
    characters of rows whose length repeats, and counts (length, prefix hash).  The third computes the full
    hash (SHA-256, binary) of rows whose key repeats; groups are those of equal full hash.  For the other rows
    full_hash stays null unless digest asks for it.  Between passes travels a bitmap of fixed size (SLOTS), so there is
    one way at every size; the text is never shuffled.  An empty table gives no rows; other columns aren't read.
    """
    norm = normalised(text)
    lengths = _survivors(df.select(F.length(norm).alias("length")), "length")
    source = df.select(
        F.col(q(id_col)).alias("id"), F.length(text_of(text)).alias("points"), F.xxhash64(text_of(text)).alias("text_hash"),
        norm.alias("norm"), F.length(norm).alias("length"),
    )
    # A CASE, so that rows that went out are not hashed.
    source = _alive(source, lengths, "length")
    source = source.withColumn("prefix", F.when(F.col("alive"), F.xxhash64(F.substring("norm", 1, PREFIX))))
    keys = _survivors(source.where("alive").select("length", "prefix"), "length", "prefix")
    source = _alive(source.withColumnRenamed("alive", "long_alive"), keys, "length", "prefix")
    alive = F.col("long_alive") & F.col("alive")
    full = F.unhex(F.sha2("norm", 256))
    rows = cut(
        source.select(
            "id", "points", "text_hash", alive.alias("alive"),
            (full if digest else F.when(alive, full)).alias("full_hash"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = rows.count()
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")))
    groups = rows.where("alive").groupBy("full_hash").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(
        groups.where("group_size > 1").select("full_hash", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    )
    joined = attach(rows, groups, "full_hash", "group_size", total, nulls=not digest)
    return joined.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "full_hash",
    )


def keep_rows(df: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that the verdict (id, text_hash, kept) keeps, with all their columns.

    Only the keys that lose a row are joined: broadcast up to BROADCAST_KEYS, else shuffled.  Where some of
    several equal rows stay, one of them does.
    """
    ident, hashed, kept, count = (unused(df, n) for n in ("_id", "_hash", "_kept", "_n"))
    keys = verdict.groupBy(F.col(q(id_col)).alias(ident), F.col("text_hash").alias(hashed))
    keys = cut(keys.agg(F.max("kept").alias(kept), F.count(F.lit(1)).alias(count)).where(~F.col(kept) | (F.col(count) > 1)))
    size, repeated = keys.agg(F.count(F.lit(1)), F.coalesce(F.count_if(kept), F.lit(0))).first()
    side = F.broadcast(keys) if size <= BROADCAST_KEYS else keys
    on = [F.col(q(id_col)).eqNullSafe(F.col(ident)), F.xxhash64(text_of(text)) == F.col(hashed)]
    joined = df.join(side, on, "left")
    out = joined.where(F.col(hashed).isNull())
    if repeated:
        out = out.unionByName(joined.where(kept).dropDuplicates([ident, hashed]))
    return out.select(*[F.col(q(c)) for c in df.columns])


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), h AS (
  SELECT doc_id, length(t) AS points, sha256(norm) AS text_sha256 FROM n
), r AS (
  SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
