"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

The walk needs 64-bit modular multiplication. ANSI mode rejects overflow, so a key is carried as two 32-bit halves
and multiplied in 16-bit steps that never leave the non-negative longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import table

#: Fixed value of the published algorithm: the multiplier of its linear congruential generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
SHARDS = 40
#: Jumps grow as ln(shards); rows that need more than this go through the full-length walk, so none is cut short.
USUAL_JUMPS = 24


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * MULTIPLIER + 1 modulo 2**64, as halves."""
    high, c1, c0 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
    upper = lo * c1
    total = lo * c0 + 1 + F.shiftleft(upper.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    new_hi = carry + hi * c0 + F.shiftleft((hi * c1).bitwiseAND(0xFFFF), 16) + (lo * high).bitwiseAND(LOW)
    return new_hi.bitwiseAND(LOW), total.bitwiseAND(LOW)


def _halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32).bitwiseAND(LOW), key.bitwiseAND(LOW)


def _walk(state: Column, shards: int, steps: int) -> Column:
    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"),
            F.floor((s["j"] + 1).cast("double") * ratio).cast("long").alias("j"),
        )
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, jump)


def with_jump_hash(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Add ``name``: the shard (int, 0 to shards - 1) of a long key. A null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    hi, lo = _halves(F.col(key))
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    out = df.withColumn("__walk", _walk(start, shards, min(USUAL_JUMPS, shards)))
    rest = _walk(F.col("__walk"), shards, shards)["b"]
    return out.withColumn(name, F.when(F.col("__walk.j") >= shards, F.col("__walk.b")).otherwise(rest).cast("int")).drop("__walk")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """Shard, gapless slot within it, and the shard after one more is appended, for every row.

    ``buckets`` (a power of two) splits each shard for numbering: a row's slot is its rank in its bucket plus the rows
    of the buckets before, so no task orders a whole shard. Only ids, sizes and checksums are shuffled.

    Null text counts as empty (size 16, checksum 0); a null id is key 0; equal rows get different slots of one bucket;
    an empty table gives no rows; other columns of the input are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    base = base.select(
        "doc_id", (F.octet_length("__text") + 16).cast("long").alias("size"),
        F.crc32(F.encode("__text", "UTF-8")).alias("text_crc32"),
    )
    _, lo = _next(*_halves(F.col("doc_id")))
    rows = with_jump_hash(base, "doc_id", shards).withColumn("__bucket", F.shiftright(lo, 16).bitwiseAND(buckets - 1).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    if shards * buckets <= 1 << 16:  # rows of starts, whatever the input
        starts = F.broadcast(starts)
    rank = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("__rank", rank).join(starts, ["shard", "__bucket"], "left")
    return with_jump_hash(ranked, "doc_id", shards + 1, "grown_shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__start") + F.col("__rank") - 1).cast("long").alias("slot"), "grown_shard",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), SHARDS)


#: The checksum is CRC-32 over the text's UTF-8 bytes, table-driven; the walk is the published loop in HUGEINT arithmetic.
SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), walk AS (
  SELECT doc_id, n, (coalesce(doc_id, 0) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES ({SHARDS}), ({SHARDS + 1})) AS v(n)
  UNION ALL
  SELECT doc_id, n, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, ((k % 4294967296) * 2862933555777941757::HUGEINT + ((k >> 32) * (2862933555777941757::HUGEINT % 4294967296)) % 4294967296 * 4294967296 + 1) % 18446744073709551616::HUGEINT AS k2 FROM walk WHERE j < n)
), placed AS (
  SELECT doc_id, max(b) FILTER (n = {SHARDS} AND j >= n)::INTEGER AS shard, max(b) FILTER (n = {SHARDS + 1} AND j >= n)::INTEGER AS grown_shard FROM walk GROUP BY doc_id
), sized AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
    (((coalesce(doc_id, 0) % 4294967296)::HUGEINT * 2862933555777941757::HUGEINT + 1) % 4294967296 // 65536) % 1024 AS bucket
  FROM documents, crc_table
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.bucket, s.doc_id, s.text_crc32, s.size) - 1 AS slot, p.grown_shard
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""
