"""Shards by jump consistent hashing: a stable key decides, and no table of shards exists.

When one shard is appended, only the rows that move into it move at all. Everything
is plain column arithmetic; unsigned 64-bit products are taken in 16- and 32-bit
parts, because the session may treat overflow as an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.llm.common import columns_or_raise
from veilgauge.session import materialise

# Fixed values of the published algorithm: the multiplier of its generator, and the width of its step.
MULTIPLIER = 2862933555777941757
STEP = float(1 << 31)
#: The number of jumps is about ln(shards); more than this has a chance below 1e-60.
MAX_JUMPS = 128
KEY_BITS = 60
#: Buckets per shard for numbering rows; a bucket is a range of the key.
BUCKET_BITS = 12
#: Copies of one row that a task writes in one go.
CHUNK = 100_000
LOW32 = (1 << 32) - 1


def stable_key(key: Column) -> Column:
    """60 bits of the digest of the key's text; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64 in 32-bit halves."""
    m = [MULTIPLIER >> s & 0xFFFF for s in (0, 16, 32, 48)]
    low, high = lo * m[0] + 1, lo * m[1]
    new_lo = low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)
    part = lambda x, a, b: (x * a).bitwiseAND(LOW32) + F.shiftleft((x * b).bitwiseAND(0xFFFF), 16)
    new_hi = F.shiftright(new_lo, 32) + F.shiftright(high, 16) + part(hi, m[0], m[1]) + part(lo, m[2], m[3])
    return new_hi.bitwiseAND(LOW32), new_lo.bitwiseAND(LOW32)


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard among `shards`, and among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    jumps = min(shards, MAX_JUMPS)

    def step(state: Column, _: Column) -> Column:
        hi, lo = _next(state["hi"], state["lo"])
        after = F.floor((state["j"] + 1) * (F.lit(STEP) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(state["j"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"),
                                                   after.cast("long").alias("j"))).otherwise(state)

    start = F.struct(F.shiftright(key, 32).alias("hi"), key.bitwiseAND(LOW32).alias("lo"),
                     F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    end = lambda s: F.struct(
        F.when(s["j"] >= shards, s["b"]).otherwise(F.raise_error(F.lit("too many jumps"))).cast("int").alias("shard"),
        F.when(s["j"] == shards, F.lit(shards)).otherwise(s["b"]).cast("int").alias("grown"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), start, step, end)


def shard(rows: DataFrame, key: str, order: list[str], shards: int) -> DataFrame:
    """Rows with `shard`, `grown_shard` (with one more shard) and `slot`, gapless from 0 in each shard.

    Slots follow the hashed key and then `order`; these columns must tell rows apart
    as far as anything does: rows equal in all columns are interchangeable. Equal rows
    are counted before they are dealt, so that a key that holds a third of all rows
    meets as one row, and its copies are written by many tasks again. Rows with a null
    key share a shard.
    """
    columns_or_raise(rows, key, *order)
    columns = rows.columns
    keyed = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    keyed = keyed.withColumn("_key", stable_key(F.col(key))).withColumn("_jump", jump(F.col("_key"), shards))
    keyed = keyed.select(*columns, "_copies", "_key", F.col("_jump.shard").alias("shard"),
                         F.col("_jump.grown").alias("grown_shard"),
                         F.shiftright("_key", KEY_BITS - BUCKET_BITS).alias("_bucket"))
    keyed, _ = materialise(keyed)
    held = keyed.groupBy("shard", "_bucket").agg(F.sum("_copies").alias("_held"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("shard", "_bucket", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_base"))
    inside = (Window.partitionBy("shard", "_bucket").orderBy("_key", *order, *[c for c in columns if c not in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.join(bases, ["shard", "_bucket"]).select(
        *columns, "shard", "grown_shard", "_copies",
        (F.col("_base") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))).alias("_first"))
    placed, _ = materialise(placed)
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(CHUNK).cast("long")))
    many = (placed.where(F.col("_copies") > CHUNK)
            .select("*", chunks.alias("_from")).repartition("shard", F.col("_first") + F.col("_from")))
    parts = placed.where(F.col("_copies") <= CHUNK).withColumn("_from", F.lit(0).cast("long")).unionByName(many)
    here = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_copies") - F.col("_from"), F.lit(CHUNK)) - 1))
    return parts.select(*columns, "shard", "grown_shard", "_first", "_from", here.alias("_at")).select(
        *columns, "shard", "grown_shard", (F.col("_first") + F.col("_from") + F.col("_at")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents by `doc_id`: size and checksum of the whole text, shard, slot and shard after growth.

    A null text has size 1 and the checksum of no bytes.
    """
    columns_or_raise(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, "doc_id", ["doc_id", "size", "text_crc32"], shards)
