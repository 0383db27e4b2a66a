"""Shards by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

#: Bits of the key's hash that the directory can use; then bits of the row's own hash follow.
BITS = 60


def key_hash(key: str) -> Column:
    """The key's first 60 bits of MD5, as a bigint; null counts as the empty key."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def _split(leaves: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Adds the depth and bytes of the bucket in which each leaf ends.

    ``leaves`` has (k, p, bytes): p is the prefix of ``high`` bits within key k.
    A bucket is split on another bit as long as it exceeds the limit, so a leaf
    ends at the least depth at which its bucket fits; null if none does.
    """
    at = leaves.select("k", "p", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    at = at.withColumn("q", F.expr(f"shiftright(p, {high} - depth)"))
    fits = at.groupBy("k", "depth", "q").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    ends = at.join(fits, ["k", "depth", "q"]).groupBy("k", "p").agg(F.min(F.struct("depth", "shard_bytes")).alias("end"))
    return leaves.join(ends, ["k", "p"], "left").select("k", "p", "end.depth", "end.shard_bytes")


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, shard (its address in bits), depth, shard_bytes, over_limit.

    The directory is addressed by bits of a hash of the key. It starts a few bits
    short of what equal shards would need; only buckets over ``limit`` bytes are
    split on another bit. Sums per prefix are taken first (a few for each
    shard), so a bucket with a third of all rows is one number by the time it
    meets others; only rows of buckets that are still too large at the expected
    depth are summed by their full hash. A key that is too large alone is split
    further by bits of a hash of the row's position, which was stored with it.

    A document larger than the limit ends in a shard of its own, marked
    over_limit. Null text has 0 bytes; a null key is hashed as the empty key.
    Repeated rows are rows of their own. Other columns are ignored. An empty
    table gives no rows.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(key).alias("key"), key_hash(key).alias("h"), size.alias("n_bytes"))
    rows = stored(rows.withColumn("r", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)), "keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    need = math.floor(math.log2(max(1, total / limit)))
    low, high = min(BITS, max(0, need - 3)), min(BITS, need + 4)

    rows = rows.withColumn("p", F.shiftright("h", BITS - high))
    coarse = rows.groupBy(F.lit(0).cast("bigint").alias("k"), "p").agg(F.sum("n_bytes").alias("bytes"))
    coarse = stored(_split(coarse, low, high, limit), "directory").drop("k")
    rows = rows.join(coarse, "p")
    ended = rows.where(F.col("depth").isNotNull()).withColumn("address", F.expr(f"shiftright(p, {high} - depth)"))
    ended = ended.withColumn("shard", _bits("address", "depth"))

    deep = rows.where(F.col("depth").isNull()).drop("depth", "shard_bytes")
    fine = deep.groupBy("h").agg(F.sum("n_bytes").alias("bytes"), F.first("p").alias("k"))
    fine = _split(fine.select("k", F.col("h").alias("p"), "bytes"), high + 1 if high < BITS else BITS, BITS, limit)
    deep = deep.join(fine.select(F.col("p").alias("h"), "depth", "shard_bytes"), "h")
    fitting = deep.where(F.col("depth").isNotNull()).withColumn("address", F.expr(f"shiftright(h, {BITS} - depth)"))
    fitting = fitting.withColumn("shard", _bits("address", "depth"))

    # one key over the limit: bits of the row's own hash
    single = deep.where(F.col("depth").isNull()).drop("depth", "shard_bytes")
    span = min(BITS, need + 8)
    single = single.withColumn("own", F.shiftright("r", BITS - span))
    leaves = single.groupBy(F.col("h").alias("k"), F.col("own").alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    split = _split(leaves.drop("n"), 1, span, limit).select(F.col("k").alias("h"), F.col("p").alias("own"), "depth", "shard_bytes")
    single = single.join(split, ["h", "own"]).withColumn("whole", F.coalesce("depth", F.lit(BITS)))
    # at the last bits a shard still too large holds single documents over the limit, each kept whole
    single = single.withColumn("address", F.when(F.col("depth").isNull(), F.col("r")).otherwise(F.expr(f"shiftright(own, {span} - depth)")))
    single = single.withColumn("shard", F.concat(_bits("h", F.lit(BITS)), _bits("address", "whole")))
    single = single.withColumns({"depth": F.lit(BITS) + F.col("whole"), "shard_bytes": F.coalesce("shard_bytes", "n_bytes")})

    out = ["key", "n_bytes", "shard", "depth", "shard_bytes"]
    all_rows = ended.select(out).unionByName(fitting.select(out)).unionByName(single.select(out))
    return all_rows.select(F.col("key").alias(key), "n_bytes", "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("over_limit"))


def _bits(value: str, width) -> Column:
    """``value`` as a string of ``width`` binary digits."""
    width = F.col(width) if isinstance(width, str) else width
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(F.col(value)), width, F.lit("0")))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes each document under ``path/shard=<bits>``; for tables whose keys are unique.

    A shard is within the byte limit, so one task writes it.
    """
    named = shards.select(key, F.concat(F.lit("b"), "shard").alias("shard"))
    docs.join(named, key).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int) -> str:
    """The assignment over ``documents`` as DuckDB SQL, where no key exceeds the limit alone."""
    return f"""with r as (select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, {BITS // 4}) as bigint) as h from documents),
 low as (select cast(greatest(0, floor(log2(greatest(1, sum(n_bytes) / {limit}))) - 3) as bigint) as low from r),
 a as (select doc_id, n_bytes, h, depth, h >> ({BITS} - depth) as q
  from r, low, lateral (select cast(unnest(generate_series(low, {BITS})) as bigint) as depth)),
 s as (select depth, q, cast(sum(n_bytes) as bigint) as shard_bytes from a group by all having sum(n_bytes) <= {limit}),
 e as (select a.doc_id, a.h, any_value(a.n_bytes) as n_bytes, min(a.depth) as depth, arg_min(s.shard_bytes, a.depth) as shard_bytes,
  arg_min(a.q, a.depth) as q from a join s on a.depth = s.depth and a.q = s.q group by 1, 2)
 select doc_id, n_bytes, case when depth = 0 then '' else lpad(bin(q), cast(depth as int), '0') end as shard,
  cast(depth as int) as depth, shard_bytes, false as over_limit from e"""
