"""Two-pass external shuffle into shards.

The first pass scatters records into buckets small enough for memory: a seeded hash of the id
decides the shard (the highest of one hash per shard wins, so a further shard takes rows only into
itself), and a seeded hash of the whole record decides the bucket inside the shard. The second pass
puts each bucket in a fixed order, shuffles it by a seeded Fisher-Yates shuffle and writes it. The
same records, seed and shard count give the same order, also when a lost task runs again.

The law is ``key``: id and shard count alone decide the shard. Null ids share one shard, null texts
count no bytes, repeated rows stay, and an empty table gives empty shards. Records travel inside one
struct column, so names of their columns can't clash with the ones added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BUCKET_BYTES = 32 << 20
SEED = 42
# One row for each of so many buckets is small enough to broadcast; beyond, the join shuffles.
BROADCAST_BUCKETS = 1_000_000


def shard_of(id_col: Column, shards: int, seed: int = SEED) -> Column:
    """Shard by highest random weight: grows by moving rows into the new shard only."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), id_col).alias("w"), F.lit(i).alias("s"))
               for i in range(shards)]
    return F.greatest(*weights)["s"] if shards > 1 else F.lit(0)


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_shards(df: DataFrame, shards: int, path: str, *, id_col: str = "doc_id",
                   text_col: str = "text", seed: int = SEED,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``df`` shuffled under ``path``, one folder per shard, and return what was written.

    Columns: record (the row as a struct), bucket, position (in the bucket), slot (in the
    shard, gapless from 0) and shard.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    total = df.agg(F.sum(record_bytes(df[text_col].cast("string")))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    hashable = [df[f.name] for f in df.schema.fields
                if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    mixed = F.xxhash64(F.lit(seed + 1), *hashable)
    scattered = df.select(F.struct("*").alias("record"), shard_of(df[id_col], shards, seed)
                          .alias("shard"), mixed.alias("mixed")).select(
        "record", "shard", "mixed", (F.col("shard").cast("long") * per_shard + F.pmod(
            F.xxhash64(F.lit(seed + 2), "mixed"), F.lit(per_shard))).alias("bucket"))

    def fisher_yates(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        fixed = np.argsort(table.column("mixed").to_numpy(), kind="stable")
        draw = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(fixed))
        out = table.take(pa.array(fixed[draw])).select(["record", "shard", "bucket"])
        return out.append_column("position", pa.array(np.arange(len(fixed))))

    schema = T.StructType([
        T.StructField("record", scattered.schema["record"].dataType),
        T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.LongType()),
        T.StructField("position", T.LongType())])
    (scattered.groupBy("bucket").applyInArrow(fisher_yates, schema)
     .write.partitionBy("shard").parquet(path))
    written = df.sparkSession.read.schema(T.StructType(
        [schema["record"], schema["bucket"], schema["position"], schema["shard"]])).parquet(path)
    # one row per bucket: the buckets of a shard follow each other
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = written.groupBy("shard", "bucket").agg(F.count("*").alias("rows")).select(
        F.col("bucket").alias("_bucket"), F.coalesce(F.sum("rows").over(before), F.lit(0))
        .alias("_before"))
    if shards * per_shard <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    return written.join(offsets, F.col("bucket") == F.col("_bucket")).select(
        "record", "bucket", "position", (F.col("_before") + F.col("position")).alias("slot"),
        "shard")


def shard_digest(written: DataFrame, shards: int, *, id_col: str = "doc_id",
                 text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Id, size, checksum and place of each written record, and its place with one more shard."""
    key, text = F.col("record")[id_col], F.col("record")[text_col].cast("string")
    return written.select(
        key.alias(id_col), record_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot",
        shard_of(key, shards + 1, seed).alias("grown_shard"), "bucket")
