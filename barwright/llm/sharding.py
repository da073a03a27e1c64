"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into memory-sized buckets by a seeded hash; pass two permutes each bucket by
Fisher-Yates in one task. The buckets one after the other are a random order of all records, which shards cut into
runs of equal length (law ``rows``: counts differ by one at most).

Nulls: a null text counts no bytes and the CRC of the empty string; a null doc_id hashes by its text. Repeated rows get slots of their own.
A doc_id (or, where it is null, a text) that more than HOT rows have would fill one bucket: its rows are salted, and as all rows are settled with
their keys before the shuffle, a lost task finds the same salts again. An empty table gives an empty result. Columns of the documents keep their names; those added start
with ``shuffle_``. Bucket sizes follow the hash, so sources or copies with many rows spread like all others.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from barwright.llm.common import lookup, offsets, settle, text_of

#: Bytes of text that a bucket holds on average, and the number of buckets below which nothing is gained.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 256
#: Rows of one key beyond which they are dealt over all buckets.
HOT = 1024


def scatter(docs, seed, bucket_bytes=BUCKET_BYTES, least=LEAST_BUCKETS, hot=HOT):
    """``docs`` with shuffle_key, the seeded hash of the record, and shuffle_bucket; settled."""
    size = docs.agg(F.sum(F.octet_length(text_of()) + F.lit(1).cast("long"))).first()[0] or 0
    n = max(least, -(-size // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.when(F.col("doc_id").isNull(), F.col("text")))
    keyed = docs.withColumn("shuffle_key", key)
    many = settle(keyed.groupBy(F.col("shuffle_key").alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("_hot"))
    keyed = lookup(keyed, many, F.col("shuffle_key") == F.col("_hot"), limit=100_000)
    salted = F.when(F.col("_hot").isNotNull(), F.xxhash64("shuffle_key", F.monotonically_increasing_id())).otherwise(F.col("shuffle_key"))
    keyed = keyed.withColumn("shuffle_key", salted).drop("_hot")
    return settle(keyed.withColumn("shuffle_bucket", F.pmod("shuffle_key", F.lit(n)).cast("long")))


def permute_bucket(seed):
    def permute(bucket: pa.Table) -> pa.Table:
        """One bucket in a seeded Fisher-Yates order; records are first put in the order of their keys."""
        at = bucket["shuffle_bucket"][0].as_py()
        keys = bucket["shuffle_key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        rng = np.random.Generator(np.random.PCG64([seed, at]))
        for i in range(len(order) - 1, 0, -1):
            j = rng.integers(0, i + 1)
            order[i], order[j] = order[j], order[i]
        out = bucket.take(pa.array(order))
        return out.append_column("shuffle_rank", pa.array(np.arange(len(order)), pa.int64()))
    return permute


def external_shuffle(docs, seed=29, shards=8, **sizes):
    """The records in their shuffled order: ``docs`` with shuffle_shard, shuffle_slot and shuffle_position."""
    scattered = scatter(docs, seed, **sizes)
    counts = settle(scattered.groupBy("shuffle_bucket").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    starts = settle(offsets(counts, "shuffle_bucket", "_n").select(F.col("shuffle_bucket").alias("_bucket"), "before"))
    schema = T.StructType(scattered.schema.fields + [T.StructField("shuffle_rank", T.LongType())])
    permuted = scattered.groupBy("shuffle_bucket").applyInArrow(permute_bucket(seed), schema)
    placed = lookup(permuted, starts, F.col("shuffle_bucket") == F.col("_bucket"), "inner", 100_000)
    position = F.col("before") + F.col("shuffle_rank")
    placed = placed.withColumn("shuffle_position", position)
    placed = placed.withColumn("shuffle_shard", F.expr(f"shuffle_position * {shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shuffle_shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("shuffle_slot", F.col("shuffle_position") - first).drop("before", "_bucket", "shuffle_key", "shuffle_bucket", "shuffle_rank")


def write_shards(shuffled, path):
    """Write the shards as folders; a bucket's rows are one run of its shard, in order of their slots.

    No second shuffle: each task writes the buckets that it holds. A reader of a shard orders the files by their first slot.
    """
    shuffled.sortWithinPartitions("shuffle_position").write.partitionBy("shuffle_shard").parquet(path)


def query(spark, sf_dir):
    """All documents in 8 shards under the law ``rows``."""
    out = external_shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shuffle_shard").alias("shard"), F.col("shuffle_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
