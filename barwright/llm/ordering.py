"""Training-order materialisation by a keyed permutation.

Documents become sequences of at most 512 ids, numbered once: the written table carries the task that made a sequence
and its place there, and running counts of the tasks make the number global. A keyed Feistel network over the next even power
of two, walked along its cycle until it lands below the number of sequences, gives every sequence its global slot. Shards are ranges of
slots; tasks take ranges of them, and each shard is written by one task, in order, as records of a fixed stride, so that a reader finds slot s at record
s mod SHARD of shard s div SHARD and resumes there without reading what comes before.

No state but the key and the count is needed to know where any sequence lies, and slots are spread evenly whatever the input.

Nulls: a null or blank text is one sequence with the end id alone; a null doc_id stays null. Repeated rows are sequences each.
An empty table gives an empty result. Other columns are not looked at.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F, types as T

from barwright.llm.common import lookup, new_path, offsets, settle
from barwright.llm.subwords import VOCABULARY, shared

STRIDE = 512
END = 1
#: Sequences in a shard.
SHARD = 16_384
ROUNDS = 6
SEQUENCES = "doc_id long, seq int, n_ids int, ids binary, task long, at long"


def _mix(x, key):
    """A round function: splitmix64 finaliser of the half and a round key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index, n, key, rounds=ROUNDS):
    """Images of ``index`` (numbers below n) under the keyed permutation of 0 .. n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 63, rounds)]
    out = np.asarray(index).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walk] = (left << h) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def cut_partition(vocabulary, stride):
    """Rows of SEQUENCES from (doc_id, text bytes); ids are little-endian unsigned 16-bit integers."""
    def run(batches):
        words, task, at, end = shared(vocabulary, "H"), TaskContext.get().partitionId(), 0, np.uint16(END).tobytes()
        for b in batches:
            texts = [t or b"" for t in b.column("_text").to_pylist()]
            doc, seq, length, cut = [], [], [], []
            for i, ids in zip(b.column("doc_id").to_pylist(), words.of_texts(texts)):
                ids += end
                for k in range(0, len(ids), 2 * stride):
                    doc.append(i)
                    seq.append(k // (2 * stride))
                    cut.append(ids[k:k + 2 * stride])
                    length.append(len(cut[-1]) // 2)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(seq, pa.int32()), pa.array(length, pa.int32()), pa.array(cut, pa.binary()),
                                   pa.array(np.full(len(doc), task)), pa.array(np.arange(at, at + len(doc)))], ["doc_id", "seq", "n_ids", "ids", "task", "at"])
            at += len(doc)
    return run


def sequences(docs, vocabulary=VOCABULARY, stride=STRIDE):
    """The documents' sequences, written once to the shared folder; what numbers them is in the table."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    path = new_path(docs.sparkSession, "sequences")
    src.mapInArrow(cut_partition(vocabulary, stride), SEQUENCES).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def slots(seqs, key):
    """(``seqs`` with slot, their number); rows keep their ids in the JVM, only their numbers pass through Python."""
    counts = settle(offsets(seqs.groupBy("task").agg(F.count(F.lit(1)).alias("_n")), "task", "_n"))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    number = lookup(seqs, counts.select(F.col("task").alias("_task"), "before"), F.col("task") == F.col("_task"), "inner", 100_000)

    def place(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), n, key))
    slot = F.pandas_udf(place, T.LongType())
    return number.withColumn("slot", slot(F.col("before") + F.col("at"))).drop("_task", "before", "task", "at"), n


def write_order(docs, path, key=41, per_shard=SHARD, stride=STRIDE):
    """Write all sequences in their training order as shards of fixed-stride records (slot, doc_id, seq, n_ids, ids).

    Tasks are ranges of shards, as many as there are shards, so both grow with the input and no shard is split between tasks.
    """
    placed, total = slots(sequences(docs, stride=stride), key)
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    full = placed.withColumn("shard", shard).withColumn("ids", F.rpad("ids", F.lit(2 * stride), F.lit(b"\x00")))
    full.repartitionByRange(max(1, -(-total // per_shard)), "shard").sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


SHARDS = "slot long, doc_id long, seq int, n_ids int, ids binary, shard long"


def read_order(spark, path, start=0, per_shard=SHARD):
    """The records from slot ``start`` on: earlier shards are pruned, earlier records of its shard skipped by statistics."""
    return spark.read.schema(SHARDS).parquet(path).where((F.col("shard") >= start // per_shard) & (F.col("slot") >= start))


def query(spark, sf_dir):
    """Where each sequence of all documents lies, read back from the shards written."""
    path = new_path(spark, "order")
    write_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    out = read_order(spark, path)
    return out.select("doc_id", "seq", "slot", "shard", (F.col("slot") % SHARD).alias("record"), "n_ids", F.octet_length("ids").cast("long").alias("stride"), F.crc32("ids").alias("ids_crc32"))
