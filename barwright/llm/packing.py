"""Hierarchical residual packing into sequences of at most 4096 tokens.

Each partition tokenises its documents, cuts only those longer than a sequence, and packs the pieces by best fit, longest
first. Bins that are nearly full are final. The underfull ones become items of the next level: groups of bounded size,
fewer at each level, pack them again by best fit until one group is left or a level no longer helps. A task never holds more than a
chunk of pieces or one group of bins, whatever the input.

Nulls: a null or blank text is one piece of a single end token. Repeated rows are packed each. A null doc_id stays
null. An empty table gives an empty result. Other columns of the documents are not looked at.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from barwright.llm.common import parts, settle
from barwright.llm.subwords import REMEMBERED, VOCABULARY, shared

ROOM = 4096
END = 1
#: A bin with at least so many tokens is final.
NEARLY = ROOM - 16
#: Pieces that a task packs at a time, and bins in a group of the tree.
CHUNK = 100_000
GROUP = 8192
#: Words that a Python worker remembers in the pipeline, where it and they stay while other stages need the memory.
STAGE_WORDS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"
MOVES = "bin long, into long, shift long, fill long"


def best_fit(lengths, room=ROOM):
    """Bin and offset of each item: longest first into the open bin with least room that takes it.

    Bins are kept by the room they have left; a bit mask of those rooms finds the tightest.
    """
    where, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room, mask, bins = [[] for _ in range(room + 1)], 0, 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                mask ^= 1 << left
        else:
            left, b, bins = room, bins, bins + 1
        where[i], at[i] = b, room - left
        left -= n
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return where, at


def pack_partition(vocabulary, room=ROOM, remembered=REMEMBERED):
    """Rows of PIECES from (doc_id, text bytes)."""
    def run(batches):
        words, task, packed, held = shared(vocabulary, remembered=remembered), TaskContext.get().partitionId(), 0, []
        last = np.uint32(END).tobytes()

        def pack():
            nonlocal packed
            doc, piece, start, length, crc = (list(x) for x in zip(*held))
            where, at = best_fit(length, room)
            out = pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                                   pa.array(crc, pa.int64()), pa.array((task << 40) + packed + where), pa.array(at)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at"])
            packed += int(where.max()) + 1
            held.clear()
            return out
        for b in parts(batches):
            texts = [t or b"" for t in b.column("_text").to_pylist()]
            for i, ids in zip(b.column("doc_id").to_pylist(), words.of_texts(texts)):
                ids += last
                for k, s in enumerate(range(0, len(ids), 4 * room)):
                    p = ids[s:s + 4 * room]
                    held.append((i, k, s // 4, len(p) // 4, zlib.crc32(p)))
            if len(held) >= CHUNK:
                yield pack()
        if held:
            yield pack()
    return run


def merge_groups(room=ROOM):
    """Best fit over a group of bins (bin, fill): which bin each goes into, and how far along."""
    def run(frames):
        frames = list(frames)
        if not frames:
            return
        f = pd.concat(frames).sort_values("bin", ignore_index=True)
        if len(f):
            where, at = best_fit(f["fill"].to_numpy(), room)
            head = f["bin"].groupby(where).first()
            total = f["fill"].groupby(where).sum()
            yield pd.DataFrame({"bin": f["bin"], "into": head.loc[where].to_numpy(), "shift": at, "fill": total.loc[where].to_numpy()})
    return run


def merge_tree(bins, group=GROUP, nearly=NEARLY, room=ROOM):
    """(bin, into, shift) for the bins that move: underfull bins (bin, fill) packed level by level."""
    open_ = bins.where(F.col("fill") < nearly)
    moved = settle(open_.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"), "fill"))
    n, level = moved.count(), 0
    while n > 1:
        todo = moved.where(F.col("fill") < nearly).groupBy(F.col("into").alias("bin")).agg(F.max("fill").alias("fill"))
        groups = -(-n // group)
        todo = todo.coalesce(1) if groups == 1 else todo.repartition(groups, F.xxhash64("bin", F.lit(level)))
        step = settle(todo.mapInPandas(merge_groups(room), MOVES).select(F.col("bin").alias("_bin"), F.col("into").alias("_into"), F.col("shift").alias("_shift"), F.col("fill").alias("_fill")))
        joined = moved.join(step, F.col("into") == F.col("_bin"), "left")
        moved = settle(joined.select("bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"), F.coalesce("_fill", "fill").alias("fill")))
        before, n = n, moved.where(F.col("fill") < nearly).select("into").distinct().count()
        level += 1
        if groups == 1 or n > 0.98 * before:
            break
    return moved


def pack(docs, vocabulary=VOCABULARY, remembered=REMEMBERED):
    """Pieces of all documents with sequence_id and offset."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    pieces = settle(src.mapInArrow(pack_partition(vocabulary, remembered=remembered), PIECES))
    moved = merge_tree(pieces.groupBy("bin").agg(F.sum("length").alias("fill")))
    moved = moved.select(F.col("bin").alias("_bin"), "into", "shift")
    out = pieces.join(moved, F.col("bin") == F.col("_bin"), "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"),
                      (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))


def stage(spark, docs, sf_dir):
    """Last stage of the pipeline: the packed pieces of its documents."""
    return pack(docs, remembered=STAGE_WORDS)


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
