"""Helpers shared by the operators of this subpackage."""

import os
import tempfile

from pyspark.sql import functions as F

#: The characters that separate words: space and x09 to x0D.
BLANKS = "\t\n\x0b\x0c\r "
GAP = r"[\x20\x09-\x0D]+"


def let(value, use):
    """``use`` applied to ``value``, which is evaluated once however often the lambda names it."""
    return F.transform(F.array(value), use)[0]


def text_of(c="text"):
    """The text, empty where null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(text):
    """Array of the runs of non-blank characters; empty for blank or null texts."""
    t = F.btrim(text_of(text), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP))


def windows_of(ws, n):
    """Hashes of all ``n``-word windows of a word array (a lambda variable or a column); needs ``n`` words."""
    return F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))


def parts(batches, rows=500):
    """Arrow batches of at most ``rows`` rows each, so that a worker turns few texts into Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def shared_folder(spark):
    """The folder that the cluster names for shared files; one of our own only where none is set, on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def settle(df):
    """The rows of ``df``, computed once and kept in the shared checkpoint folder.

    What follows neither repeats the work nor depends on executors that may go; Spark's cleaner removes the files.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark, name):
    """A fresh path in the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{os.urandom(8).hex()}")


def lookup(df, table, on, how="left", limit=10_000):
    """Join with a settled ``table`` whose size is checked: broadcast up to ``limit`` rows, shuffled beyond it.

    A shuffled join has no operator above it that needs its keys together, so Spark can split hot keys.
    """
    few = table.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(table) if few else table, on, how)


def offsets(counts, key, n, block=1024):
    """Number of rows before each key: ``counts`` (key long from 0, n long) gains ``before`` in order of the key.

    Two levels, so that no window holds more than ``block`` keys or one row per block.
    """
    from pyspark.sql import Window
    c = counts.select(F.col(key).alias(key), F.col(n).alias(n), F.expr(f"{key} div {block}").alias("_block"))
    tops = c.groupBy("_block").agg(F.sum(n).alias("_n"))
    tops = tops.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_above"))
    inside = F.sum(n).over(Window.partitionBy("_block").orderBy(key)) - F.col(n)
    return c.withColumn("_in", inside).join(tops, "_block").select(key, n, (F.col("_in") + F.col("_above")).alias("before"))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
