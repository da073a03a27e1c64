"""Folders that are written once: a batch counts when its manifest entry is there, and only then.

Data goes to a folder of its own per attempt; a small entry, put in place by one rename that refuses to overwrite, makes it part of the table.
A task or driver that dies before that leaves files that no reader looks at, a batch that is replayed is skipped, and a replacement
takes effect whole or not at all. Entries are numbered; two writers that reach for one number cannot both have it, the second takes the next.
Needs a file system whose rename is atomic.
"""

import json
import uuid

from pyspark.sql import functions as F, types as T

from barwright.session import exists

ENTRY = "batch string, folder string, replaced array<string>"


def _files(spark, path):
    """A file context for the path's file system, and a maker of its paths."""
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), spark._jsc.hadoopConfiguration()), make


def entries(spark, path):
    """The manifest, oldest first, as dicts: number, batch, folder, replaced. One small file a batch."""
    if not exists(spark, f"{path}/manifest"):
        return []
    rows = spark.read.schema(ENTRY).json(f"{path}/manifest/*.json").select("*", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long").alias("number")).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["number"])


def publish(spark, path, batch, folder, replaced=None):
    """Put an entry in the manifest under the next free number; False if the batch has one already."""
    fc, make = _files(spark, path)
    never = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    line = json.dumps({"batch": batch, "folder": folder, "replaced": replaced})
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(draft)
    status = fc.util().globStatus(make(f"{draft}/part-*"))
    while True:
        have = entries(spark, path)
        if batch in {e["batch"] for e in have}:
            return False
        if not exists(spark, f"{path}/manifest"):
            fc.mkdir(make(f"{path}/manifest"), spark._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        number = have[-1]["number"] + 1 if have else 0
        try:
            fc.rename(status[0].getPath(), make(f"{path}/manifest/{number:012d}.json"), never)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise


def append_once(df, path, batch, part=None, replaced=None):
    """Append ``df`` as ``batch``: a batch that is published is skipped, whatever became of earlier attempts. True if it was written now.

    ``part`` names a column that splits the folders. With ``replaced``, a list of its values as strings, the rows take the place of all earlier ones
    in those parts.
    """
    spark = df.sparkSession
    if batch in {e["batch"] for e in entries(spark, path)}:
        return False
    folder = f"attempt={batch}-{uuid.uuid4().hex[:12]}"
    writer = df.withColumn("part", F.col(part).cast("string") if part else F.lit("all")).write.partitionBy("part")
    writer.parquet(f"{path}/data/{folder}")
    return publish(spark, path, batch, folder.removeprefix("attempt="), replaced)


def read_published(spark, path, schema):
    """The rows of all published batches: of a part, those from its last replacement on."""
    live, kept = entries(spark, path), []
    for at, e in enumerate(live):
        gone = sorted({p for later in live[at + 1:] for p in later["replaced"] or []})
        kept.append((e["folder"], gone))
    if not kept:
        return spark.createDataFrame([], schema)
    where = None
    for folder, gone in kept:
        one = F.col("attempt") == folder
        one = one & ~F.col("part").isin(gone) if gone else one
        where = one if where is None else where | one
    fields = spark.createDataFrame([], schema).schema.fields
    whole = T.StructType([*fields, T.StructField("attempt", T.StringType()), T.StructField("part", T.StringType())])
    return spark.read.schema(whole).parquet(f"{path}/data").where(where).select(*[f.name for f in fields])


def journal_once(rows, path, batch):
    """Journal rows (see :func:`sinks.journal_rows`) appended once per batch, by day."""
    return append_once(rows.withColumn("day", F.to_date("timestamp")), path, batch, "day")


SNAPSHOT_KEYS = ["account", "date"]


def snapshots_once(df, path, batch, schema, force=False):
    """Daily snapshots, one per account and date, as one published batch: the old one stays unless ``force`` replaces it.

    Only months of the new rows are read; with ``force`` they are replaced, old rows together with new ones, by one entry.
    """
    spark = df.sparkSession
    month = F.trunc("date", "month").cast("string")
    old = read_published(spark, path, schema).withColumn("month", month)
    new = df.withColumn("month", month)
    if not force:
        return append_once(new.join(old.select(*SNAPSHOT_KEYS), SNAPSHOT_KEYS, "left_anti"), path, batch, "month")
    months = sorted(r.month for r in new.select("month").distinct().collect())
    rest = old.where(F.col("month").isin(months)).join(new.select(*SNAPSHOT_KEYS), SNAPSHOT_KEYS, "left_anti")
    return append_once(rest.unionByName(new), path, batch, "month", months)
