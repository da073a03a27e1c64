"""Writers: appends, idempotent daily snapshots and keyed merges."""

from pyspark.sql import functions as F

from barwright.session import exists

JOURNAL_FIELDS = ["timestamp", "mode", "ticker", "action", "qty", "status", "reasoning", "order_id", "error"]


def journal_rows(df):
    """What a run adds to the journal: nine fields of everything that was not skipped."""
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in JOURNAL_FIELDS]
    return df.filter(F.coalesce(F.col("status"), F.lit("")) != "skipped").select(*have)


def append_journal(df, path):
    journal_rows(df).withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def append_json(df, path):
    """Append records (alerts, experiments, runs) as JSON lines, stamped if they have no timestamp."""
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.current_timestamp())
    df.write.mode("append").json(path)


def merge_keep_existing(old, new, key):
    """Existing rows win on the key; duplicates inside the new batch stay."""
    keys = [key] if isinstance(key, str) else list(key)
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def merge_snapshots(old, new, force=False):
    """One snapshot per account and date: the old one stays unless forced."""
    keys = ["account", "date"]
    return merge_keep_existing(new, old, keys) if force else merge_keep_existing(old, new, keys)


def write_snapshots(df, path, force=False):
    """Daily snapshots, one per account and date: the old one stays unless ``force`` replaces it.

    Folders are months, so that a day of few accounts is not a file of its own. Only the months of the new rows are read,
    and with ``force`` rewritten, old rows together with new ones.
    """
    spark = df.sparkSession
    df = df.withColumn("month", F.trunc("date", "month"))
    if not exists(spark, path):
        df.repartition("month").write.partitionBy("month").parquet(path)
        return
    old = spark.read.schema(df.schema).parquet(path).join(df.select("month").distinct(), "month", "left_semi").select(*df.columns)
    if force:
        merge_snapshots(old, df, True).repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    else:
        new = df.join(old.select("account", "date"), ["account", "date"], "left_anti").select(*df.columns)
        new.repartition("month").write.mode("append").partitionBy("month").parquet(path)
