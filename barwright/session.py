"""Session defaults. Every setting is a default only: what the cluster already set is kept."""

from pyspark.sql import SparkSession


def local_session(cores="8", app="barwright"):
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # wide window plans compile many small classes: keep them all instead of the default hundred
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark):
    """The folder all executors share, as the cluster names it; None where none is set."""
    return spark.conf.get("spark.checkpoint.dir", None)


def exists(spark, path):
    """Whether there is something at a path of any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def scratch_dir(spark):
    """Where streams keep what they hand over: the shared folder, or the folder of tables on the default file system.

    Never a folder of the driver alone.
    """
    return shared_dir(spark) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
