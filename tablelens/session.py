"""Session helpers: sessions, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, types as T


def local_session(cores: int | str = "*", app: str = "tablelens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master,
    where all executors share one disk, may fall back to a folder of its own
    below the session's warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{warehouse}/scratch-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Later passes see the same rows in the same partitions, and losing an
    executor does not recompute (or re-sample) anything.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


# Tables of at most so many bytes are worth a copy that all cores can scan.
SMALL_BYTES = 2 << 30


def evenly(df: DataFrame) -> DataFrame:
    """A small table that is scanned many times, dealt over all cores; a large one as it is.

    A file of one row group is read by one task however many cores there are.  The
    copy lies below the shared folder; rows and types are the same.
    """
    odd = (T.NullType, T.CalendarIntervalType, T.VariantType)
    if len(set(map(str.lower, df.columns))) < len(df.columns) or not df.columns or any(isinstance(f.dataType, odd) for f in df.schema.fields):
        return df
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL_BYTES:
        return df
    spark = df.sparkSession
    path = scratch_path(spark, "even")
    df.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
