"""Session settings the jobs rely on, and the few size and lineage helpers shared by them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side joined by broadcast has at most this many rows, checked before the hint is given.
BROADCAST_ROWS = 100_000


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job assumes; all of them may be set on a running session."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "townledger") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="townledger-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if the frame has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def settled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A small derived frame worked out once, as rows; a larger one stays the plan it is.

    At most ``rows + 1`` rows are fetched, as a broadcast of the frame would do anyway. Joins that
    read the frame several times then neither recompute it nor guess its size.
    """
    table = df.limit(rows + 1).toArrow()
    return df if table.num_rows > rows else df.sparkSession.createDataFrame(table, df.schema)


def worked_out(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A derived frame worked out once: as rows if it is small, else kept in the shared folder."""
    out = settled(df, rows)
    return cut_lineage(df) if out is df else out


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose size was checked; beyond the bound the shuffle join stays."""
    out = settled(df, rows)
    return df if out is df else F.broadcast(out)


def left_join(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 4096) -> DataFrame:
    """Left join on a reference that many rows leave blank or null.

    Such rows find nothing; so that they do not meet in one task, each takes one of ``salts`` names that no row of ``right``
    has, chosen by its column ``by``. Keys of ``right`` that are blank are never found.
    """
    blank_ = F.coalesce(F.col(key), F.lit("")) == ""
    name = F.when(blank_, F.concat(F.lit("\0"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("string"))).otherwise(F.col(key))
    return left.withColumn("_key", name).join(right.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over all cores by key if the scan yields fewer partitions than that.

    A small file with one row group is read by one task; for work per row that costs far more than
    reading, the short shuffle pays. On inputs with many files this changes nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
