"""Session helpers: where shared scratch tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fitgrain")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fitgrain-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark)}/fitgrain/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, dealt out to all cores.

    Only small inputs are moved: a large scan has more partitions than cores.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and fixes values
    that depend on the physical partitioning.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, label: str, key: str, then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """As ``written``, dealt by ``key`` to as many buckets as a shuffle has partitions: a later join by it moves only the other side.

    ``then`` is applied to the dealt rows and keeps the key. The session's
    catalog holds the table only until it is read back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    then(df.repartition(buckets, key)).write.bucketBy(buckets, key).saveAsTable(name, format="parquet", path=path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files are outside the warehouse and stay
    return out
