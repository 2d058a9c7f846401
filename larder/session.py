"""Session settings and the shared work folder.

Intermediate tables that are read more than once are written to the folder the
cluster names in ``spark.checkpoint.dir``.  A written table survives the loss
of an executor, cuts the lineage, and gives Catalyst an exact size to choose
broadcast or shuffle joins by.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Settings the jobs in this package are planned for.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "larder",
                  **conf) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="larder-warehouse-"),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs: dict[str, str] = {}  # of local applications without the setting
_tables: dict[str, list[str]] = {}  # catalogue names of an application's bucketed tables


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the cluster's checkpoint folder."""
    application = spark.sparkContext.applicationId
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
        if application not in _local_dirs:
            _local_dirs[application] = tempfile.mkdtemp(prefix="larder-work-")
        root = _local_dirs[application]
    return f"{root.rstrip('/')}/larder-{application}"


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_parted(df: DataFrame, label: str, key: str
                       ) -> tuple[DataFrame, dict[int, tuple[str, ...]]]:
    """Write ``df`` with a folder for every value of ``key``, a number, and read it back;
    the files of every value as well, for tasks that read them by themselves."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.repartition(key).write.partitionBy(key).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(df.columns)
    files: dict[int, tuple[str, ...]] = {}
    for uri in sorted(stored.inputFiles()):
        value = int(uri.rsplit("/", 2)[1].split("=")[1])
        files[value] = (*files.get(value, ()), uri)
    return stored, files


def materialise_bucketed(df: DataFrame, label: str, key: str, buckets: int,
                         order: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """Write ``df`` hash-bucketed by ``key`` and sorted by ``order`` in each bucket.

    Later groupings and joins that include ``key`` need no exchange; filters on
    ``order`` skip the pages that cannot match.  ``placed``: ``df`` is already
    partitioned that way.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    name = "larder_" + path.rsplit("/", 1)[1].replace("-", "_")
    writer = (df if placed else df.repartition(buckets, key)).write.format("parquet").bucketBy(buckets, key)
    if order:
        writer = writer.sortBy(*order)
    writer.option("path", path).saveAsTable(name)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Drop this application's tables and delete its work folder."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when the input has fewer splits than there are cores.

    A large table already has enough splits and passes through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
