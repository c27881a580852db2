"""Session helpers: configuration for tests and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brightrow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own;
    a cluster without it is an error, since a driver-local folder would be
    unreadable to the executors.
    """
    folder = _setting(spark, "spark.checkpoint.dir")
    if folder:
        return folder
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="brightrow-")
    return _LOCAL_FOLDERS[application]


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a table in the shared folder; survives lost executors.

    The files go with :func:`free`, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/brightrow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Delete the files of :func:`durable` tables that no later read needs; others are left alone."""
    for table in tables:
        path = getattr(table, "_durable_path", None)
        if path is not None:
            target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def durable_partitions(df: DataFrame) -> DataFrame:
    """As :func:`durable`, for data whose partitions and row order must stay as they are."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
