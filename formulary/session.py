"""Session helpers: nothing here builds a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cores: str = "*") -> SparkSession:
    """Session for tests and the bench; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local-mode session may fall back to a folder of its own machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root is None and sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="formulary-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, in the subfolder of this application.

    That subfolder can be removed once the application has ended.
    """
    app = f"formulary-{spark.sparkContext.applicationId}"
    return f"{shared_dir(spark).rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Written table in the shared folder, read back: lineage ends here and columns can still be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes partitions and row order, and survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    files, at = _file_system(spark, path)
    files.create(at, True).close()


def drop_scratch(spark: SparkSession) -> None:
    """Removes what this application wrote in the shared folder. Tables that still read it end here."""
    files, at = _file_system(spark, f"{shared_dir(spark).rstrip('/')}/formulary-{spark.sparkContext.applicationId}")
    files.delete(at, True)
