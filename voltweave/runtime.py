"""Session settings shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def local_default(spark: SparkSession) -> None:
    """Give a session on this one machine (tests, bench) a folder where it names none itself."""
    sc = spark.sparkContext
    if sc.master.split("[")[0] == "local" and not sc.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voltweave-"))


#: Has shuffle files removed when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Materialise an intermediate result as a table in the shared folder and go on from its scan.

    A lost executor then replays nothing before this point, later reads are columnar and pruned, and
    the planner knows the true size. The shuffle files behind the table are needed no more once it is written,
    so they go at its end and don't pile up on the executors' disks. With ``tasks``, the shuffles that Spark adds behind the table
    have that many tasks, which are not merged, whatever the session's number, and scans are split as finely where row groups
    allow it (a shuffle of more than 200 tasks sorts what a scan's task sends); so the rows of a task can be kept at any size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    settings = {CLEANUP: "true"}
    if tasks:
        settings |= {
            "spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.minPartitionNum": str(tasks)}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("cut-"):
                raise ValueError(f"no intermediate table: {folder}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
