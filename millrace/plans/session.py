"""Session defaults and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with this engine's settings: UTC days, adaptive plans, exact column names."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.caseSensitive", "true").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the session's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the session's shared folder: computed once, read back, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def removed(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Only a local master has a default."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or "/tmp/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()
