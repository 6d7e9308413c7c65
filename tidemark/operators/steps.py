"""Results that later steps read again: checkpoints and tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows that may be broadcast.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only a local session that names none gets one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder, so that a lost executor costs no more than a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept as a table in the shared folder. Unlike a checkpoint it forgets what it was made of, also its estimated
    size: in rounds that join what they made before, estimates would otherwise multiply until the planner does nothing else."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
