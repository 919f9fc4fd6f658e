"""Steps of iterative operators, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .merge import shared_dir


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once and read back, which cuts its lineage, and the path to drop() when it is no longer read."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(df: DataFrame, path: str) -> None:
    context = df.sparkSession.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
