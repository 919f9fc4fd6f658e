"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in all operators here: space and the control characters 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """The words of a string column as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark.sparkContext, "_tidemark_dir", None)
    if made is None:
        made = spark.sparkContext._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return made


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back: a cut of lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now; it acts only on what the driver's JVM has
    found unreachable, which would else wait for its next full collection. Events that listeners have yet to take hold
    the last step's plan, and with it its shuffle files."""
    gc.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    # The first collection only ends what the cleaner's references hang on.
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
