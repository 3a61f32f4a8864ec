"""Tables in the folder that all machines of a cluster share.

Iterative operators cut their lineage by writing a table there and reading it back: such a table outlives any
executor, and later steps that read it do not compute it again.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a single machine (``local[...]``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    # The table stands for the shuffles that made it; once unreferenced, Spark's cleaner deletes their files.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote; only for tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_llm_path", None)
        if path:
            jvm, jsc = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
