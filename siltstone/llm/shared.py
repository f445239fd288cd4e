"""Session helpers of the llm operators: the shared folder, written intermediate tables, input preparation."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of one Arrow batch; with long texts the default of 10,000 would hold too many bytes.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable in the workers, keeps them to one thread and Arrow batches small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, "1")  # a task has one core
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in that of spark.checkpoint.dir, deleted when the driver ends.

    Where that is unset, a folder on this machine serves, but only if all executors run here too (tests).
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
        path = context.getCheckpointDir()
    own = f"{path.rstrip('/')}/llm-{context.applicationId}"
    if own not in _owned:
        _owned.add(own)
        atexit.register(_delete, spark, own)
    return own


_owned: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, if the session is still there to do it."""
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder: computed once, and lost executors don't make it recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """doc_id and text (null: empty) of docs; with row, also the whole row as _row, whatever its columns are called."""
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    return docs.select(*cols, *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")] if row else []))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
