"""The shared folder of a cluster, and cutting a plan's lineage there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch.
TEXTS_AT_ONCE = 1500


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one is made and set on a single machine; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cellgrid-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bounded(docs: DataFrame) -> DataFrame:
    """`docs`, whose whole texts go to Python: in batches of few rows, so that long texts do not add up. A size set by the user stays."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":  # Spark's own
        conf.set(key, str(TEXTS_AT_ONCE))
    return docs


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: a cut that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cellgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a frame made by `written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cellgrid-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tables(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """A table for each run of rows that are equal in the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        if held and any(held[0].column(k)[0].as_py() != c[0] for k, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = []
        for at, end in zip(edges, edges[1:], strict=False):
            if at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)
