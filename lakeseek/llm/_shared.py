"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.batches import BATCH_BYTES, small_batches, tidied  # noqa: F401

#: Bytes of a row group of an intermediate table.
GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, a temporary folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakeseek-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakeseek-{uuid.uuid4().hex}"


def file_system(uri: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps: it does so once nothing on the driver refers to them.

    The threads that hand out Spark's events keep the last one, which after a
    step holds its plan; so they first get those of a job without tasks.
    """
    gc.collect()
    context = spark.sparkContext._jsc
    context.emptyRDD().count()
    try:
        context.sc().listenerBus().waitUntilEmpty(5_000)
    except Py4JJavaError:  # other events keep coming: files go with a later step
        pass
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that ``written`` made, or paths."""
    for t in tables:
        for p in [t] if isinstance(t, str) else t.inputFiles()[:1]:
            root = p if isinstance(t, str) else p.rsplit("/", 2)[0]
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
