"""Session and scratch-folder helpers shared by the whole library."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the intermediate tables that the innermost scratch() block of this thread has to delete; None outside of blocks.
_OPEN: ContextVar[list[str] | None] = ContextVar("tuneline_scratch", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that setting is absent in local mode (tests)
    a temporary folder is made and set as the checkpoint folder; on a cluster its absence is an
    error, because executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = getattr(spark, "_tuneline_scratch", None)
    if held is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(held)
        spark._tuneline_scratch = held
    return held


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside the block when it ends; results must have been written or collected by then.

    A block has the tables of its own thread, and not those of blocks inside it, which are gone before. Tables written
    outside of any block, as those of the registered queries and of corpus_pipeline.run, stay, since the
    result still reads them: whoever has the result deletes the folder ``tuneline`` below the shared one.
    """
    written: list[str] = []
    token = _OPEN.set(written)
    try:
        yield
    finally:
        _OPEN.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in written:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later stages read the table, and survive the loss of any executor. The
    table stays until the scratch() block around it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tuneline/{name}-{uuid.uuid4().hex}"
    if (written := _OPEN.get()) is not None:
        written.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share_file(spark: SparkSession, name: str, data: bytes) -> None:
    """Write ``data`` as a file of the shared folder and hand it to all executors, where ``SparkFiles.get(name)`` finds it.

    Names are given once a session. The file outlives scratch() blocks, because an executor that
    joins later fetches every file that was handed out before.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tuneline/{name}")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(at, False)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(system.makeQualified(at).toString())


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` naming the columns that ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
