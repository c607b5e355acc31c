"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the executors are threads of the driver (a local
    master), a temporary folder serves, which goes with the process.  On a
    cluster it has to be set: no folder of the driver's machine would do.
    """
    folder = spark.conf.get(FOLDER, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {FOLDER} to a folder that all executors can reach")
    if context.applicationId not in _own:
        made = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own[context.applicationId] = made
    return _own[context.applicationId]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark can reach it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Most rows in a file of a kept table.  Spark counts each file it opens as some megabytes
#: (``spark.sql.files.openCostInBytes``), so the rows of a split that reads the table are bounded as well.
FILE_ROWS = 12_500


def keep(frame: DataFrame, *order: str) -> DataFrame:
    """Compute an intermediate table once, for all that is made from it.

    It is written to the shared folder and read back: a lost executor then
    costs no recomputation of what came before, and the planner knows the true
    size of the table, so it broadcasts small ones by its own threshold and no
    others.  Rows are put in ``order`` within each task, so statistics of row
    groups let a reader skip what it does not want.  Files are short, as a few
    compressed bytes of a tree are much work for who reads them: a split never
    grows with the table.  :func:`release` deletes what is no longer needed.
    """
    spark = frame.sparkSession
    target = f"{shared_folder(spark)}/spanloom-{uuid.uuid4().hex}"
    (frame.sortWithinPartitions(*order) if order else frame).write.option("maxRecordsPerFile", FILE_ROWS).parquet(target)
    made = spark.read.schema(frame.schema).parquet(target)
    made._kept_at = target
    return made


def is_kept(frame: DataFrame) -> bool:
    return getattr(frame, "_kept_at", None) is not None


def release(*frames: DataFrame) -> None:
    """Delete the files of kept tables; others are left alone.  Nothing made from them can be read afterwards."""
    for frame in frames:
        if is_kept(frame):
            delete(frame.sparkSession, frame._kept_at)
            frame._kept_at = None
