"""Tables that the engine writes for itself: in the cluster's shared folder, gone when the driver ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"corvane-{os.getuid()}")
    return base.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_dir(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted with the driver."""
    path = f"{shared_dir(spark)}/corvane-{tag}-{uuid.uuid4().hex}"
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.corvane_path = path
    return out


#: Bytes of files below which few splits are dealt over all cores before costly work.
SPREAD = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """The rows of small files dealt over all cores: a split of narrow, compressed columns may hold a long time's work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism) if file_states(df)[1] < SPREAD else df


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    files, at = _at(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    files, at = _at(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears at once with all its text, unless there is one already."""
    folder, name = path.rsplit("/", 1)
    files, draft = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(fs.Path(path)), options)
    except Exception as refused:  # Java's FileAlreadyExistsException
        files.delete(draft, False)
        if "FileAlreadyExistsException" in str(refused):
            return False
        raise
    return True


def file_states(df: DataFrame) -> tuple[int, int, int]:
    """Files that ``df`` reads, their bytes, and a digest of their names, times of change and sizes."""
    names = df.inputFiles()
    if not names:
        return 0, 0, 0
    listed = df.sparkSession.read.format("binaryFile").load(names)  # contents stay unread
    each = F.xxhash64("path", "modificationTime", "length")
    return tuple(listed.agg(F.count("*"), F.sum("length"), F.bit_xor(each)).first())
