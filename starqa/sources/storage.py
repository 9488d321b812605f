"""Writing an intermediate result once, where every executor can read it.

Tables lie in the folder that the cluster names in ``spark.checkpoint.dir``.  They
belong to the session that wrote them and go when it ends.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written tables by application, for those that may be asked for again: plan, signature of its inputs, path.
_KEPT: dict[str, list[tuple[DataFrame, str, str]]] = {}
#: Everything that an application has written.
_WRITTEN: dict[str, list[str]] = {}


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="starqa-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _local_folder(context.applicationId)
        _gone_at_exit(spark, folder)
    return folder


def _path(spark: SparkSession, path: str):
    """The file system of a path and the path, as Spark sees them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """Marks what is there already for deletion when the driver's JVM ends."""
    files, there = _path(spark, path)
    files.deleteOnExit(there)


def _signature(df: DataFrame) -> str:
    """Hash of names, sizes and times of all files in the folders that a plan reads; their contents are not read."""
    folders = sorted({f.rpartition("/")[0] for f in df.inputFiles()})
    if not folders:
        return "none"
    listed = df.sparkSession.read.format("binaryFile").load(folders)
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    count, total = listed.agg(F.count("*"), F.sum(mark)).first()
    return hashlib.sha256(f"{folders} {count} {total}".encode()).hexdigest()


def stored(df: DataFrame, name: str, partition_by: str | None = None, reuse: bool = False) -> DataFrame:
    """The same rows, read back from a table written to the shared folder.

    Cuts the lineage: what follows reads the table, also after a lost executor,
    and knows its real size.

    With ``reuse`` a table that this session has already written is read again if
    its plan means the same (Spark compares the analysed plans), the files below
    are the same ones, unchanged, and its writing was completed.  Only for plans
    that always give the same rows.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    signature = _signature(df) if reuse else ""
    path = next((p for old, s, p in _KEPT.get(application, []) if reuse and s == signature and _same(old, df)), None)
    if path is None or not _complete(spark, path):
        mark = f"{df.semanticHash() & 0xFFFFFFFF:08x}-{signature[:16]}-" if reuse else ""
        path = f"{shared_folder(spark)}/{name}-{mark}{uuid.uuid4().hex}"
        _WRITTEN.setdefault(application, []).append(path)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        try:
            writer.parquet(path)
        finally:
            _gone_at_exit(spark, path)
        if reuse:
            _KEPT.setdefault(application, []).append((df, signature, path))
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def _same(old: DataFrame, new: DataFrame) -> bool:
    return old.columns == new.columns and old.sameSemantics(new)


def _complete(spark: SparkSession, path: str) -> bool:
    files, there = _path(spark, f"{path}/_SUCCESS")
    return files.exists(there)


def remove(df: DataFrame) -> None:
    """Deletes the table that ``stored`` wrote for this frame, once all that follows from it is written; the frame can no longer be used."""
    spark = df.sparkSession
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for path in [p for p in paths if p.rpartition("/")[2] in names]:
        files, there = _path(spark, path)
        files.delete(there, True)
        paths.remove(path)


def remove_stored(spark: SparkSession) -> int:
    """Deletes all tables that this session has written, for sessions that go on; gives their number.

    Frames that read them can no longer be used.
    """
    application = spark.sparkContext.applicationId
    paths = _WRITTEN.pop(application, [])
    _KEPT.pop(application, None)
    for path in paths:
        files, there = _path(spark, path)
        files.delete(there, True)
    return len(paths)
