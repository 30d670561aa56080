"""Tables written to the shared checkpoint folder to cut lineage.

A staged table is an ordinary Parquet directory below ``spark.checkpoint.dir``. Unlike a local
checkpoint it outlives lost executors, and unlike ``cache`` it never has to be computed again.
The folder is read from the session, which must name one that all executors reach; ``session.build_session``
sets one for local runs. The tables of an application are deleted when it ends, or by ``discard``.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()
_kept: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for this application, without a trailing slash. A session without the setting gets one if it is local, and an error if
    not."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "threadloom-checkpoints")
    root = f"{base.rstrip('/')}/staged-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_discard_quietly, spark)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back."""
    path = new_path(df.sparkSession, name)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """What a table built from files depends on: their names, lengths and times."""
    seen = []
    for path in paths:
        fs, where = _file_system(spark, path)
        status = fs.getFileStatus(where)
        for f in fs.listStatus(where) if status.isDirectory() else [status]:
            seen.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("|".join([*paths, *sorted(seen)]).encode()).hexdigest()[:16]


def kept(
    spark: SparkSession, name: str, sources: Sequence[str], build: Callable[[], DataFrame], partition_by: Sequence[str] = (),
    order: Sequence[str] = ()
) -> DataFrame:
    """A table that is built once for an application from source files and read by every query after that, as long as these files stay as they are.

    It is partitioned by ``partition_by`` and sorted by range of ``order`` within, so that filters on either read only what they need.
    """
    key = (shared_dir(spark), name, fingerprint(spark, sources))
    if key not in _kept or not _exists(spark, _kept[key]):
        path, df = new_path(spark, f"kept-{name}"), build()
        columns = [*partition_by, *order]
        if columns:
            df = stage(df, name)  # ranges are cut from a sample, for which the rows would be made twice
            df = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        writer = df.write.mode("error").option("compression", "zstd").option("parquet.block.size", 8 << 20)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        spark.read.parquet(path).schema  # noqa: B018  it can be read
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores (a small file), over all cores; larger ones as they are. For work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _file_system(spark, path)
    return fs.exists(folder)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _file_system(spark, path)
    fs.mkdirs(folder)


def move_folder(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder; False if there is none."""
    fs, folder = _file_system(spark, path)
    return fs.exists(folder) and fs.rename(folder, _file_system(spark, to)[1])


def discard(spark: SparkSession) -> None:
    """Delete every staged table of this application."""
    fs, folder = _file_system(spark, shared_dir(spark))
    fs.delete(folder, True)
    for key in [k for k in _kept if k[0] == shared_dir(spark)]:
        del _kept[key]


def _discard_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        discard(spark)


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file to the shared folder."""
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
