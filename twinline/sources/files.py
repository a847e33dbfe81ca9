"""Questions to whatever file system a path is on, asked through Hadoop."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _locate(spark: SparkSession, path: str):
    context = spark.sparkContext
    location = context._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(context._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    file_system, location = _locate(spark, path)
    return file_system.exists(location)


def is_file(spark: SparkSession, path: str) -> bool:
    file_system, location = _locate(spark, path)
    return file_system.exists(location) and file_system.getFileStatus(location).isFile()


def delete(spark: SparkSession, path: str) -> bool:
    file_system, location = _locate(spark, path)
    return file_system.delete(location, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    file_system, location = _locate(spark, path)
    return file_system.rename(location, _locate(spark, to)[1])


def children(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, as paths that begin as ``folder`` is written; nothing if it isn't there."""
    file_system, location = _locate(spark, folder)
    found = file_system.listStatus(location) if file_system.exists(location) else ()
    return sorted(f"{folder}/{status.getPath().getName()}" for status in found)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and modification time of the files that a path or pattern stands for."""
    file_system, location = _locate(spark, path)
    found, files = list(file_system.globStatus(location) or ()), []
    while found:
        status = found.pop()
        if status.isDirectory():
            found.extend(file_system.listStatus(status.getPath()))
        else:
            files.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(files)


def output_ready(spark: SparkSession, path: str) -> bool:
    """True for one parquet file or a folder whose write was finished.

    A folder with part files but no ``_SUCCESS`` is a write that broke off.
    """
    if is_file(spark, path):
        return path.endswith(".parquet")
    return exists(spark, f"{path}/_SUCCESS")
