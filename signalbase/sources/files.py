"""What lies in a folder, by Hadoop's file systems, so for any URI that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def delete(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.delete(place, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]] | None:
    """(path, name, bytes, time of change) of a folder's files in order of name; None where there is no such folder."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return None
    found = [(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(place) if s.isFile()]
    return sorted(found, key=lambda f: f[1])
