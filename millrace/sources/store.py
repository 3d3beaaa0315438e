"""Folders in any file system that Spark reads, and the shared folder for what outlives a job."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A path, with what Hadoop's file system interface offers there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def __str__(self) -> str:
        return self.path

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        """Of files and folders right in it."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path)) if self.exists() else []

    def files(self) -> dict[str, tuple[int, int]]:
        """(size, time of change) of every file below."""
        out, found = {}, self._fs.listFiles(self._path, True)
        while found.hasNext():
            x = found.next()
            out[x.getPath().toString()] = (x.getLen(), x.getModificationTime())
        return out

    def make(self) -> None:
        self._fs.mkdirs(self._path)

    def moved_to(self, other: Folder) -> bool:
        """False if the other one was there already, or this one isn't there."""
        return not other.exists() and self._fs.rename(self._path, other._path)

    def delete(self) -> None:
        self._fs.delete(self._path, True)

    def write_text(self, text: str) -> None:
        """As a whole, or not at all: a half-written file never has this name."""
        part = Folder(self.spark, f"{self.path}.part")
        out = self._fs.create(part._path, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists():
            self.delete()
        self._fs.rename(part._path, self._path)

    def read_text(self) -> str | None:
        if not self.exists():
            return None
        stream = self._fs.open(self._path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def shared(spark: SparkSession) -> Folder:
    """The folder in spark.checkpoint.dir; one of this machine only where none is set and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return Folder(spark, folder or os.path.join(tempfile.gettempdir(), "millrace-shared"))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: what depends on it doesn't compute it again."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(str(shared(df.sparkSession)))
    return df.checkpoint()


def fingerprint(df: DataFrame) -> str:
    """Of the files that df reads: names, sizes and times of change."""
    files = {}
    for f in df.inputFiles():
        files |= Folder(df.sparkSession, f).files()
    return hashlib.sha1(repr(sorted(files.items())).encode()).hexdigest()
