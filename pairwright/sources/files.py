"""Files on whatever file system a path names: small ones through Hadoop's API on the driver,
and any through pyarrow in tasks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from pairwright.errors import StoreError


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there, for Python code in tasks: local and mounted
    folders, HDFS, S3, GCS."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    try:
        return fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError, ValueError) as error:
        raise StoreError(f"Python cannot open {folder}: {error}") from error


class FileSystem:
    """Names, text and atomic creation of small files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; empty where there is no such folder."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(path))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, path: str, text: str) -> bool:
        """Create a file with its whole text at once; false where it exists already."""
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self._conf
        )
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        no_options = self._gateway.new_array(rename, 0)
        try:
            context.rename(self._path(draft), self._path(path), no_options)
        except Py4JJavaError as error:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
