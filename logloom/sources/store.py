"""Objects under a root folder, through Hadoop's file systems: a local folder, HDFS and an object store behave alike."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import SparkSession


class Store:
    """Keys are paths below the root. Missing objects raise FileNotFoundError."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, key: str) -> str:
        if posixpath.normpath(f"/{key}") != f"/{key.rstrip('/')}":
            raise ValueError(f"not a key: {key}")
        return f"{self.root}/{key}"

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(self.at(key)))

    def size(self, key: str) -> int:
        return self._fs.getFileStatus(self._path(self._there(key))).getLen()

    def _there(self, key: str) -> str:
        if not self.exists(key):
            raise FileNotFoundError(key)
        return self.at(key)

    def put(self, key: str, data: bytes) -> None:
        out = self._fs.create(self._path(self.at(key)), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        stream = self._fs.open(self._path(self._there(key)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_json(self, key: str, value) -> None:
        self.put(key, json.dumps(value, ensure_ascii=False).encode())

    def get_json(self, key: str):
        return json.loads(self.get(key))

    def upload(self, path: str, key: str) -> None:
        """A local file of the driver to an object, streamed."""
        self._fs.copyFromLocalFile(False, True, self._path(f"file://{path}"), self._path(self.at(key)))

    def download(self, key: str, path: str) -> str:
        """An object to a local file of the driver, streamed."""
        self._fs.copyToLocalFile(False, self._path(self._there(key)), self._path(f"file://{path}"), True)
        return path

    def names(self, prefix: str) -> list[str]:
        """What lies directly in a folder."""
        at = self._path(self.at(prefix))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def move(self, key: str, to: str) -> bool:
        """Whether a folder got a new name that was free. Where somebody else took that name meanwhile, file systems put the folder inside; then it is taken out again."""
        if self.exists(to) or not self._fs.rename(self._path(self._there(key)), self._path(self.at(to))):
            return False
        inside = f"{to}/{key.rsplit('/', 1)[-1]}"
        if self.exists(inside):
            self._fs.rename(self._path(self.at(inside)), self._path(self.at(key)))
            return False
        return True

    def delete(self, key: str) -> bool:
        """Whether there was such an object."""
        return self._fs.delete(self._path(self.at(key)), False)

    def delete_prefix(self, prefix: str) -> bool:
        """Everything under a folder goes."""
        if not prefix.strip("/"):
            raise ValueError("the whole store can't be deleted")
        return self._fs.delete(self._path(self.at(prefix.rstrip("/"))), True)
