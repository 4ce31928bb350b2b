"""File system calls that Spark's readers and writers do not offer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


class Files:
    """File names, small files and joined files under a folder, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._jvm = spark._jvm
        self._root = root
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}" if name else self._root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Write a small file unless it exists; False if it does."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:
            if self._fs.exists(self._path(name)):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, name: str, to: str) -> None:
        if self._fs.exists(self._path(to)):
            self._fs.delete(self._path(to), False)
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"cannot rename {name} to {to} in {self._root}")

    def join(self, parts: Sequence[str], to: str, head: str = "") -> None:
        """One file from ``head`` and the bytes of ``parts`` in their order.

        A file system that can chain files (``concat``) does so without moving a byte; elsewhere they are copied through a small
        buffer.  The file gets its name when it is complete.
        """
        open_name = f"{to}.open"
        self.remove(open_name)
        self.create(open_name, head)
        java_paths = self._spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Path, len(parts))
        for i, part in enumerate(parts):
            java_paths[i] = self._path(part)
        try:
            self._fs.concat(self._path(open_name), java_paths)
        except Exception:
            stream = self._fs.create(self._path(open_name), True)
            stream.write(bytearray(head.encode()))
            for part in parts:
                source = self._fs.open(self._path(part))
                self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
                source.close()
            stream.close()
        self.rename(open_name, to)
