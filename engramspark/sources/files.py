"""Small files on any file system that Spark reaches."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import ConflictError, NotFoundError


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def names(self, path: str) -> list[str]:
        fs, target = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []

    def read(self, path: str) -> bytes:
        fs, target = self._at(path)
        if not fs.exists(target):
            raise NotFoundError(path)
        stream = fs.open(target)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, content: bytes) -> None:
        """All or nothing, and only where there is none yet: of writers that race one succeeds, and the others get a conflict.

        On a local disk by a hard link, elsewhere by a rename that does not overwrite, which the file system must make in one step (as HDFS does)."""
        fs, target = self._at(path)
        staged = self._jvm.org.apache.hadoop.fs.Path(f"{path}.staged-{self._jvm.java.util.UUID.randomUUID()}")
        out = fs.create(staged, False)
        out.write(bytearray(content))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(at(target), at(staged))
            else:
                rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(staged, target, options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise ConflictError(f"{path} exists") from None
        finally:
            fs.delete(staged, False)

    def delete(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)

    def make(self, path: str) -> None:
        fs, target = self._at(path)
        fs.mkdirs(target)

    def rename(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        if not fs.rename(p, self._at(target)[1]):
            raise ConflictError(f"{target} cannot be made")
