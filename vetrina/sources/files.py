"""Files through Spark's file systems: whatever store a path names, driver and executors reach it the same way."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Milliseconds that a server may take to answer.
TIMEOUT = 180_000


class Files:
    """The file system of ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.of = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(self.conf)

    def copy_from(self, source: str, target: str) -> None:
        """Copy a file of any store, or what a web address gives, as a whole; raises OSError."""
        try:
            if source.startswith(("http://", "https://")):
                link = self.jvm.java.net.URI(source).toURL().openConnection()
                link.setConnectTimeout(TIMEOUT)
                link.setReadTimeout(TIMEOUT)
                link.setRequestProperty("Accept-Encoding", "identity")
                stream = link.getInputStream()
            else:
                path = self.of(source)
                stream = path.getFileSystem(self.conf).open(path)
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, self.fs.create(self.of(target), True), 1 << 20, True)
        except Py4JJavaError as error:
            raise OSError(str(error.java_exception)) from error

    def head(self, path: str, n: int, gunzip: bool = False) -> bytes:
        """The first ``n`` bytes of a file; raises OSError."""
        try:
            stream = self.fs.open(self.of(path))
            try:
                return bytes((self.jvm.java.util.zip.GZIPInputStream(stream) if gunzip else stream).readNBytes(n))
            finally:
                stream.close()
        except Py4JJavaError as error:
            raise OSError(str(error.java_exception)) from error

    def rename(self, source: str, target: str) -> None:
        self.fs.rename(self.of(source), self.of(target))

    def delete(self, path: str) -> None:
        self.fs.delete(self.of(path), True)
