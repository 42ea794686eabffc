"""Small control files in any file system Spark can reach."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from seqlake.functions.model import Corruption


class Store:
    """A folder, by way of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.path("")).toUri(), conf)
        self.no_overwrite = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as e:
            if "ChecksumException" in str(e.java_exception):
                raise Corruption(f"{name} is damaged") from e
            raise
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file, whole or not at all; False if there is one already.

        A writer that dies leaves a file under another name. The file system decides who is first;
        a local one only where the writers are not within the same moment.
        """
        if self.exists(name):
            return False
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), False)
        stream.write(text.encode())
        stream.close()
        if self.move(draft, name):
            return True
        self.remove(draft)
        return False

    def move(self, name: str, to: str) -> bool:
        """Renames a file; False if there is one of that name already."""
        source, target = (self.fs.makeQualified(self.path(n)) for n in (name, to))
        try:
            self.files.rename(source, target, self.no_overwrite)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
