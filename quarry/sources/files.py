"""Small driver-side files on whatever file system Spark reaches, through Hadoop's API."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import EngineError


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all is one process."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise EngineError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        top = self._path(root)
        self._gateway, self._conf = spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs = top.getFileSystem(self._conf)
        self.root = self.fs.makeQualified(top).toString().rstrip("/")

    def at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def create(self, path: str) -> bool:
        """Make an empty file; False if there is one by that name. Exactly one of several writers succeeds."""
        return self._unless_there(lambda: self.fs.create(self._path(self.at(path)), False).close())

    def publish(self, path: str, text: str) -> bool:
        """Make a file that readers see whole or not at all; False if there is one by that name."""
        temporary, target = self._path(self.at(f"_tmp/{uuid.uuid4().hex}")), self._path(self.at(path))
        out = self.fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            # On a local disk a rename replaces what is there; a link doesn't.
            return self._unless_there(lambda: (self._link if self.fs.getUri().getScheme() == "file" else self._rename)(temporary, target))
        finally:
            self.fs.delete(temporary, False)

    def _link(self, source, target) -> None:
        file = self._jvm.java.io.File
        self._jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(source.toUri().getPath()).toPath())

    def _rename(self, source, target) -> None:
        none = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = none
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(source, target, options)

    @staticmethod
    def _unless_there(make) -> bool:
        try:
            make()
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def set_aside(self, path: str, ending: str) -> None:
        self.fs.rename(self._path(self.at(path)), self._path(self.at(path + ending)))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(self.at(path)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        top = self._path(self.at(folder))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(top)) if self.fs.exists(top) else []

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self._path(self.at(folder)))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(self.at(path)), True)

    def parquet_files(self, folder: str) -> list[str]:
        """Paths, relative to the root, of the data files below a folder."""
        found, it = [], self.fs.listFiles(self._path(self.at(folder)), True)
        while it.hasNext():
            path = it.next().getPath().toString()
            if path.endswith(".parquet"):
                found.append(path.split(self.root, 1)[1].lstrip("/"))
        return sorted(found)
