"""Small files that appear whole or not at all: what decides between writers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Claims:
    """JSON files in a folder, each created at most once.

    The folder must be on a file system on which a complete file can be made to appear only if there is none of its name: by a
    hard link (``file``) or by a rename that refuses to overwrite (``hdfs``, ``viewfs``, ``ofs``). Object stores do not offer
    either through their usual connectors; there ``claim(path, content)`` must be given, say as a conditional put.
    """

    RENAMES = ("hdfs", "viewfs", "ofs")

    def __init__(self, spark: SparkSession, root: str, claim: Callable[[str, bytes], bool] | None = None):
        self.spark, self.root, self.claim = spark, root, claim
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(self._conf)
        self._scheme = self._fs.getUri().getScheme()
        if claim is None and self._scheme != "file" and self._scheme not in self.RENAMES:
            raise ValueError(f"{self._scheme} has no atomic create; give claim(path, content)")

    def _aside(self, path: str, content: bytes) -> str:
        """The whole file under a name that nobody reads."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(content))
        out.close()
        return aside

    def _appear(self, aside: str, path: str) -> bool:
        """Give the file its name in one step; False if the name is taken."""
        try:
            if self._scheme == "file":
                file = lambda p: self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(file(path), file(aside))
            else:
                option = self._jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(option, 1)
                options[0] = option.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(aside), self._path(path), options)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _create(self, path: str, what: dict) -> bool:
        """A small file that appears whole; False if there is one. Whatever step fails, the name is free or holds all of it."""
        content = json.dumps(what).encode()
        if self.claim is not None:
            return self.claim(path, content)
        if self._fs.exists(self._path(path)):
            return False
        aside = self._aside(path, content)
        done = self._appear(aside, path)
        self._fs.delete(self._path(aside), False)
        return done

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
