"""Small files beside tables: listed, read, and written so that only the first writer of a name succeeds.

Folders on a shared POSIX file system are used as they are; any other path goes
through Hadoop's file systems.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        local = re.sub("^file:/+", "/", root)
        self.root, self.posix = (local, True) if local.startswith("/") else (root, False)
        if not self.posix:
            self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def files(self, folder: str = "") -> list[tuple[str, float]]:
        """(name below the root, time of the last change) of all files below a folder."""
        if self.posix:
            found = [os.path.join(top, n) for top, _, names in os.walk(os.path.join(self.root, folder)) for n in names]
            return sorted((os.path.relpath(f, self.root), os.path.getmtime(f)) for f in found)
        if not self._fs.exists(self._at(folder)):
            return []
        out, it = [], self._fs.listFiles(self._at(folder), True)
        base = self._fs.makeQualified(self._at("")).toString()
        while it.hasNext():
            f = it.next()
            out.append((f.getPath().toString()[len(base) + 1 :], f.getModificationTime() / 1000))
        return sorted(out)

    def read(self, name: str) -> str:
        if self.posix:
            with open(self.path(name)) as f:
                return f.read()
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Write a whole file under a name that nobody has used; Conflict if somebody has."""
        part = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        if self.posix:
            os.makedirs(os.path.dirname(self.path(name)), exist_ok=True)
            with open(self.path(part), "w") as f:
                f.write(text)
            try:
                os.link(self.path(part), self.path(name))
            except FileExistsError as e:
                raise Conflict(f"{name} exists") from e
            finally:
                os.unlink(self.path(part))
            return
        out = self._fs.create(self._at(part), True)
        out.write(text.encode())
        out.close()
        from py4j.protocol import Py4JJavaError

        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        kinds = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        kinds[0] = none
        try:
            context.rename(self._at(part), self._at(name), kinds)
        except Py4JJavaError as e:
            self._fs.delete(self._at(part), False)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"{name} exists") from e
            raise

    def delete(self, name: str) -> None:
        if self.posix:
            os.unlink(self.path(name))
        else:
            self._fs.delete(self._at(name), False)
