"""Small files on any Hadoop file system, through the session's JVM."""

from __future__ import annotations

import os
import tempfile
import urllib.parse

from pyspark.sql import SparkSession

from papyra.errors import IOFailure


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        try:
            self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        except Exception as e:
            raise IOFailure(root) from e
        self.root = self._fs.makeQualified(self._path("")).toString()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, name: str, data: bytes) -> bool:
        """Creates the file with its whole content at once; false if it is there already.  Of several writers one wins, and a reader never sees half a file.

        Local: a hard link to a finished file, which fails if the name is taken.  HDFS: a rename, which does too.
        Object stores: a put that is conditional on the name being free (of S3A, in Hadoop 3.4.2 and later).
        """
        target = self._path(name)
        scheme = self._fs.getUri().getScheme()
        if scheme == "file":
            at = urllib.parse.unquote(target.toUri().getPath())
            os.makedirs(os.path.dirname(at), exist_ok=True)
            part = f"{at}.{os.getpid()}.{os.urandom(4).hex()}.part"
            try:
                with open(part, "xb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(part, at)
            except FileExistsError:
                return False
            finally:
                if os.path.exists(part):
                    os.unlink(part)
            return True
        if scheme in ("hdfs", "viewfs"):
            part = self._path(f"{name}.{os.getpid()}.{os.urandom(4).hex()}.part")
            self._put(part, data)
            if self._fs.rename(part, target):
                return True
            self._fs.delete(part, False)
            return False
        try:
            stream = self._fs.create(target, False)
            try:
                stream.write(data)
            finally:
                stream.close()
        except Exception as e:
            if self._fs.exists(target):
                return False
            raise IOFailure(name) from e
        return True

    def age(self, name: str) -> float:
        """Seconds since anything in the folder, two levels down, was last changed."""
        import time

        if not self.exists(name):
            return float("inf")
        newest, level = 0, [self._path(name)]
        for _ in range(3):
            below = [s for p in level for s in self._fs.listStatus(p)]
            newest = max([newest, *(s.getModificationTime() for s in below)])
            level = [s.getPath() for s in below if s.isDirectory()]
        newest = max(newest, self._fs.getFileStatus(self._path(name)).getModificationTime())
        return time.time() - newest / 1000

    def replace(self, name: str, data: bytes) -> None:
        self._put(self._path(name), data)

    def _put(self, path, data: bytes) -> None:
        stream = self._fs.create(path, True)
        try:
            stream.write(data)
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


_scratch: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """A folder for databases that a query builds: the cluster's shared one, in local mode a temporary one."""
    global _scratch
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise IOFailure("set spark.checkpoint.dir to a folder that all executors share")
    if _scratch is None or not os.path.isdir(_scratch):
        _scratch = tempfile.mkdtemp(prefix="papyra-db-")
    return f"file://{_scratch}"
