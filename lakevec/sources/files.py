"""File operations through Spark's Hadoop file systems, so that they work wherever tables can lie."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Schemes of stores without an atomic rename.
OBJECT_STORES = ("s3", "s3a", "gs", "abfs", "abfss", "wasb", "wasbs")


class Files:
    """The files of a session."""

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def _at(self, path: str):  # noqa: ANN202
        p = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a directory, sorted; none if there is no such directory."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def parquet_files(self, path: str) -> list[str]:
        """Full paths of the data files in a directory."""
        fs, p = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not exist yet; False if it does. This is the compare-and-swap of a commit."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        if fs.getScheme() in OBJECT_STORES:
            return self._put(fs, p, text)
        done = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{id(text)}.tmp")
        stream = fs.create(done, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(p) or not self._link(fs, done, p):
            fs.delete(done, False)
            return False
        return True

    def _put(self, fs, p, text: str) -> bool:  # noqa: ANN001
        """A conditional put: the object store itself refuses to write over an object. A rename there is a copy and could overwrite."""
        builder = fs.createFile(p).overwrite(False)
        if fs.getScheme().startswith("s3"):
            builder = builder.must("fs.s3a.create.conditional", True)  # a store or client without it is an error
        try:
            stream = builder.build()
            stream.write(bytearray(text.encode()))
            stream.close()
        except Py4JJavaError as e:
            if any(x in str(e.java_exception) for x in ("FileAlreadyExists", "PreconditionFailed", "412")):
                return False
            raise
        return True

    def _link(self, fs, source, target) -> bool:  # noqa: ANN001
        """Renames without overwriting, so that of two writers one fails."""
        if fs.getScheme() == "file":
            import os

            a, b = source.toUri().getPath(), target.toUri().getPath()
            try:
                os.link(a, b)
            except FileExistsError:
                return False
            os.unlink(a)
            return True
        try:
            return fs.rename(source, target)
        except Exception:  # noqa: BLE001 - any failure to rename means another writer was first
            return False

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
