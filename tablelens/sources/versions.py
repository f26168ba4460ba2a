"""Datasets in committed versions: snapshot reads, appends without copies, refused conflicts.

A dataset is a folder with ``data`` (one new folder per write) and ``versions``
(one small manifest per version, named by its number).  A write first stores its
rows, then publishes the next number by renaming a finished manifest to a name
that must not exist.  So rows of a failed or unfinished write are never read, a
reader keeps its version however many follow, and of two writers that start from
one version the second to finish is refused.  The rename is as exclusive as the
file system's own: on HDFS entirely, on a local disk but for the moment between
its test and its move.

An append names the folders of the version before and one more; nothing is copied.
Its columns must have the same names and types.  Empty tables make versions too.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionConflict(RuntimeError):
    """Another writer has published the version after the one a write started from."""


class _Files:
    """The few file operations on Spark's own file systems that manifests need."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, name: str) -> bool:
        """Make a file with this text, whole or not at all; whether the name was free."""
        hidden = f"{name.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(hidden), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        place = self.fs.makeQualified(self.path(name))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.conf)
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(self.path(hidden)), place, plain)
        except Py4JJavaError as error:
            self.fs.delete(self.path(hidden), False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def version_numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    """The published versions, ascending."""
    folder = f"{_folder(root, name)}/versions"
    found = (n.removesuffix(".json") for n in _Files(spark, folder).names(folder) if n.endswith(".json") and not n.startswith("_"))
    return sorted(int(n) for n in found)


def manifest(spark: SparkSession, root: str, name: str, version: int) -> dict:
    path = f"{_folder(root, name)}/versions/{version}.json"
    return json.loads(_Files(spark, path).text(path))


def write_version(df: DataFrame, root: str, name: str, append: bool = False, expected: int | None = None) -> int:
    """Store ``df`` as the next version (or add it to the rows of the last one) and return its number.

    The write starts from the version ``expected`` (0: none yet), by default the newest
    one; if another has followed when the rows are stored, ``VersionConflict`` is raised.
    """
    spark, folder = df.sparkSession, _folder(root, name)
    base = expected if expected is not None else max(version_numbers(spark, root, name), default=0)
    columns = json.loads(df.schema.json())
    parts: list[str] = []
    if append and base:
        before = manifest(spark, root, name, base)
        shape = lambda s: [(f.name, f.dataType.jsonValue()) for f in StructType.fromJson(s).fields]
        if shape(before["schema"]) != shape(columns):
            raise ValueError(f"columns differ from those of version {base} of {name}")
        parts = before["parts"]
    part = uuid.uuid4().hex
    df.write.parquet(f"{folder}/data/{part}")
    text = json.dumps({"version": base + 1, "written_at": dt.datetime.now(dt.timezone.utc).isoformat(), "schema": columns, "parts": [*parts, part]})
    if not _Files(spark, folder).publish(text, f"{folder}/versions/{base + 1}.json"):
        raise VersionConflict(f"version {base + 1} of {name} was published by another writer")
    return base + 1


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    known = version_numbers(spark, root, name)
    wanted = version if version is not None else max(known, default=0)
    if wanted not in known:
        raise LookupError(f"{name} has no version {wanted}")
    held = manifest(spark, root, name, wanted)
    paths = [f"{_folder(root, name)}/data/{p}" for p in held["parts"]]
    return spark.read.schema(StructType.fromJson(held["schema"])).parquet(*paths)
