"""Publishing reports so that readers see one whole attempt.

Each attempt writes into a folder of its own. When all its parts are written, a manifest that names them replaces the
one before in a single rename. A job that fails half-way, or runs twice at a time, leaves the published report as it
was; its folder is never read and ``tidy`` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


class _Folder:
    """A folder of any file system Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside and rename it over the old one."""
        beside = self.path(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = self.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(kind.OVERWRITE.getClass(), 1)
        how[0] = kind.OVERWRITE
        qualified = self.fs.makeQualified(beside), self.fs.makeQualified(self.path(name))
        self.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), self.conf).rename(*qualified, how)


def publish(spark: SparkSession, path: str, parts: dict[str, Callable[[str], None]]) -> str:
    """Write each part with its function, into a folder it is given, then make the attempt the published one."""
    attempt = f"attempt-{uuid.uuid4().hex}"
    for name, write in parts.items():
        write(f"{path.rstrip('/')}/{attempt}/{name}")
    _Folder(spark, path).replace(MANIFEST, json.dumps({"attempt": attempt, "parts": {n: f"{attempt}/{n}" for n in parts}}))
    return attempt


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """part -> folder of the report that is published at ``path``; empty before the first one."""
    text = _Folder(spark, path).read(MANIFEST)
    return {n: f"{path.rstrip('/')}/{p}" for n, p in json.loads(text)["parts"].items()} if text else {}


def tidy(spark: SparkSession, path: str) -> int:
    """Delete the attempts that are not published; not while a job is writing one. Returns how many."""
    folder = _Folder(spark, path)
    kept = (json.loads(folder.read(MANIFEST) or "{}")).get("attempt")
    old = [f.getPath() for f in folder.fs.listStatus(folder.path()) if f.getPath().getName().startswith("attempt-")
           and f.getPath().getName() != kept]
    for p in old:
        folder.fs.delete(p, True)
    return len(old)
