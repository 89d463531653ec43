"""Helpers shared by the operators: table access, Arrow batch functions, XXH64 and tables in the
shared folder.

Rows reach Python in Arrow batches of about ``BATCH_BYTES`` bytes, so a task holds little more than the
longest text however large its partition is.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import exposa
from exposa.session import checkpoint_dir, materialize  # noqa: F401  (re-exported)

#: Bytes after which an Arrow batch handed to Python is closed.
BATCH_BYTES = 16 << 20


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Workers import this package by name, wherever they run: the driver hands them its source, once
    for an application (the driver serves the archive, executors fetch it)."""
    sc, root = spark.sparkContext, Path(exposa.__file__).parent
    if sc.applicationId in _SHIPPED or not root.is_dir():  # or it came as an archive itself
        return
    archive = Path(tempfile.mkdtemp(prefix="exposa-src-")) / "exposa.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null taken as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """``mapInArrow`` with a bound on the bytes of a batch."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
         for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def sample_by_hash(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows, those whose columns hash lowest. Rows far above the cut are dropped where
    they are, so tasks don't send the driver ``n`` rows each."""
    order = F.xxhash64(*columns)
    total = df.count()
    if total > 4 * n:
        df = df.where(order <= F.lit(-(1 << 63) + (2 * n << 64) // total))
    return df.orderBy(order, *columns).limit(n)
