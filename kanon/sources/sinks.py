"""Sinks: versioned company snapshot (S9), append-only event logs (S10), report envelope (S11), export.

There is no table format on the classpath, so the snapshot is a directory of
immutable versions ``<root>/v=<n>/`` (each partitioned by ``is_current`` so
"current rows only" is a partition-pruned read) plus a ``_LATEST`` pointer
file written last: readers see either the old or the new version, never a
half-written one, and re-running a batch rewrites the same version directory
(idempotent replay).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanon.session import ensure_checkpoint_dir

POINTER = "_LATEST"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file in one step: readers see the old text or the new one."""
    sc = spark.sparkContext
    fs, p = _fs(spark, path)
    new = sc._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    how = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration()).rename(new, p, how)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream))
    line = reader.readLine()
    reader.close()
    return line


def latest_version(spark: SparkSession, root: str) -> int | None:
    v = _read_text(spark, f"{root.rstrip('/')}/{POINTER}")
    return int(v) if v is not None else None


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write ``df`` as version ``version`` (partitioned by ``is_current``), then move the pointer."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/v={version}"
    writer = df.write.mode("overwrite")
    if "is_current" in df.columns:
        writer = writer.partitionBy("is_current")
    writer.parquet(path)
    _write_text(spark, f"{root.rstrip('/')}/{POINTER}", str(version))
    return path


def read_snapshot(spark: SparkSession, root: str, current_only: bool = False,
                  version: int | None = None) -> DataFrame | None:
    """Latest (or the given) version; ``None`` when it does not exist."""
    v = latest_version(spark, root) if version is None else version
    if v is None:
        return None
    fs, p = _fs(spark, f"{root.rstrip('/')}/v={v}")
    if not fs.exists(p):
        return None
    df = spark.read.parquet(f"{root.rstrip('/')}/v={v}")
    if "is_current" not in df.columns:
        return df
    # partition discovery types ``is_current=true`` as a string: prune on the raw value, then cast
    if current_only:
        df = df.filter(F.col("is_current").cast("string") == "true")
    return df.withColumn("is_current", F.col("is_current").cast("boolean"))


#: Columns by which one company is looked up.
LOOKUP_KEYS = ("nip", "regon", "krs_number")


def write_lookup(df: DataFrame, path: str, order: str = "identity_key", keys: tuple[str, ...] = LOOKUP_KEYS, files: int | None = None,
                 row_group_bytes: int | None = None, expected: int | None = None) -> None:
    """A copy of the companies for point lookups. Rows are range-partitioned and sorted by ``order``, so row groups
    hold narrow ranges of it and min / max statistics skip most; ``keys`` also get Bloom filters, which skip
    row groups whatever the order is. ``expected`` is the number of distinct keys in a file (it sizes the filters)."""
    rows = df.repartitionByRange(files, order) if files else df.repartitionByRange(order)
    w = rows.sortWithinPartitions(order).write.mode("overwrite").option("parquet.page.write-checksum.enabled", "false")
    for k in keys:
        w = w.option(f"parquet.bloom.filter.enabled#{k}", "true")
        if expected:
            w = w.option(f"parquet.bloom.filter.expected.ndv#{k}", expected)
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    w.parquet(path)


def lookup(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """Rows with these key values. The comparison is on the stored column as it is, so it reaches the Parquet reader."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df


def append_events(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append-only log (run log, ledger, query log), optionally date-partitioned for retention."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def export(df: DataFrame, columns: list[str], path: str, fmt: str = "csv") -> None:
    """Explicit-column export; nested / JSON columns written as JSON text."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = [F.to_json(F.col(c)).alias(c) if isinstance(types[c], (ArrayType, StructType, MapType)) else F.col(c)
            for c in columns]
    out = df.select(*cols)
    if fmt == "csv":
        # quotes are doubled, as every CSV reader expects them
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


#: Spark removes the shuffle files of a SQL execution at its end; what was written is all that is read later.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint root: what reads it several times does not make it again."""
    path = scratch_path(df.sparkSession, name, uuid.uuid4().hex)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint root (``spark.checkpoint.dir``)."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, *parts) if "://" not in root else root.rstrip("/") + "/" + "/".join(parts)
