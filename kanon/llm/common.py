"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kanon.session import CHECKPOINT_CONF, ensure_checkpoint_dir

#: Rows that one call of a row function sees at once; bounds Python memory, not the result.
SLICE_ROWS = 512



def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which driver and executors share. Only a session on
    a local master may go without the setting (tests); a cluster without it is an error."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    return (path or ensure_checkpoint_dir(spark)).rstrip("/")


#: Spark removes the shuffle files of a SQL execution at its end; what was written is all that is read later.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back: lineage ends there, so a
    lost executor costs no recomputation, every later use sees the same rows, and the shuffle files behind
    the table are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[..., list[tuple]], schema: StructType, *args) -> DataFrame:
    """``fn(rows, *args) -> rows`` over slices of :data:`SLICE_ROWS` rows inside ``mapInArrow``.

    ``rows`` is a list of tuples in the order of ``df``'s columns; the result rows follow ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = schema.fieldNames()
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = fn(list(zip(*(c.to_pylist() for c in part.columns), strict=True)), *args)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(cols)], names=names)

    return df.mapInArrow(run, schema)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rewrite_texts(docs: DataFrame, fn: Callable[[str | None], tuple[bool, str | None]]) -> DataFrame:
    """Stage helper: ``fn(text) -> (keep, new text)`` on every row; the columns of ``docs`` and their order
    stay, ``n_chars`` (if there) becomes the new length. Nothing is joined, so ids need not be unique."""
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(rows: list[tuple]) -> list[tuple]:
        out = []
        for row in rows:
            keep, text = fn(row[at])
            if keep:
                new = list(row)
                new[at] = text
                if chars is not None and text is not None and text != row[at]:
                    new[chars] = len(text)
                out.append(tuple(new))
        return out

    return map_arrow(docs, run, docs.schema)
