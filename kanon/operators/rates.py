"""Request-rate audit (W8): trailing-window counts per source, gap to the previous request.

Time is cut into buckets as long as the longest window, and each request is copied to its own bucket and to the next one
(its halo), so every request finds all of its window in its own bucket: the counts are window frames inside (source,
bucket). The last request before a bucket, however old, rides along as one row that counts for nothing but the gap. All of it
meets in one shuffle; two more carry one row per (source, bucket). A hot source is split by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kanon.functions.common import micros_ntz

SECOND = 1_000_000


def rate_audit(events: DataFrame, key: str, ts: str, tie: str, windows: dict[str, int]) -> DataFrame:
    """Per request: ``windows`` name → count of same-source requests in the trailing window (incl. itself; one that is
    exactly as old as the window no longer counts), plus ``gap_seconds`` since the previous request of the source
    (NULL for the first). Requests of equal time are ordered by ``tie``."""
    length = max(windows.values()) * SECOND
    base = events.select(F.col(key), F.col(ts), F.col(tie), micros_ntz(ts).alias("_t")).withColumn("_b", F.floor(F.col("_t") / F.lit(length)).cast("bigint"))
    last = base.groupBy(key, "_b").agg(F.max("_t").alias("_t"))
    before = last.select(key, "_b", F.lag("_t").over(Window.partitionBy(key).orderBy("_b")).alias("_t")).filter(F.col("_t").isNotNull())
    kinds = F.array(F.struct(F.lit(0).alias("later"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("later"), F.lit(False).alias("own")))
    rows = base.select("*", F.inline(kinds)).select(key, (F.col("_b") + F.col("later")).alias("_b"), "_t", ts, tie, "own", F.lit(1).alias("_one"))
    carried = before.select(key, "_b", "_t", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in (ts, tie)],
                            F.lit(False).alias("own"), F.lit(0).alias("_one"))
    met = rows.unionByName(carried).repartition(key, "_b")
    inside = Window.partitionBy(key, "_b").orderBy("_t", tie)
    upto = F.sum("_one").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    by_time = Window.partitionBy(key, "_b").orderBy("_t")
    out = met.select(key, ts, tie, "own", upto.alias("_upto"), ((F.col("_t") - F.lag("_t").over(inside)) / F.lit(float(SECOND))).alias("gap_seconds"),
                     *[F.coalesce(F.sum("_one").over(by_time.rangeBetween(Window.unboundedPreceding, -w * SECOND)), F.lit(0)).alias(f"_old_{name}") for name, w in windows.items()])
    return out.filter("own").select(key, ts, tie, *[(F.col("_upto") - F.col(f"_old_{name}")).alias(name) for name in windows], "gap_seconds")
