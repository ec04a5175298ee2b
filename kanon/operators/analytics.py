"""Market analytics: summary (A1) and distributions.

Distribution plan: one scan → partial hash aggregate per bucket → shuffle of
(bucket, count) rows only → HAVING → TakeOrderedAndProject(limit). The total
is a scalar subquery: the one-row sum over the same grouping, taken *before*
HAVING. It sums every count of the grouping, so that no column is pruned and its
exchange is the one of the main branch (reused): the data is aggregated once and
no task ever holds all buckets of a free-text dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanon.functions.common import blank_null, clamp, percent, present
from kanon.operators.search import source_profile

ACTIVE_STATUSES = ("AKTYWNY", "ACTIVE")
SUSPENDED_PREFIX = "ZAWIESZ"


def is_active(status: str = "status") -> Column:
    return F.upper(F.coalesce(F.col(status), F.lit(""))).isin(*ACTIVE_STATUSES)


def is_suspended(status: str = "status") -> Column:
    return F.upper(F.coalesce(F.col(status), F.lit(""))).startswith(SUSPENDED_PREFIX)


def market_summary(df: DataFrame) -> DataFrame:
    """A1: one row of counts and half-even percents."""
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_active()).alias("active"),
        F.count_if(is_suspended()).alias("suspended"),
        F.count_if(present("email")).alias("with_email"),
        F.count_if(present("phone")).alias("with_phone"),
        F.count_if(present("website")).alias("with_website"),
    )
    return agg.select(
        "total",
        "active", percent("active", "total").alias("active_pct"),
        "suspended", percent("suspended", "total").alias("suspended_pct"),
        "with_email", percent("with_email", "total").alias("with_email_pct"),
        "with_phone", percent("with_phone", "total").alias("with_phone_pct"),
        "with_website", percent("with_website", "total").alias("with_website_pct"),
    )


def dimensions() -> dict[str, Column]:
    """The ten distribution dimensions (lookup is case-insensitive)."""
    return {
        "voivodeship": F.col("voivodeship"),
        "county": F.col("county"),
        "municipality": F.col("municipality"),
        "city": F.col("city"),
        "status": F.col("status"),
        "mainPkdCode": F.col("main_pkd_code"),
        "startedYear": F.year("started_on").cast("string"),
        "registeredYear": F.year("registered_on").cast("string"),
        "sourceProfile": source_profile(),
        "legalForm": F.col("legal_form"),
    }


def dimension(name: str) -> Column:
    for k, v in dimensions().items():
        if k.lower() == name.lower():
            return v
    raise KeyError(f"unknown dimension {name!r}")


def distribution(df: DataFrame, dim: str | Column, limit: int | None = 20, min_bucket: int | None = 10) -> DataFrame:
    """A2: buckets with company / active counts and share of the filtered total; top-N."""
    limit = clamp(limit, 20, 1, 100)
    min_bucket = clamp(min_bucket, 10, 1, 1000)
    key = dimension(dim) if isinstance(dim, str) else dim
    bucketed = df.select(F.coalesce(F.nullif(key, F.lit("")), F.lit("brak")).alias("bucket_key"), "status")
    grouped = bucketed.groupBy("bucket_key").agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if(is_active()).alias("active_companies"),
    )
    total = grouped.agg(F.struct(*[F.sum(c).alias(c) for c in ("companies", "active_companies")])).scalar()["companies"]
    return (
        grouped.withColumn("total_count", total)
        .filter(F.col("companies") >= min_bucket)
        .orderBy(F.col("companies").desc(), F.col("bucket_key").asc())
        .limit(limit)
        .select("bucket_key", "companies", "active_companies", "total_count",
                percent("companies", "total_count").alias("share_pct"))
    )


__all__ = ["market_summary", "distribution", "dimensions", "dimension", "is_active", "is_suspended", "blank_null"]
