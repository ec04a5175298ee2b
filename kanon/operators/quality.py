"""Data-quality counters (A3), duplicate report (A4), offending samples (A5), key uniqueness.

A3 is one aggregate pass with ``count_if`` per rule. A4 explodes each row into
its (kind, key) pairs and groups once: a single shuffle for all four duplicate
checks, with map-side partial counts so a hot key does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanon.functions.common import present

# Validity patterns (\z = end of text; Java ``$`` would also accept a final newline).
VALID_COUNTRY = r"^[A-Z]{2}\z"
STREET_PREFIX_CI = r"(?i)^(ul\.|ulica\s+)"
_ONE_PHONE = r"(\+48[0-9]{9}|\+48 [0-9]{2} [0-9]{3} [0-9]{2} [0-9]{2}|\+[0-9]{10,15})"
VALID_PHONE_LIST = rf"^{_ONE_PHONE}(, {_ONE_PHONE})*\z"
VALID_EMAIL_CI = r"(?i)^[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\z"


def invalid_country() -> Column:
    return present("country") & ~F.col("country").rlike(VALID_COUNTRY)


def invalid_phone() -> Column:
    return present("phone") & ~F.col("phone").rlike(VALID_PHONE_LIST)


def invalid_email() -> Column:
    return present("email") & ~F.col("email").rlike(VALID_EMAIL_CI)


def quality_counts(df: DataFrame) -> DataFrame:
    """A3: total + 11 counters over all rows (history included)."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~present("nip")).alias("missing_nip"),
        F.count_if(~present("regon")).alias("missing_regon"),
        F.count_if(~present("nip") & ~present("regon")).alias("missing_nip_and_regon"),
        F.count_if(invalid_country()).alias("invalid_country"),
        F.count_if(F.coalesce(F.col("street").rlike(STREET_PREFIX_CI), F.lit(False))).alias("street_prefix_left"),
        F.count_if(~present("city")).alias("missing_city"),
        F.count_if(~present("phone")).alias("missing_phone"),
        F.count_if(invalid_phone()).alias("invalid_phone"),
        F.count_if(~present("email")).alias("missing_email"),
        F.count_if(invalid_email()).alias("invalid_email"),
        F.count_if(~present("website")).alias("missing_website"),
    )


DUPLICATE_KINDS = ("nip_history", "multi_current_nip", "regon", "krs_number")


def duplicate_report(flagged: DataFrame) -> DataFrame:
    """A4: groups and rows for nip history (all rows), multi-current nip, duplicate regon and number
    (current rows). One row of 8 counters."""
    cur = F.col("is_current")
    pairs = F.filter(
        F.array(
            F.when(present("nip"), F.struct(F.lit("nip_history").alias("k"), F.col("nip").alias("v"))),
            F.when(cur & present("nip"), F.struct(F.lit("multi_current_nip").alias("k"), F.col("nip").alias("v"))),
            F.when(cur & present("regon"), F.struct(F.lit("regon").alias("k"), F.col("regon").alias("v"))),
            F.when(cur & present("krs_number"), F.struct(F.lit("krs_number").alias("k"), F.col("krs_number").alias("v"))),
        ),
        lambda x: x.isNotNull(),
    )
    groups = (
        flagged.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.k").alias("k"), F.col("p.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    aggs = []
    for kind in DUPLICATE_KINDS:
        aggs.append(F.count_if(F.col("k") == kind).alias(f"{kind}_groups"))
        aggs.append(F.coalesce(F.sum(F.when(F.col("k") == kind, F.col("n"))), F.lit(0)).cast("bigint")
                    .alias(f"{kind}_rows"))
    return groups.agg(*aggs)


def samples(df: DataFrame, column: str, predicate: Column, n: int = 10) -> DataFrame:
    """A5: top-n offending values with counts (``''`` for NULL)."""
    return (
        df.filter(predicate)
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value").asc())
        .limit(n)
        .select(F.coalesce(F.col("value"), F.lit("")).alias("value"), "n")
    )


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values (NULL-safe via coalesce to '') held by more than one row."""
    cols = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
