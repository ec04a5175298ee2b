"""Dynamic projection (F11), filters (F2–F8) and paging (L1–L2) on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kanon.operators import search as S


def test_resolve_columns():
    assert S.resolve_columns(None) == list(S.DEFAULT_COLUMNS)
    assert S.resolve_columns("  ") == list(S.DEFAULT_COLUMNS)
    assert S.resolve_columns(" name , NIP,nip, bogus ,city") == ["name", "nip", "city"]
    with pytest.raises(S.NoValidColumns):
        S.resolve_columns("bogus, , nothing")


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, "ACME sp. z o.o.", "Mazowieckie", "62%01Z", " ", dt.date(2020, 5, 1), ["CEIDG", "KRS"]),
         (2, "Beta", "mazowieckie", "6201Z", "a@b.pl", dt.date(2021, 1, 1), ["CEIDG"])],
        "id long, name string, voivodeship string, main_pkd_code string, email string, started_on date, "
        "registry_sources array<string>")
    ids = lambda p: sorted(r["id"] for r in df.filter(p).collect())
    assert ids(S.eq_ci("voivodeship", " MAZOWIECKIE ")) == [1, 2]
    assert ids(S.contains_ci("name", "sp. z")) == [1]
    assert ids(S.contains_ci("main_pkd_code", "2%0")) == [1, 2]     # user % stays a wildcard
    assert ids(S.prefix_ci("main_pkd_code", "620%")) == [2]
    assert ids(S.presence("email", True)) == [2] and ids(S.presence("email", False)) == [1]
    assert ids(S.between_dates("started_on", "2020-05-01", "2020-12-31")) == [1]
    assert ids(S.has_source(" krs ")) == [1]
    assert S.eq_ci("voivodeship", "  ") is None and S.presence("email", None) is None


def test_page_clamps(spark):
    df = spark.range(0, 250).withColumnRenamed("id", "k")
    order = [F.col("k").asc()]
    assert [r["k"] for r in S.page(df, 0, 0, order).collect()] == list(range(25))
    assert [r["k"] for r in S.page(df, 3, 10, order).collect()] == list(range(20, 30))
    assert S.page(df, 1, 1000, order).count() == 100
