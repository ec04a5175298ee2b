"""Distribution semantics (A2), quality patterns (A3) and duplicate counts (A4) on small frames."""

from pyspark.sql import functions as F

from kanon.operators import analytics as A
from kanon.operators import quality as Q


def test_distribution_total_before_having(spark):
    rows = [("A", "AKTYWNY")] * 12 + [("B", "ZAWIESZONY")] * 10 + [("C", "AKTYWNY")] * 3 + [("", "AKTYWNY")] * 11
    df = spark.createDataFrame(rows, "voivodeship string, status string")
    out = {r["bucket_key"]: r for r in A.distribution(df, "voivodeship", limit=0, min_bucket=0).collect()}
    assert set(out) == {"A", "brak", "B"}                     # C has 3 < 10 rows; blank becomes 'brak'
    assert all(r["total_count"] == 36 for r in out.values())  # total counted before HAVING
    assert out["A"]["share_pct"] == 33.33 and out["A"]["active_companies"] == 12
    assert out["B"]["active_companies"] == 0
    top1 = A.distribution(df, "voivodeship", limit=1, min_bucket=1).collect()
    assert [r["bucket_key"] for r in top1] == ["A"]


def test_percent_is_half_even(spark):
    from kanon.functions.common import percent

    df = spark.createDataFrame([(1, 8), (5, 0), (1, 3)], "p long, t long")
    got = [r["x"] for r in df.select(percent("p", "t").alias("x")).collect()]
    assert got == [12.5, 0.0, 33.33]
    # 0.125 % is a tie at 2 dp: half-even keeps the even digit
    assert spark.createDataFrame([(1, 800)], "p long, t long").select(percent("p", "t")).first()[0] == 0.12


def test_quality_patterns(spark):
    df = spark.createDataFrame(
        [("PL", "+48600000002", "a@b.pl", "ul. Lipowa"), ("POLSKA", "12 34", "bad", "Polna"),
         ("PL\n", "+48600000002\n", "a@b.pl\n", None), (None, None, None, "ULICA  Długa")],
        "country string, phone string, email string, street string")
    r = Q.quality_counts(df.withColumn("nip", F.lit(None).cast("string")).withColumn("regon", F.lit(""))
                         .withColumn("city", F.lit("x")).withColumn("website", F.lit(None).cast("string"))).first()
    assert r["invalid_country"] == 2          # trailing newline is invalid (end of text, not end of line)
    assert r["invalid_phone"] == 2 and r["invalid_email"] == 2
    assert r["street_prefix_left"] == 2 and r["missing_nip_and_regon"] == 4


def test_duplicate_report(spark):
    df = spark.createDataFrame(
        [("1", "r1", None, True), ("1", "r1", None, False), ("1", "r2", "k", True), ("2", "r3", "k", True)],
        "nip string, regon string, krs_number string, is_current boolean")
    r = Q.duplicate_report(df).first()
    assert (r["nip_history_groups"], r["nip_history_rows"]) == (1, 3)
    assert (r["multi_current_nip_groups"], r["multi_current_nip_rows"]) == (1, 2)
    assert (r["regon_groups"], r["regon_rows"]) == (0, 0)
    assert (r["krs_number_groups"], r["krs_number_rows"]) == (1, 2)


def _companies(spark):
    rows = [(i, f"c{i}", f"{i % 7:010d}" if i % 7 else None, "", None, "AKTYWNY" if i % 2 else "ZAWIESZONY", f"P{i % 3}") for i in range(60)]
    return spark.createDataFrame(rows * 2, "id long, ceidg_id string, nip string, regon string, krs_number string, status string, county string")


def test_current_rows_are_the_flagged_ones_without_a_join(spark):
    from kanon.operators.identity import current_only, current_rows, flag_current

    df = _companies(spark).withColumn("updated_at", F.when(F.col("id") % 4 > 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval("id")))
    got, want = current_rows(df), current_only(flag_current(df))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = current_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("WindowGroupLimit") == 2


def test_distribution_groups_the_rows_once(spark):
    out = A.distribution(_companies(spark), "county", limit=20, min_bucket=1)
    assert {tuple(r)[:4] for r in out.collect()} == {(f"P{k}", 40, 20, 120) for k in range(3)}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
