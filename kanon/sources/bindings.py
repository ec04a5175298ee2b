"""Bindings of the registry data model onto the driver tables (see FIXTURES.md part B).

Each binding is a lazy DataFrame built with the DataFrame API; the same
definition as SQL text (``BINDING_SQL``) is prepended as a CTE to the DuckDB
oracle queries so both engines read identical rows.

Scale notes: ``nation`` / ``region`` are fixed 25 / 5 row dimensions, so they
are broadcast explicitly; the customer ⋈ orders join is left to AQE, which
broadcasts customer only when its runtime size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanon.sources.tables import read_table


def _lpad_str(c, n: int):
    return F.lpad(F.col(c).cast("string"), n, "0")


def company_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many dated rows per company identity (orders = registry rows, customer = owner)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
    j = o.join(cust, o.o_custkey == cust.c_custkey)
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    started = F.col("o_orderdate").cast("date")
    return j.select(
        ok.alias("id"),
        F.concat(F.lit("c"), ok.cast("string")).alias("ceidg_id"),
        F.when(ck % 7 != 0, _lpad_str("o_custkey", 10)).alias("nip"),
        F.when(ck % 5 != 0, _lpad_str("o_custkey", 9)).otherwise(F.lit("")).alias("regon"),
        F.when(ck % 3 == 0, _lpad_str("o_custkey", 10)).alias("krs_number"),
        F.col("c_name").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "AKTYWNY")
        .when(F.col("o_orderstatus") == "O", "ZAWIESZONY")
        .otherwise("WYKRESLONY")
        .alias("status"),
        F.col("r_name").alias("voivodeship"),
        F.col("n_name").alias("county"),
        F.col("c_mktsegment").alias("city"),
        F.col("o_orderpriority").alias("legal_form"),
        F.concat(
            F.lpad((ok % 97).cast("string"), 2, "0"), F.lpad((ck % 89).cast("string"), 2, "0"), F.lit("Z")
        ).alias("main_pkd_code"),
        F.when(ok % 11 == 0, "POLSKA").when(ok % 13 == 0, "").otherwise("PL").alias("country"),
        F.when(ok % 4 == 0, "ul. Lipowa").otherwise("Polna").alias("street"),
        F.when(ck % 2 == 0, F.concat(F.lit("+48"), (F.lit(600000000) + ck).cast("string")))
        .when(ck % 9 == 0, "12 34")
        .alias("phone"),
        F.when(ck % 4 == 1, F.concat(F.lit("c"), ck.cast("string"), F.lit("@example.com")))
        .when(ck % 8 == 3, "bad")
        .alias("email"),
        F.when(ck % 6 == 0, "https://example.com").alias("website"),
        started.alias("started_on"),
        F.when(F.col("o_orderstatus") == "P", F.date_add(started, 30)).alias("removed_on"),
        F.col("o_orderdate").alias("updated_at"),
    )


def registry_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second registry (court-style rows) overlapping company_history by number, nip or regon."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    k = F.col("s_suppkey")
    return j.select(
        k.alias("b_id"),
        F.when(k % 4 == 0, F.lpad((k * 3).cast("string"), 10, "0")).alias("krs_number"),
        F.when(k % 4 <= 1, _lpad_str("s_suppkey", 10))
        .when(k % 4 == 3, F.lpad((k + 900000000).cast("string"), 10, "0"))
        .alias("nip"),
        F.when((k % 4 == 1) | (k % 4 == 2), _lpad_str("s_suppkey", 9)).alias("regon"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("county"),
        F.when(F.col("s_acctbal") < 0, "2").otherwise("1").alias("source_status"),
    )


def import_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("run_id"),
        F.col("event_type").alias("import_kind"),
        F.col("ts").alias("started_at"),
        F.when(eid % 6 != 0, F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"),
        F.when(eid % 6 == 0, "running")
        .when(eid % 5 == 0, "failed")
        .when(eid % 4 == 0, "partial")
        .otherwise("completed")
        .alias("status"),
        F.col("props").alias("details"),
    )


def import_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    return (
        e.groupBy(F.col("event_type"), day.alias("changes_from"))
        .agg(
            F.sum(F.when(F.col("value") >= 10, 1).otherwise(0)).cast("bigint").alias("imported_count"),
            F.sum(F.when(F.col("value") < 10, 1).otherwise(0)).cast("bigint").alias("skipped_count"),
            (F.count(F.lit(1)) % 3 != 0).alias("completed"),
            F.max("ts").alias("updated_at"),
        )
        .select(
            F.concat(F.col("event_type"), F.lit(":"), F.col("changes_from").cast("string")).alias("checkpoint_key"),
            F.col("event_type").alias("import_kind"),
            "changes_from",
            "imported_count",
            "skipped_count",
            F.lit(0).cast("bigint").alias("failed_count"),
            "completed",
            "updated_at",
        )
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        "user_id",
        (F.col("user_id") % 20).alias("api_key_id"),
        "ts",
        F.concat(F.lit("GET /"), F.col("event_type")).alias("endpoint"),
        (F.col("event_id") % 101).cast("int").alias("returned_rows"),
        (F.col("event_type") == "click").alias("has_contact"),
        (F.col("event_type") == "purchase").alias("has_raw"),
    )


def landing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    ks = k.cast("string")
    return c.select(
        k.alias("page_key"),
        F.when(k % 4 == 0, 200).when(k % 4 == 1, 204).when(k % 4 == 2, 429).otherwise(500).alias("status_code"),
        F.concat(
            F.lit('{"firmy":[{"id":"A'), ks, F.lit('","wlasciciel":{"nip":"'), F.lpad(ks, 10, "0"),
            F.lit('"}}],"identyfikatoryWpisow":["A'), ks, F.lit('",""],"count":1}'),
        ).alias("content"),
    )


BINDINGS = {
    "company_history": company_history,
    "registry_b": registry_b,
    "import_run": import_run,
    "import_checkpoint": import_checkpoint,
    "usage_log": usage_log,
    "landing_index": landing_index,
}


# Same bindings as SQL text (FIXTURES.md part B); valid in both Spark SQL and DuckDB.
BINDING_SQL = {
    "company_history": """
select o.o_orderkey as id,
       concat('c', cast(o.o_orderkey as string)) as ceidg_id,
       case when o.o_custkey % 7 <> 0 then lpad(cast(o.o_custkey as string), 10, '0') end as nip,
       case when o.o_custkey % 5 <> 0 then lpad(cast(o.o_custkey as string), 9, '0') else '' end as regon,
       case when o.o_custkey % 3 = 0 then lpad(cast(o.o_custkey as string), 10, '0') end as krs_number,
       c.c_name as name,
       case o.o_orderstatus when 'F' then 'AKTYWNY' when 'O' then 'ZAWIESZONY' else 'WYKRESLONY' end as status,
       r.r_name as voivodeship, n.n_name as county, c.c_mktsegment as city,
       o.o_orderpriority as legal_form,
       concat(lpad(cast(o.o_orderkey % 97 as string), 2, '0'), lpad(cast(o.o_custkey % 89 as string), 2, '0'), 'Z') as main_pkd_code,
       case when o.o_orderkey % 11 = 0 then 'POLSKA' when o.o_orderkey % 13 = 0 then '' else 'PL' end as country,
       case when o.o_orderkey % 4 = 0 then 'ul. Lipowa' else 'Polna' end as street,
       case when o.o_custkey % 2 = 0 then concat('+48', cast(600000000 + o.o_custkey as string)) when o.o_custkey % 9 = 0 then '12 34' end as phone,
       case when o.o_custkey % 4 = 1 then concat('c', cast(o.o_custkey as string), '@example.com') when o.o_custkey % 8 = 3 then 'bad' end as email,
       case when o.o_custkey % 6 = 0 then 'https://example.com' end as website,
       cast(o.o_orderdate as date) as started_on,
       case when o.o_orderstatus = 'P' then cast(cast(o.o_orderdate as date) + interval '30' day as date) end as removed_on,
       o.o_orderdate as updated_at
from orders o
join customer c on c.c_custkey = o.o_custkey
join nation n on n.n_nationkey = c.c_nationkey
join region r on r.r_regionkey = n.n_regionkey""",
    "registry_b": """
select s.s_suppkey as b_id,
       case when s.s_suppkey % 4 = 0 then lpad(cast(s.s_suppkey * 3 as string), 10, '0') end as krs_number,
       case when s.s_suppkey % 4 <= 1 then lpad(cast(s.s_suppkey as string), 10, '0')
            when s.s_suppkey % 4 = 3 then lpad(cast(s.s_suppkey + 900000000 as string), 10, '0') end as nip,
       case when s.s_suppkey % 4 in (1, 2) then lpad(cast(s.s_suppkey as string), 9, '0') end as regon,
       s.s_name as name, n.n_name as county,
       case when s.s_acctbal < 0 then '2' else '1' end as source_status
from supplier s join nation n on n.n_nationkey = s.s_nationkey""",
    "import_run": """
select e.event_id as run_id, e.event_type as import_kind, e.ts as started_at,
       case when e.event_id % 6 <> 0 then e.ts + interval '10' minute end as finished_at,
       case when e.event_id % 6 = 0 then 'running' when e.event_id % 5 = 0 then 'failed'
            when e.event_id % 4 = 0 then 'partial' else 'completed' end as status,
       e.props as details
from events e""",
    "import_checkpoint": """
select concat(event_type, ':', cast(cast(ts as date) as string)) as checkpoint_key, event_type as import_kind,
       cast(ts as date) as changes_from,
       cast(sum(case when value >= 10 then 1 else 0 end) as bigint) as imported_count,
       cast(sum(case when value < 10 then 1 else 0 end) as bigint) as skipped_count,
       cast(0 as bigint) as failed_count,
       count(*) % 3 <> 0 as completed, max(ts) as updated_at
from events group by event_type, cast(ts as date)""",
    "usage_log": """
select event_id as request_id, user_id, user_id % 20 as api_key_id, ts,
       concat('GET /', event_type) as endpoint, cast(event_id % 101 as int) as returned_rows,
       event_type = 'click' as has_contact, event_type = 'purchase' as has_raw
from events""",
    "landing_index": """
select c_custkey as page_key,
       case when c_custkey % 4 = 0 then 200 when c_custkey % 4 = 1 then 204 when c_custkey % 4 = 2 then 429 else 500 end as status_code,
       concat('{"firmy":[{"id":"A', cast(c_custkey as string), '","wlasciciel":{"nip":"', lpad(cast(c_custkey as string), 10, '0'),
              '"}}],"identyfikatoryWpisow":["A', cast(c_custkey as string), '",""],"count":1}') as content
from customer""",
}


def with_bindings(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with ``WITH name AS (binding), ...`` for the named bindings."""
    parts = [f"{n} AS ({BINDING_SQL[n]}\n)" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    if not parts:
        return sql
    body = sql.lstrip()
    if body[:15].lower() == "with recursive ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].lower() == "with ":  # merge the query's own CTEs into one WITH list
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql
