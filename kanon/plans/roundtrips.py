"""Sinks and resumable work, checked by writing given tables and reading them back (S9, S10, S11 + J7, S12, L5, T3, T5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kanon.operators import aggregates as AG
from kanon.operators import monitor as M
from kanon.plans.catalog import query
from kanon.plans.billing import DEBIT_ORACLE
from kanon.plans.company import current, flagged
from kanon.plans.matching import MERGED_ORACLE, company_rows, court_rows, shown
from kanon.plans.sqlbits import IDENTITY_SQL, RANK_SQL, with_flagged
from kanon.sources import landing as L
from kanon.sources import sinks as S
from kanon.sources.bindings import import_checkpoint, with_bindings
from kanon.sources.master import read_master
from kanon.sources.tables import read_table


#: Partitions of the masters that the queries build.
PARTS = 16


def _fresh(spark, name: str) -> str:
    return S.scratch_path(spark, name, uuid.uuid4().hex)


@query("snapshot_current", with_flagged("select id, identity_key, status from current_rows"))
def q_snapshot_current(spark, sf):
    """Write the flagged table as a snapshot version, read its current rows by partition pruning."""
    root = _fresh(spark, "snapshot")
    S.write_snapshot(flagged(spark, sf).limit(0), root, 1)
    S.write_snapshot(flagged(spark, sf), root, 2)
    return S.read_snapshot(spark, root, current_only=True).select("id", "identity_key", "status")


@query("point_lookup", with_flagged("""
select 'nip' as by_key, id, nip, regon, krs_number from flagged where nip = (select max(nip) from flagged)
union all select 'regon', id, nip, regon, krs_number from flagged where regon = (select min(regon) from flagged where regon <> '')
union all select 'krs_number', id, nip, regon, krs_number from flagged where krs_number = (select max(krs_number) from flagged)
union all select 'nip', id, nip, regon, krs_number from flagged where nip = 'no such number'"""))
def q_point_lookup(spark, sf):
    """all rows of one company by one of its numbers, from a copy that is laid out for it (row groups are skipped by range and
    by Bloom filter)."""
    root = _fresh(spark, "lookup")
    rows = flagged(spark, sf)
    S.write_lookup(rows, root)
    # the numbers to look for are arguments of the query
    nip, regon, krs = rows.agg(F.max("nip"), F.min(F.when(F.col("regon") != "", F.col("regon"))), F.max("krs_number")).first()
    shown_cols = ["id", "nip", "regon", "krs_number"]
    found = [S.lookup(spark, root, **{k: v}).select(F.lit(k).alias("by_key"), *shown_cols) for k, v in
             (("nip", nip), ("regon", regon), ("krs_number", krs), ("nip", "no such number"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("append_log", "select cast(ts as date) as day, count(*) as n, count(distinct event_id) as ids from events group by 1")
def q_append_log(spark, sf):
    """Two appends to a date-partitioned log, read back per day."""
    root = _fresh(spark, "log")
    e = read_table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    S.append_events(e.filter("event_id % 2 = 0"), root, "day")
    S.append_events(e.filter("event_id % 2 = 1"), root, "day")
    return spark.read.parquet(root).groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("export_csv", with_flagged("""
select cast(id as varchar) as id, name, '["' || array_to_string(registry_sources, '","') || '"]' as registry_sources
from (select id, name, string_split(case when nullif(trim(coalesce(krs_number, '')), '') is not null then 'CEIDG+KRS' else 'CEIDG' end, '+') as registry_sources
      from current_rows)"""))
def q_export_csv(spark, sf):
    """Explicit columns to CSV with arrays as JSON text, read back."""
    root = _fresh(spark, "export")
    S.export(current(spark, sf), ["id", "name", "registry_sources"], root)
    return spark.read.option("header", True).option("escape", '"').csv(root)


@query("capped_worklist", with_flagged("select id, nip from current_rows order by updated_at desc, id limit 50"))
def q_capped_worklist(spark, sf):
    """The newest 50 items of a work list."""
    return AG.cap(current(spark, sf), [F.col("updated_at").desc(), F.col("id")], 50).select("id", "nip")


_UNITS_SQL = """
select checkpoint_key, import_kind, cast(start_page as int) as start_page, cast(start_item as int) as start_item,
       case when known then imported_count else 0 end as imported_count, case when known then skipped_count else 0 end as skipped_count,
       case when known then failed_count else 0 end as failed_count
from (select *, day(changes_from) % 4 <> 0 as known,
             case when day(changes_from) % 4 <> 0 then imported_count % 5 + 1 else 1 end as start_page,
             case when day(changes_from) % 4 <> 0 then skipped_count % 7 else 0 end as start_item from import_checkpoint)
where not (completed and known)"""


@query("resume_units", with_bindings(_UNITS_SQL, "import_checkpoint"))
def q_resume_units(spark, sf):
    """T3 within a day: unfinished units go on at their page and item with their counters; every fourth day is new."""
    c = import_checkpoint(spark, sf)
    done = c.filter(F.dayofmonth("changes_from") % 4 != 0).select(
        "checkpoint_key", "completed", (F.col("imported_count") % 5 + 1).cast("int").alias("next_page"),
        (F.col("skipped_count") % 7).cast("int").alias("next_item"), "imported_count", "skipped_count", "failed_count")
    return M.resume_units(c.select("checkpoint_key", "import_kind"), done, "checkpoint_key")


@query("upsert_report", """
select 'r' || p_partkey as report_id, case when p_partkey % 2 = 0 then 'https://example.invalid/new/' else 'https://example.invalid/old/' end || p_partkey as request_uri,
       200 as status_code, sha256(case when p_partkey % 2 = 0 then 'v2;' else 'v1;' end || p_name) as content_hash,
       p_name as report_name, case when p_partkey % 2 = 0 then 'v2;' else 'v1;' end || p_name as content, p_type as file_type
from part""")
def q_upsert_report(spark, sf):
    """S11 + J7: report envelopes of two download rounds; the second replaces by report id."""
    p = read_table(spark, sf, "part")
    key = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    null = F.lit(None).cast("string")
    reports = p.select(key.alias("report_id"), F.col("p_name").alias("report_name"), null.alias("report_description"), null.alias("report_parameters"),
                       F.col("p_type").alias("file_type"), null.alias("generated_on"), null.alias("generated_on_date"), F.lit("{}").alias("raw_item"))

    def downloads(rows, tag, folder, when):
        return rows.select(key.alias("report_id"), F.concat(F.lit(f"https://example.invalid/{folder}/"), F.col("p_partkey").cast("string")).alias("request_uri"),
                           F.lit(200).alias("status_code"), F.lit("text/csv").alias("content_type"),
                           F.concat(F.lit(tag), F.col("p_name")).alias("content"), F.lit(when).cast("timestamp_ntz").alias("fetched_at"))

    first = L.report_payloads(reports, downloads(p, "v1;", "old", "2024-01-01 00:00:00"))
    second = L.report_payloads(reports, downloads(p.filter("p_partkey % 2 = 0"), "v2;", "new", "2024-02-01 00:00:00"))
    out = M.upsert_replace(first, second, "report_id", "fetched_at")
    field = lambda path, c: F.get_json_object("payload", path).alias(c)
    return out.select("report_id", "request_uri", "status_code", "content_hash", field("$.report.report_name", "report_name"),
                      field("$.download.content", "content"), field("$.report.file_type", "file_type"))


@query("independent_sources", MERGED_ORACLE)
def q_independent_sources(spark, sf):
    """T5: company rows and court rows arrive in two landing folders, two streams that do not wait for each other bring them
    in, and one job merges what both have finished into the master."""
    from kanon.streaming.jobs import ingest_all, merge_court_batch, merge_sources, upsert_rows

    root = _fresh(spark, "sources")
    tables = {"company": company_rows(spark, sf), "court": court_rows(spark, sf)}
    for name, df in tables.items():
        df.write.parquet(f"{root}/landing/{name}")
    handles = ingest_all(spark, {n: (f"{root}/landing/{n}", df.schema, f"{root}/inbox/{n}") for n, df in tables.items()}, f"{root}/progress")
    for h in handles.values():
        h.awaitTermination()
    merge_sources(spark, f"{root}/master", {n: f"{root}/inbox/{n}" for n in tables},
                  {"company": lambda *a: upsert_rows(*a, parts=PARTS), "court": lambda *a: merge_court_batch(*a, in_id="b_id")})
    return shown(read_master(spark, f"{root}/master"), "identity_key", "is_current")


# ------------------------------------------------------------------ T4
_T = ("2024-03-01 00:00:00", "2024-04-01 00:00:00", "2024-05-01 00:00:00")
_REPLAY_STATE = f"""
select sha256(upper(ceidg_id)) as id, upper(ceidg_id) as ceidg_id, nip, nullif(regon, '') as regon,
       case when id % 5 = 0 then lpad(cast(id as varchar), 10, '0') end as krs_number,
       case when id % 4 = 0 then 'ZAWIESZONY' else status end as status, started_on, removed_on,
       cast(case when id % 4 = 0 then '{_T[2]}' else '{_T[1]}' end as timestamp) as updated_at,
       cast('{_T[1]}' as timestamp) as first_seen_at,
       case when id % 5 = 0 then 'FUNDACJA' else 'JEDNOOSOBOWA DZIAŁALNOŚĆ GOSPODARCZA' end as legal_form,
       case when id % 5 = 0 then '{{CEIDG,KRS}}' else '{{CEIDG}}' end as registry_sources
from company_history"""


@query("ingest_replay", with_bindings(f"""
select ceidg_id, krs_number, status, updated_at, first_seen_at, legal_form, registry_sources, identity_key,
       order_tuple = min(order_tuple) over (partition by identity_key) as is_current
from (select *, {IDENTITY_SQL} as identity_key,
             {{'r': {RANK_SQL}, 'd': date '9999-12-31' - coalesce(removed_on, started_on), 'u': -epoch_us(updated_at), 'id': id}} as order_tuple
      from state)""", "company_history", extra={"state": _REPLAY_STATE}))
def q_ingest_replay(spark, sf):
    """T4 by its job: a first feed; a court batch for every fifth row; then, in a job with a new checkpoint, newer fetches of
    every fourth row, older fetches of every sixth, an error page and a payload without id."""
    from kanon.plans.landing import detail_payloads
    from kanon.streaming.jobs import merge_court_batch, run_ingest

    root = _fresh(spark, "replay")
    at = lambda df, t: df.select("page_key", "content", F.lit(t).cast("timestamp_ntz").alias("fetched_at"))

    def feed(df, name):
        with S.shuffles_freed(spark):
            df.write.parquet(f"{root}/{name}")
        run_ingest(spark, f"{root}/{name}", f"{root}/master", f"{root}/progress/{name}", df.schema, parts=PARTS).awaitTermination()

    pages = detail_payloads(spark, sf)
    feed(at(pages.repartition("page_key"), _T[1]), "first")
    number = F.substr("ceidg_id", F.lit(2)).cast("bigint")
    court = (read_master(spark, f"{root}/master").filter(number % 5 == 0)
             .select(F.lpad(number.cast("string"), 10, "0").alias("krs_number"), F.lit("FUNDACJA").alias("legal_form"), F.array(F.lit("KRS")).alias("registry_sources"), "id"))
    merge_court_batch(spark, court.drop("id"), f"{root}/master", "court", 0, matched=court.select("krs_number", "id"))
    pages = spark.read.parquet(f"{root}/first").select("page_key", "content")
    status = lambda s: F.regexp_replace("content", '"status":"[A-Z]+"', f'"status":"{s}"').alias("content")
    newer = at(pages.filter("page_key % 4 = 0").select("page_key", status("ZAWIESZONY")), _T[2])
    older = at(pages.filter("page_key % 6 = 0").select("page_key", status("WYKRESLONY")), _T[0])
    broken = at(spark.range(2).select((-F.col("id") - 1).alias("page_key"), F.when(F.col("id") == 0, "<html>").otherwise("{}").alias("content")), _T[2])
    feed(newer.unionByName(older).unionByName(broken), "again")
    return read_master(spark, f"{root}/master").select(
        "ceidg_id", "krs_number", "status", "updated_at", "first_seen_at", "legal_form",
        F.concat(F.lit("{"), F.array_join("registry_sources", ","), F.lit("}")).alias("registry_sources"), "identity_key", "is_current")


# ------------------------------------------------------------------ T6 – T9 as streams over many files
@query("feed_first_seen", """
select event_type || ':' || user_id as id, count(distinct cast(ts as date)) as days from events group by 1""")
def q_feed_first_seen(spark, sf):
    """T6 as a stream: an id is reported once a day, and forgotten when the day is over. The feed comes in pieces by time."""
    from kanon.streaming.jobs import file_stream, run_first_seen

    root = _fresh(spark, "first-seen")
    e = read_table(spark, sf, "events")
    feed = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    lo, hi = feed.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / 5
    for k in range(6):  # a file stream takes files by time of arrival
        piece = feed.filter((F.col("ts") >= lo + k * step) & (F.col("ts") < lo + (k + 1) * step))
        piece.repartition(8, "id").write.mode("append").parquet(f"{root}/feed")
    out, _ = run_first_seen(file_stream(spark, f"{root}/feed", feed.schema, max_files=8), "id", "23 hours", root)
    return out.groupBy("id").agg(F.count("*").alias("days"))


@query("daily_rollup_late", """
select cast(ts as date) as day, count(*) as numbers, count(*) filter (where value >= 10) as imported,
       count(*) filter (where event_type = 'error') as failed
from events group by 1""")
def q_daily_rollup_late(spark, sf):
    """T7 as a stream over pieces that come out of order: late rows are rolled up apart and merged back."""
    from kanon.streaming.jobs import daily_rollup, file_stream, run_rollup

    root = _fresh(spark, "rollup")
    e = read_table(spark, sf, "events")
    e.repartition(6, F.dayofmonth("ts")).write.parquet(f"{root}/feed")
    return run_rollup(file_stream(spark, f"{root}/feed", e.schema, max_files=2), daily_rollup, root, "1 day")["merged"]


@query("debit_replay", DEBIT_ORACLE)
def q_debit_replay(spark, sf):
    """T9 as a stream: requests arrive in four pieces by time, each is folded from the balances that the one before left."""
    from kanon.plans.billing import requests_with_cost
    from kanon.streaming.jobs import file_stream, run_debit

    root = _fresh(spark, "debit")
    r = requests_with_cost(spark, sf).select("user_id", "ts", "request_id", "cost")
    lo, hi = r.agg(F.min("ts"), F.max("ts")).first()
    for k in range(4):
        piece = r.filter((F.col("ts") >= lo + (hi - lo) * k / 4) & ((F.col("ts") < lo + (hi - lo) * (k + 1) / 4) | F.lit(k == 3)))
        piece.repartition(2, "user_id").write.mode("append").parquet(f"{root}/feed")
    run_debit(file_stream(spark, f"{root}/feed", r.schema, max_files=2), root, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/applied").select("request_id", "user_id", "accepted", "balance_after")
