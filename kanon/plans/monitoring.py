"""Import-monitoring queries over the run log and checkpoint bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kanon.operators import monitor as M
from kanon.plans.catalog import query
from kanon.sources.bindings import import_checkpoint, import_run, with_bindings
from kanon.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"
# The fixture run log keeps its counter under ``k``.
COUNTER_KEYS = ("imported", "importedThisRun", "k")
REF_KEYS = ("imported", "importedThisRun")
WINDOW_DAYS = 7
PAGE_LIMIT = 50
LOOKBACK_DAYS = 2


def _json_counter_sql(details: str, keys=COUNTER_KEYS) -> str:
    vals = [f"case when regexp_matches(json_extract_string({details}, '$.{k}'), '^-?[0-9]+$') "
            f"then cast(json_extract_string({details}, '$.{k}') as bigint) end" for k in keys]
    return "coalesce(" + ", ".join(vals) + ")"


def _rate_sql(started: str, finished: str, imported: str) -> str:
    micros = f"(epoch_us({finished}) - epoch_us({started}))"
    num = f"(({imported}) * 6000000000)"
    qv = f"({num} // {micros})"
    rv = f"({num} % {micros})"
    rounded = (f"cast({qv} + case when 2 * {rv} > {micros} then 1 when 2 * {rv} = {micros} and {qv} % 2 = 1 "
               f"then 1 else 0 end as double) / 100")
    return f"(case when {finished} is not null and {imported} > 0 and {micros} > 0 then {rounded} end)"


# Event types stand for import kinds; three of them take the names that the skip breakdown knows, and the run
# counter takes a name that the metrics read.
_KINDS = {"view": "changes-detail", "click": "Initial-Index-Detail", "purchase": "krs-current-excerpt"}
_KIND_SQL = "case import_kind " + " ".join(f"when '{a}' then '{b}'" for a, b in _KINDS.items()) + " else import_kind end"
_NAMED_SQL = {
    "runs": f"select * replace ({_KIND_SQL} as import_kind, '{{\"importedThisRun\":' || json_extract_string(details, '$.k') || '}}' as details) from import_run",
    "checkpoints": f"select * replace ({_KIND_SQL} as import_kind) from import_checkpoint",
}


def _named(df):
    return df.withColumn("import_kind", F.expr(_KIND_SQL))


def _named_runs(spark, sf):
    details = F.concat(F.lit('{"importedThisRun":'), F.get_json_object("details", "$.k"), F.lit("}"))
    return _named(import_run(spark, sf)).withColumn("details", details)


_LAST_RUN_SQL = """select * from (select *, row_number() over (partition by import_kind order by started_at desc, run_id desc) as rn
                   from import_run) where rn = 1"""


@query("latest_run", with_bindings(
    "select import_kind, run_id, started_at, finished_at, status, details from last_run", "import_run",
    extra={"last_run": _LAST_RUN_SQL}))
def q_latest_run(spark, sf):
    return M.latest_run(import_run(spark, sf))


@query("records_per_minute", with_bindings(
    f"select run_id, {_rate_sql('started_at', 'finished_at', _json_counter_sql('details'))} as records_per_minute "
    "from import_run", "import_run"))
def q_records_per_minute(spark, sf):
    r = import_run(spark, sf)
    imported = M.json_counter(F.col("details"), COUNTER_KEYS)
    return r.select("run_id", M.records_per_minute(F.col("started_at"), F.col("finished_at"), imported)
                    .alias("records_per_minute"))


@query("union_kinds", with_bindings(
    "select import_kind from import_run union select import_kind from import_checkpoint order by import_kind",
    "import_run", "import_checkpoint"))
def q_union_kinds(spark, sf):
    return M.union_kinds(import_run(spark, sf), import_checkpoint(spark, sf))


@query("run_counters", with_bindings("""
select import_kind, cast(sum(imported_count) as bigint) as imported, cast(sum(skipped_count) as bigint) as skipped,
       cast(sum(failed_count) as bigint) as failed,
       cast(sum(imported_count) + sum(skipped_count) + sum(failed_count) as bigint) as processed,
       count(*) as parts, bool_and(completed) as completed
from import_checkpoint group by import_kind""", "import_checkpoint"))
def q_run_counters(spark, sf):
    return M.fold_counters(import_checkpoint(spark, sf), "import_kind")


@query("import_metrics", with_bindings(f"""
select k.import_kind,
       l.started_at as last_run_started_at, l.finished_at as last_run_finished_at, l.status as last_run_status,
       ra.last_completed_run, ca.last_successful_checkpoint, ca.last_checkpoint,
       coalesce(ra.running_runs, 0) as running_runs, coalesce(ra.failed_runs_24h, 0) as failed_runs_24h,
       cast(coalesce(ca.imported, 0) as bigint) as imported, cast(coalesce(ca.skipped, 0) as bigint) as skipped,
       cast(case when lower(k.import_kind) in ('changes-detail', 'initial-index-detail') then coalesce(ca.skipped, 0) else 0 end as bigint) as skipped_existing,
       cast(case when lower(k.import_kind) = 'krs-current-excerpt' then coalesce(ca.skipped, 0) else 0 end as bigint) as skipped_not_found,
       cast(case when lower(k.import_kind) not in ('changes-detail', 'initial-index-detail', 'krs-current-excerpt') then coalesce(ca.skipped, 0) else 0 end as bigint) as skipped_other,
       cast(coalesce(ca.failed, 0) as bigint) as failed,
       {_json_counter_sql('l.details', REF_KEYS)} as last_run_imported,
       {_rate_sql('l.started_at', 'l.finished_at', _json_counter_sql('l.details', REF_KEYS))} as last_run_records_per_minute,
       coalesce(ca.has_incomplete_checkpoint, false) as has_incomplete_checkpoint
from (select import_kind from runs union select import_kind from checkpoints) k
left join last_run l on l.import_kind = k.import_kind
left join (select import_kind, max(finished_at) filter (where status = 'completed') as last_completed_run,
                  count(*) filter (where status = 'running') as running_runs,
                  count(*) filter (where status not in ('completed', 'partial', 'running')
                                   and started_at >= timestamp '{AS_OF}' - interval 24 hour) as failed_runs_24h
           from runs group by import_kind) ra on ra.import_kind = k.import_kind
left join (select import_kind, sum(imported_count) as imported, sum(skipped_count) as skipped, sum(failed_count) as failed,
                  max(updated_at) filter (where imported_count > 0) as last_successful_checkpoint,
                  max(updated_at) as last_checkpoint, bool_or(not completed) as has_incomplete_checkpoint
           from checkpoints group by import_kind) ca on ca.import_kind = k.import_kind""",
    "import_run", "import_checkpoint", extra=_NAMED_SQL | {"last_run": _LAST_RUN_SQL.replace("from import_run", "from runs")}))
def q_import_metrics(spark, sf):
    """Reference counter names only (``imported`` / ``importedThisRun``), as-of 2024-01-31."""
    return M.import_metrics(_named_runs(spark, sf), _named(import_checkpoint(spark, sf)), AS_OF, REF_KEYS)


def _bounds(spark, sf):
    return import_checkpoint(spark, sf).groupBy("import_kind").agg(
        F.min("changes_from").alias("first_day"), F.max("changes_from").alias("final_day"))


_BOUNDS_SQL = ("select import_kind, min(changes_from) as first_day, max(changes_from) as final_day "
               "from import_checkpoint group by import_kind")


@query("window_plan", with_bindings(f"""
select import_kind, cast(w as date) as window_from, least(cast(w as date) + {WINDOW_DAYS - 1}, final_day) as window_to
from (select import_kind, final_day, unnest(generate_series(first_day, final_day, interval {WINDOW_DAYS} day)) as w
      from bounds)""", "import_checkpoint", extra={"bounds": _BOUNDS_SQL}))
def q_window_plan(spark, sf):
    w = M.plan_windows(_bounds(spark, sf), "first_day", "final_day", WINDOW_DAYS)
    return w.select("import_kind", "window_from", "window_to")


@query("checkpoint_key", with_bindings(f"""
select import_kind, window_from,
       concat_ws(':', import_kind, strftime(window_from, '%Y%m%d'), strftime(window_to, '%Y%m%d'),
                 'window-{WINDOW_DAYS}', 'limit-{PAGE_LIMIT}') as checkpoint_key,
       concat_ws(':', 'krs-bulletin-day', 'P', strftime(window_from, '%Y%m%d'), 'yyyy-MM-dd') as bulletin_key
from (select import_kind, cast(w as date) as window_from,
             least(cast(w as date) + {WINDOW_DAYS - 1}, final_day) as window_to
      from (select import_kind, final_day, unnest(generate_series(first_day, final_day, interval {WINDOW_DAYS} day)) as w
            from bounds))""", "import_checkpoint", extra={"bounds": _BOUNDS_SQL}))
def q_checkpoint_key(spark, sf):
    w = M.plan_windows(_bounds(spark, sf), "first_day", "final_day", WINDOW_DAYS)
    return w.select(
        "import_kind", "window_from",
        M.changes_checkpoint_key(F.col("import_kind"), F.col("window_from"), F.col("window_to"), WINDOW_DAYS,
                                 PAGE_LIMIT).alias("checkpoint_key"),
        M.bulletin_day_key("P", F.col("window_from"), "yyyy-MM-dd").alias("bulletin_key"),
    )


@query("pending_work", with_bindings(f"""
with planned as (select import_kind, cast(d as date) as day, final_day
                 from (select import_kind, final_day, unnest(generate_series(first_day, final_day, interval 1 day)) as d
                       from bounds))
select distinct import_kind, day from planned p
where not exists (select 1 from import_checkpoint c where c.completed and c.import_kind = p.import_kind
                  and c.changes_from = p.day)
   or day > final_day - {LOOKBACK_DAYS}""", "import_checkpoint", extra={"bounds": _BOUNDS_SQL}))
def q_pending_work(spark, sf):
    planned = M.plan_windows(_bounds(spark, sf), "first_day", "final_day", 1).select(
        "import_kind", F.col("window_from").alias("day"), "final_day")
    done = import_checkpoint(spark, sf).filter("completed").select("import_kind", F.col("changes_from").alias("day"))
    return M.pending_work(planned, done, ["import_kind", "day"], "day", "final_day", LOOKBACK_DAYS).select(
        "import_kind", "day")


@query("upsert_checkpoint", with_bindings("""
with batch as (
  select concat(event_type, ':', cast(cast(ts as date) as string)) as checkpoint_key, event_type as import_kind,
         cast(ts as date) as changes_from,
         cast(count(*) as bigint) as imported_count, cast(0 as bigint) as skipped_count, cast(0 as bigint) as failed_count,
         true as completed, max(ts) + interval 1 hour as updated_at
  from events where value >= 50 group by event_type, cast(ts as date)),
tagged as (select *, 0 as prio from import_checkpoint union all select *, 1 as prio from batch)
select checkpoint_key, import_kind, changes_from, imported_count, skipped_count, failed_count, completed, updated_at
from (select *, row_number() over (partition by checkpoint_key order by updated_at desc, prio desc) as rn from tagged)
where rn = 1""", "import_checkpoint"))
def q_upsert_checkpoint(spark, sf):
    """A re-run batch (values >= 50, one hour later) replaces existing checkpoints by key."""
    e = read_table(spark, sf, "events").filter(F.col("value") >= 50)
    day = F.col("ts").cast("date")
    batch = e.groupBy(F.col("event_type"), day.alias("changes_from")).agg(
        F.count(F.lit(1)).cast("bigint").alias("imported_count"),
        (F.max("ts") + F.expr("INTERVAL 1 HOURS")).alias("updated_at"),
    ).select(
        F.concat(F.col("event_type"), F.lit(":"), F.col("changes_from").cast("string")).alias("checkpoint_key"),
        F.col("event_type").alias("import_kind"), "changes_from", "imported_count",
        F.lit(0).cast("bigint").alias("skipped_count"), F.lit(0).cast("bigint").alias("failed_count"),
        F.lit(True).alias("completed"), "updated_at",
    )
    return M.upsert_replace(import_checkpoint(spark, sf), batch, "checkpoint_key", "updated_at")
