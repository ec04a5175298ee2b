"""Import monitoring: metrics per kind (A7, A8), latest run (W5), counters (A15), rate (H14),
kinds (U1), window planning / checkpoint keys / resume (T1–T3), keyed checkpoint replace (J7).

The reference runs nine scalar subqueries per kind in a loop; here every
metric is one ``groupBy(kind)`` over runs plus one over checkpoints, joined on
``kind`` (both sides are one row per kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanon.functions.common import micros_ntz

OK_STATES = ("completed", "partial", "running")


def latest_run(runs: DataFrame) -> DataFrame:
    """The most recent run per kind (ties broken by the larger run id)."""
    last = F.max_by(
        F.struct("run_id", "started_at", "finished_at", "status", "details"),
        F.struct("started_at", "run_id"),
    )
    return runs.groupBy("import_kind").agg(last.alias("r")).select("import_kind", "r.*")


def json_counter(details: Column, keys: tuple[str, ...]) -> Column:
    """First of ``keys`` present in the JSON object as an integral number, else NULL."""
    # inside a lambda every path is read once; under CASE it would be read again for each use
    texts = F.array(*[F.get_json_object(details, f"$.{k}") for k in keys])
    return F.get(F.filter(F.transform(texts, lambda t: F.when(t.rlike(r"^-?[0-9]+\z"), t.try_cast("bigint"))), lambda n: n.isNotNull()), F.lit(0))


def records_per_minute(started: Column, finished: Column, imported: Column) -> Column:
    """Imported / elapsed minutes, half-even 2 dp; NULL if unfinished, imported <= 0 or minutes <= 0."""
    micros = micros_ntz(finished) - micros_ntz(started)
    rate = lambda n: F.bround(n.cast("decimal(20,0)") * F.lit(60000000) / micros.cast("decimal(20,0)"), 2).cast("double")
    return F.get(F.transform(F.array(imported), lambda n: F.when(finished.isNotNull() & (n > 0) & (micros > 0), rate(n))), F.lit(0))


def skip_breakdown(kind: Column, skipped: Column) -> Column:
    """Skipped split into existing / not found / other by import kind."""
    k = F.lower(kind)
    existing = k.isin("changes-detail", "initial-index-detail")
    not_found = k == "krs-current-excerpt"
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.when(existing, skipped).otherwise(zero).alias("skipped_existing"),
        F.when(not_found & ~existing, skipped).otherwise(zero).alias("skipped_not_found"),
        F.when(~existing & ~not_found, skipped).otherwise(zero).alias("skipped_other"),
    )


def import_metrics(runs: DataFrame, checkpoints: DataFrame, as_of: str,
                   counter_keys: tuple[str, ...] = ("imported", "importedThisRun")) -> DataFrame:
    """One row per import kind appearing in runs or checkpoints."""
    as_of_ts = F.lit(as_of).cast("timestamp_ntz")
    last = F.max_by(F.struct("started_at", "finished_at", "status", "details"), F.struct("started_at", "run_id"))
    r = runs.groupBy("import_kind").agg(
        last.alias("last"),
        F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("last_completed_run"),
        F.count_if(F.col("status") == "running").alias("running_runs"),
        F.count_if(~F.col("status").isin(*OK_STATES)
                   & (F.col("started_at") >= as_of_ts - F.expr("INTERVAL 24 HOURS"))).alias("failed_runs_24h"),
    )
    c = checkpoints.groupBy("import_kind").agg(
        F.sum("imported_count").alias("imported"),
        F.sum("skipped_count").alias("skipped"),
        F.sum("failed_count").alias("failed"),
        F.max(F.when(F.col("imported_count") > 0, F.col("updated_at"))).alias("last_successful_checkpoint"),
        F.max("updated_at").alias("last_checkpoint"),
        F.bool_or(~F.col("completed")).alias("has_incomplete_checkpoint"),
    )
    j = r.join(c, "import_kind", "full_outer")
    zero = F.lit(0).cast("bigint")
    imported_last = json_counter(F.col("last.details"), counter_keys)
    skipped = F.coalesce(F.col("skipped"), zero).cast("bigint")
    return j.select(
        "import_kind",
        F.col("last.started_at").alias("last_run_started_at"),
        F.col("last.finished_at").alias("last_run_finished_at"),
        F.col("last.status").alias("last_run_status"),
        "last_completed_run",
        "last_successful_checkpoint",
        "last_checkpoint",
        F.coalesce(F.col("running_runs"), zero).alias("running_runs"),
        F.coalesce(F.col("failed_runs_24h"), zero).alias("failed_runs_24h"),
        F.coalesce(F.col("imported"), zero).cast("bigint").alias("imported"),
        skipped.alias("skipped"),
        skip_breakdown(F.col("import_kind"), skipped).alias("sb"),
        F.coalesce(F.col("failed"), zero).cast("bigint").alias("failed"),
        imported_last.alias("last_run_imported"),
        records_per_minute(F.col("last.started_at"), F.col("last.finished_at"), imported_last)
        .alias("last_run_records_per_minute"),
        F.coalesce(F.col("has_incomplete_checkpoint"), F.lit(False)).alias("has_incomplete_checkpoint"),
    ).select("*", "sb.*").drop("sb")


def fold_counters(parts: DataFrame, key: str) -> DataFrame:
    """Additive merge of run counters, ``completed`` is the AND of all parts."""
    return parts.groupBy(key).agg(
        F.sum("imported_count").cast("bigint").alias("imported"),
        F.sum("skipped_count").cast("bigint").alias("skipped"),
        F.sum("failed_count").cast("bigint").alias("failed"),
        (F.sum("imported_count") + F.sum("skipped_count") + F.sum("failed_count")).cast("bigint").alias("processed"),
        F.count(F.lit(1)).alias("parts"),
        F.bool_and("completed").alias("completed"),
    )


def union_kinds(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Distinct kinds of both tables, sorted."""
    return runs.select("import_kind").union(checkpoints.select("import_kind")).distinct().orderBy("import_kind")


def plan_windows(bounds: DataFrame, start: str, final: str, days: int) -> DataFrame:
    """Windows of ``days`` (min 1) from ``start`` to ``final``; each ends at min(start+days-1, final)."""
    days = max(1, days)
    step = F.expr(f"INTERVAL {days} DAYS")
    return (
        bounds.select("*", F.explode(F.sequence(F.col(start), F.col(final), step)).alias("window_from"))
        .withColumn("window_to", F.least(F.date_add("window_from", days - 1), F.col(final)))
    )


def changes_checkpoint_key(kind: Column, changes_from: Column, changes_to: Column | None, days: int,
                           page_limit: int) -> Column:
    """``kind:from:to|open:window-N:limit-M`` (dates as yyyyMMdd)."""
    to = F.date_format(changes_to, "yyyyMMdd") if changes_to is not None else F.lit("open")
    return F.concat_ws(":", kind, F.date_format(changes_from, "yyyyMMdd"), F.coalesce(to, F.lit("open")),
                       F.lit(f"window-{max(1, days)}"), F.lit(f"limit-{page_limit}"))


def bulletin_day_key(register: str, day: Column, day_format: str) -> Column:
    """``krs-bulletin-day:register:yyyyMMdd:format``."""
    return F.concat_ws(":", F.lit("krs-bulletin-day"), F.lit(register), F.date_format(day, "yyyyMMdd"), F.lit(day_format))


def seeded_key(register: str, numbers: Column) -> Column:
    """``krs-seeded:register:sha256(numbers joined by '-')`` for an explicit (bounded) number list."""
    return F.concat_ws(":", F.lit("krs-seeded"), F.lit(register), F.sha2(F.array_join(numbers, "-"), 256))


def pending_work(planned: DataFrame, done: DataFrame, keys: list[str], day: str, final: str,
                 lookback_days: int) -> DataFrame:
    """Planned units not yet completed, plus the last ``lookback_days`` before ``final`` always re-planned."""
    open_units = planned.join(done, keys, "left_anti")
    recent = planned.filter(F.col(day) > F.date_sub(F.col(final), lookback_days))
    return open_units.unionByName(recent).distinct()


def resume_units(planned: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """T3 inside a unit: where each planned unit goes on. ``checkpoints`` holds ``completed``, the next page (from 1)
    and item (from 0) and the counters so far; finished units are dropped, new ones start at page 1, item 0 with
    zero counters."""
    counters = ("imported_count", "skipped_count", "failed_count")
    j = planned.join(checkpoints.select(key, "completed", "next_page", "next_item", *counters), key, "left")
    zero = F.lit(0).cast("bigint")
    return j.filter(~F.coalesce("completed", F.lit(False))).select(
        *planned.columns, F.greatest(F.coalesce("next_page", F.lit(1)), F.lit(1)).alias("start_page"),
        F.greatest(F.coalesce("next_item", F.lit(0)), F.lit(0)).alias("start_item"),
        *[F.coalesce(c, zero).cast("bigint").alias(c) for c in counters])


def upsert_replace(current: DataFrame, batch: DataFrame, key: str, order_by: str) -> DataFrame:
    """Keyed replace — per key keep the newest row by ``order_by`` (batch wins ties)."""
    tagged = current.withColumn("_prio", F.lit(0)).unionByName(batch.withColumn("_prio", F.lit(1)))
    cols = [c for c in current.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col(order_by), F.col("_prio")))
    return tagged.groupBy(key).agg(best.alias("b")).select(key, "b.*")
