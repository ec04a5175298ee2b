"""Company identity and current-record selection.

``flag_current`` marks exactly one current row per identity. It is written as
an aggregate + join-back instead of ``row_number() over (partition by identity)``:

* the winner per identity is ``min(struct(order keys..., id))`` — a hash
  aggregate with map-side partial aggregation, so an identity holding a third
  of all rows is reduced to one row per map task before the shuffle (a window
  would sort that whole group inside one task);
* only narrow columns (key + ordering struct) go through that shuffle;
* the flag is attached by joining the one winner per identity back on the
  identity (AQE splits a skewed side) and comparing ids null-safely, so a NULL id can
  win; if an id is used twice inside one identity, one of the copies wins.

``flag_current_window`` is the literal window form. Filtered on its flag (:func:`current_rows`) it needs neither aggregate nor
join: Spark keeps the first row per identity in every map task (window group limit), so only those are shuffled and
a large identity does not fill one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kanon.functions.common import blank_null, micros_ntz, present

# Status rank map (upper-cased status -> rank; anything else ranks 4).
STATUS_RANKS = {"AKTYWNY": 1, "ACTIVE": 1, "ZAWIESZONY": 2, "WYKRESLONY": 3}
OTHER_RANK = 4

# Event-date precedence (first non-null wins), then updated date, then 0001-01-01.
EVENT_DATE_COLUMNS = ("ended_on", "removed_on", "suspended_on", "resumed_on", "registered_on", "started_on")


def identity_key(
    nip: str = "nip", krs: str = "krs_number", regon: str = "regon", ceidg: str = "ceidg_id", row_id: str = "id"
) -> Column:
    """``nip:`` → ``krs:`` → ``regon:`` → ``ceidg:``(upper) → ``id:``; never NULL."""
    return (
        F.when(present(nip), F.concat(F.lit("nip:"), F.trim(F.col(nip))))
        .when(present(krs), F.concat(F.lit("krs:"), F.trim(F.col(krs))))
        .when(present(regon), F.concat(F.lit("regon:"), F.trim(F.col(regon))))
        .when(present(ceidg), F.concat(F.lit("ceidg:"), F.upper(F.trim(F.col(ceidg)))))
        .otherwise(F.concat(F.lit("id:"), F.col(row_id).cast("string")))
    )


def status_rank(status: str = "status") -> Column:
    up = F.upper(F.coalesce(F.col(status), F.lit("")))
    expr = None
    for value, rank in STATUS_RANKS.items():
        expr = (F.when(up == value, rank) if expr is None else expr.when(up == value, rank))
    return expr.otherwise(OTHER_RANK)


def event_date(df: DataFrame, updated: str = "updated_at", floor: bool = True) -> Column:
    """First non-null lifecycle date present in ``df``; then updated date; then 0001-01-01."""
    cols = [F.col(c) for c in EVENT_DATE_COLUMNS if c in df.columns]
    if updated in df.columns:
        cols.append(F.col(updated).cast("date"))
    if floor:
        cols.append(F.lit("0001-01-01").cast("date"))
    return F.coalesce(*cols) if len(cols) > 1 else cols[0]


def _order_struct(df: DataFrame, row_id: str, updated: str) -> Column:
    """Ascending struct equal to: rank asc, event date desc, updated desc (nulls first), id asc."""
    upd = F.col(updated) if updated in df.columns else F.lit(None).cast("timestamp_ntz")
    return F.struct(
        status_rank().alias("r"),
        (-F.unix_date(event_date(df, updated))).alias("d"),
        upd.isNotNull().alias("u_present"),
        (-micros_ntz(upd)).alias("u"),
        F.col(row_id).alias("id"),
    )


def _with_identity_columns(df: DataFrame) -> DataFrame:
    """Identity columns a source lacks (e.g. trader rows carry no court number) count as NULL."""
    for c in ("nip", "krs_number", "regon", "ceidg_id"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def flag_current(df: DataFrame, row_id: str = "id", updated: str = "updated_at") -> DataFrame:
    """Add ``identity_key``, ``current_rank`` and ``is_current`` (one current row per identity)."""
    df = _with_identity_columns(df)
    keyed = df.withColumn("identity_key", identity_key(row_id=row_id)).withColumn("current_rank", status_rank())
    winners = (
        keyed.groupBy("identity_key")
        .agg(F.min(_order_struct(keyed, row_id, updated)).alias("_win"))
    )
    same = _order_struct(keyed, row_id, updated).eqNullSafe(F.col("_win"))
    copies = Window.partitionBy("identity_key", row_id, "_wins").orderBy(F.lit(0))
    return (
        keyed.join(winners, "identity_key")
        .withColumn("_wins", same)
        .withColumn("is_current", F.col("_wins") & (F.row_number().over(copies) == 1))
        .select(*keyed.columns, "is_current")
    )


def flag_current_window(df: DataFrame, row_id: str = "id", updated: str = "updated_at") -> DataFrame:
    """Literal ``row_number()`` form of :func:`flag_current` (same result)."""
    df = _with_identity_columns(df)
    keyed = df.withColumn("identity_key", identity_key(row_id=row_id)).withColumn("current_rank", status_rank())
    w = Window.partitionBy("identity_key").orderBy(_order_struct(keyed, row_id, updated))
    return keyed.withColumn("is_current", F.row_number().over(w) == 1)


def current_rows(df: DataFrame, row_id: str = "id", updated: str = "updated_at") -> DataFrame:
    """The rows that :func:`flag_current` marks as current, with the same columns: one shuffle of one row per identity and map task."""
    return flag_current_window(df, row_id, updated).filter(F.col("is_current"))


def current_only(df: DataFrame, include_history: bool = False) -> DataFrame:
    """current rows only unless history is asked for (partition-pruned when stored by ``is_current``)."""
    return df if include_history else df.filter(F.col("is_current"))


def search_order(df: DataFrame, updated: str = "updated_at", row_id: str = "id") -> list[Column]:
    """L1 order: current first, rank, event date desc nulls last, updated desc, ceidg_id, then id (total)."""
    ev = event_date(df, updated, floor=False)
    return [
        F.col("is_current").desc_nulls_last(),
        F.col("current_rank").asc_nulls_last(),
        ev.desc_nulls_last(),
        F.col(updated).desc_nulls_first(),
        F.col("ceidg_id").asc_nulls_last(),
        F.col(row_id).asc_nulls_last(),
    ]


__all__ = [
    "identity_key",
    "status_rank",
    "event_date",
    "flag_current",
    "flag_current_window",
    "current_rows",
    "current_only",
    "search_order",
    "blank_null",
]
