"""Ordered aggregates and small set / top-k operators (A9–A12, U2, L3–L5), plus a skew-safe running sum.

``running_sums`` is the building block for every order-dependent running
value (ledger balance W7, request-rate windows W8, debit fold T9): a window
``partitionBy(key).orderBy(ts)`` puts a whole key into one task, so instead
rows are summed within one second of a key, and the totals — one row per key
and second — become offsets through two more levels, seconds of an hour and
hours of a key. Result = offset + sum within the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kanon.functions.common import micros_ntz


def ordered_concat(df: DataFrame, group: str, value: Column, order: Column, sep: str = ", ",
                   where: Column | None = None) -> DataFrame:
    """``string_agg(value, sep order by order) filter (where …)``; empty → NULL."""
    v = value if where is None else F.when(where, value)
    items = F.collect_list(F.when(v.isNotNull(), F.struct(order.alias("o"), v.alias("v"))))
    joined = F.array_join(F.transform(F.array_sort(items), lambda s: s["v"]), sep)
    return df.groupBy(group).agg(F.nullif(joined, F.lit("")).alias("concat"))


def json_agg_ordered(df: DataFrame, group: str, fields: list[str], order: list[str]) -> DataFrame:
    """A10: JSON array of objects ordered by the ``order`` columns (NULL fields kept as JSON null)."""
    key = F.struct(*[F.col(c) for c in order])
    items = F.array_sort(F.collect_list(F.struct(key.alias("_o"), *[F.col(f) for f in fields])))
    objs = F.transform(items, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return df.groupBy(group).agg(F.to_json(objs, {"ignoreNullFields": "false"}).alias("json"))


def main_code(df: DataFrame, group: str, code: Column, is_main: Column) -> DataFrame:
    """``coalesce(min(code) filter (where main), min(code))``."""
    return df.groupBy(group).agg(F.coalesce(F.min(F.when(is_main, code)), F.min(code)).alias("main_code"))


def union_flagged(main: DataFrame, other: DataFrame, flag: str = "is_main") -> DataFrame:
    """``union all`` of main and other items with a flag."""
    return main.withColumn(flag, F.lit(True)).unionByName(other.withColumn(flag, F.lit(False)))


def union_sources(df: DataFrame, group: str, sources: str) -> DataFrame:
    """Distinct union of source arrays across rows."""
    return df.groupBy(group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sources)))).alias(sources))


def newest(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    """L4: newest first with NULL as the oldest, take ``n`` (0 = all). ``tie`` keeps the input order."""
    ordered = df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie).asc())
    return ordered if n == 0 else ordered.limit(n)


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """L3 per group: ``row_number() <= n``. Catalyst inserts a WindowGroupLimit below the shuffle, so
    each map task forwards at most ``n`` rows per group — a hot group stays small."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def cap(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """Cap a sorted work list at ``n`` items (``None`` / 0 = no cap)."""
    return df.orderBy(*order).limit(n) if n else df


# ------------------------------------------------------------------ skew-safe running values
SECOND, HOUR = 1_000_000, 3600


def bucket(ts) -> Column:
    """Whole seconds of a naive timestamp."""
    return F.floor(micros_ntz(ts) / F.lit(SECOND)).cast("bigint")


def exclusive_scan(per: DataFrame, key: str, b: str, values: dict[str, str]) -> DataFrame:
    """``per`` has one row per (key, second ``b``). Adds, per value column, what all earlier seconds of the key carry:
    kind ``sum`` their total (0 if none), kind ``last`` the latest non-NULL value. Two levels, seconds within
    an hour and hours within a key, so no window holds more than 3,600 rows of the first or the key's hours."""
    x = per.withColumn("_hour", F.floor(F.col(b) / HOUR).cast("bigint"))
    inside = Window.partitionBy(key, "_hour").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)

    def over(c: str, kind: str, w) -> Column:
        return F.sum(c).over(w) if kind == "sum" else F.last(c, ignorenulls=True).over(w)

    def hourly(c: str, kind: str) -> Column:
        return (F.sum(c) if kind == "sum" else F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(b)))).alias(c)

    hours = x.groupBy(key, "_hour").agg(*[hourly(c, k) for c, k in values.items()])
    hours = hours.select(key, "_hour", *[over(c, k, before).alias(f"_h_{c}") for c, k in values.items()])
    x = x.select("*", *[over(c, k, inside).alias(f"_s_{c}") for c, k in values.items()]).join(hours, [key, "_hour"])
    zero = F.lit(0)
    done = [(F.coalesce(f"_s_{c}", zero) + F.coalesce(f"_h_{c}", zero) if k == "sum" else F.coalesce(f"_s_{c}", f"_h_{c}")).alias(f"_off_{c}")
            for c, k in values.items()]
    return x.select(key, b, *done)


def running_sums(df: DataFrame, key: str, ts: str, tie: str, values: dict[str, Column]) -> DataFrame:
    """Running sum per ``key`` in (ts, tie) order, inclusive of the current row, for every ``out: value``.

    Rows are summed inside (key, second) partitions; the totals of all earlier seconds come from
    :func:`exclusive_scan` over one row per key and second. However many rows a key or an hour holds, a task
    sees one second of one key at a time."""
    x = df.withColumn("_bkt", bucket(ts)).withColumns({f"_v_{o}": v for o, v in values.items()})
    sums = {f"_v_{o}": "sum" for o in values}
    per = x.groupBy(key, "_bkt").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = exclusive_scan(per, key, "_bkt", sums)
    own = Window.partitionBy(key, "_bkt").orderBy(F.col(ts), F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
    inner = x.select(*df.columns, "_bkt", *[F.sum(c).over(own).alias(c) for c in sums])
    out = inner.join(offsets, [key, "_bkt"])
    return out.select(*df.columns, *[(F.col(f"_off__v_{o}") + F.col(f"_v_{o}")).alias(o) for o in values])


def running_sum(df: DataFrame, key: str, ts: str, tie: str, value: Column, out: str) -> DataFrame:
    """:func:`running_sums` of one value."""
    return running_sums(df, key, ts, tie, {out: value})
