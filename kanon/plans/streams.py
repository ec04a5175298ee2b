"""Roll-up queries (T7, T8): the streaming builders over the whole events table as a batch.

A watermark has no effect on a batch, so the result is that of a stream that has seen every row;
``tests/test_streaming.py`` holds the stream form against it over many out-of-order files.
"""

from __future__ import annotations

from kanon.plans.catalog import query
from kanon.sources.tables import read_table
from kanon.streaming import jobs as J


@query("daily_rollup", """
select cast(ts as date) as day, count(*) as numbers, count(*) filter (where value >= 10) as imported,
       count(*) filter (where event_type = 'error') as failed
from events group by 1""")
def q_daily_rollup(spark, sf):
    """Daily windows."""
    return J.daily_rollup(read_table(spark, sf, "events"))


@query("sliding_rate", """
select make_timestamp(s * 1000000) as window_start, make_timestamp((s + 180) * 1000000) as window_end, event_type,
       count(*) as n
from (select event_type, unnest([b, b - 60, b - 120]) as s
      from (select event_type, (epoch_us(ts) // 60000000) * 60 as b from events))
group by 1, 2, 3""")
def q_sliding_rate(spark, sf):
    """180 s windows sliding by 60 s per event type."""
    return J.sliding_rate(read_table(spark, sf, "events"))
