"""Shared SQL fragments for the DuckDB oracles (ANSI / DuckDB dialect)."""

from __future__ import annotations

from kanon.sources.bindings import with_bindings


def present_sql(c: str) -> str:
    return f"nullif(trim(coalesce({c}, '')), '') is not null"


def pct_sql(part: str, total: str) -> str:
    """Half-even ``100 * part / total`` to 2 dp in exact integer arithmetic, as DOUBLE; 0 when total <= 0."""
    q = f"(({part}) * 10000 // ({total}))"
    r = f"(({part}) * 10000 % ({total}))"
    return (
        f"(case when ({total}) <= 0 then 0.0 else cast({q} + case when 2 * {r} > ({total}) then 1 "
        f"when 2 * {r} = ({total}) and {q} % 2 = 1 then 1 else 0 end as double) / 100 end)"
    )


# Identity prefixes in order of preference, status ranks (any other status ranks 4).
IDENTITY_PREFIXES = (("nip", "nip"), ("krs", "krs_number"), ("regon", "regon"), ("ceidg", "upper(ceidg_id)"))
STATUS_RANKS = {"AKTYWNY": 1, "ACTIVE": 1, "ZAWIESZONY": 2, "WYKRESLONY": 3}

# A prefix joined to NULL is NULL, so the first identifier that is there wins.
IDENTITY_SQL = ("coalesce(" + ", ".join(f"'{p}:' || nullif(trim({c}), '')" for p, c in IDENTITY_PREFIXES)
                + ", 'id:' || cast(id as varchar))")

RANK_SQL = ("coalesce(list_extract([" + ", ".join(map(str, STATUS_RANKS.values())) + "], nullif(list_position(["
            + ", ".join(f"'{s}'" for s in STATUS_RANKS) + "], upper(status)), 0)), 4)")

EVENT_DATE_SQL = "coalesce(removed_on, started_on, cast(updated_at as date), date '0001-01-01')"

# The current row of an identity is the one whose order tuple is the least of the identity: rank, newest event,
# unknown before newest update, id.
_ORDER_TUPLE_SQL = (f"{{'r': {RANK_SQL}, 'd': date '9999-12-31' - {EVENT_DATE_SQL}, 'known': updated_at is not null, "
                    "'u': coalesce(-epoch_us(updated_at), 0), 'id': id}")

FLAGGED_SQL = f"""
select k.* exclude (order_tuple), order_tuple = min(order_tuple) over (partition by identity_key) as is_current
from (select h.*, {IDENTITY_SQL} as identity_key, {RANK_SQL} as current_rank, {_ORDER_TUPLE_SQL} as order_tuple
      from company_history h) k"""

SOURCE_PROFILE_SQL = f"""case when {present_sql('krs_number')} and {present_sql('ceidg_id')} then 'CEIDG+KRS'
    when {present_sql('krs_number')} then 'KRS' else 'CEIDG' end"""


def with_flagged(sql: str, extra: dict[str, str] | None = None) -> str:
    """``company_history`` + ``flagged`` (W1 over it) + ``current`` CTEs, then ``sql``."""
    ctes = {"flagged": FLAGGED_SQL, "current_rows": "select * from flagged where is_current"}
    ctes.update(extra or {})
    return with_bindings(sql, "company_history", extra=ctes)
