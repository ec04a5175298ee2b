"""DuckDB (RE2) SQL twins of the normalisers in ``kanon.functions`` — used only as oracles."""

from __future__ import annotations

from kanon.functions.contact import MOBILE_PREFIXES
from kanon.functions.text import POLAND_ALIASES, SMALL_LEGAL_WORDS, SOURCE_STATUS, VOIVODESHIPS, fold_table

WS = r"[\s\x{0B}\x{85}\p{Z}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


def clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{WS}', ' ', 'g')), '')"


def fold(x: str, l_stroke: bool = False) -> str:
    src, dst = fold_table(l_stroke)
    return f"regexp_replace(translate({x}, {q(src)}, {q(dst)}), '\\p{{Mn}}+', '', 'g')"


def title(x: str) -> str:
    low = f"lower({clean(x)})"
    words = f"regexp_extract_all({low}, '(\\p{{L}}[\\p{{L}}\\p{{M}}\\p{{N}}'']*|[^\\p{{L}}]+)', 1)"
    titled = (f"array_to_string(list_transform({words}, lambda t: case when regexp_matches(t, '^\\p{{L}}') "
              f"and substring(t, 1, 1) <> 'ß' then upper(substring(t, 1, 1)) || substring(t, 2) else t end), '')")
    toks = f"regexp_extract_all({titled}, '([\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]+|[^\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]+)', 1)"
    return (f"array_to_string(list_transform({toks}, lambda t: case when regexp_matches(t, '^(?i)[IVXLCDM]{{2,}}$') "
            f"then upper(t) else t end), '')")


def street(x: str) -> str:
    return f"nullif(trim(regexp_replace({title(x)}, '(?i)^(ul\\.|ulica\\s+)', '')), '')"


def country(x: str) -> str:
    key = f"upper({fold(clean(x))})"
    return f"(case when {key} in {inlist(POLAND_ALIASES)} then 'PL' else {key} end)"


def voivodeship(x: str) -> str:
    key = f"upper({fold(clean(x))})"
    cases = " ".join(f"when {q(k)} then {q(v)}" for k, v in VOIVODESHIPS.items())
    return f"coalesce(case {key} {cases} end, {title(x)})"


def digits(x: str, pad: int | None = None) -> str:
    d = f"nullif(regexp_replace({clean(x)}, '[^\\p{{Nd}}]', '', 'g'), '')"
    if pad is None:
        return d
    return f"(case when length({d}) < {pad} then lpad({d}, {pad}, '0') else {d} end)"


def activity_code(x: str) -> str:
    return f"nullif(upper(regexp_replace({clean(x)}, '[^0-9A-Za-z]', '', 'g')), '')"


def postal(x: str) -> str:
    d = digits(x)
    return f"(case when length({d}) = 5 then substring({d}, 1, 2) || '-' || substring({d}, 3) else {clean(x)} end)"


def legal_form(x: str) -> str:
    toks = f"regexp_extract_all({title(x)}, '([\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]+|[^\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]+)', 1)"
    return (f"array_to_string(list_transform({toks}, lambda t: case when t in {inlist(SMALL_LEGAL_WORDS)} "
            f"then lower(t) else t end), '')")


def source_status(x: str) -> str:
    s = f"upper({clean(x)})"
    cases = " ".join(f"when {q(k)} then {q(v)}" for k, v in SOURCE_STATUS.items())
    return f"(case {s} {cases} end)"


def email_list_raw(x: str) -> str:
    """Un-deduplicated list; dedupe with :func:`ordered_distinct` in an outer query."""
    found = f"regexp_extract_all({clean(x)}, '(?i)([A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{{2,}})', 1)"
    return f"list_transform({found}, lambda e: lower(regexp_replace(trim(e), '\\.+$', '')))"


def website_list_raw(x: str) -> str:
    parts = f"regexp_split_to_array({clean(x)}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}},;|]+')"
    one = ("(case when length(regexp_replace(trim(w), '[./\\\\]+$', '')) > 0 "
           "and contains(regexp_replace(trim(w), '[./\\\\]+$', ''), '.') then "
           "lower(case when lower(regexp_replace(trim(w), '[./\\\\]+$', '')) like 'http://%' "
           "or lower(regexp_replace(trim(w), '[./\\\\]+$', '')) like 'https://%' "
           "then replace(regexp_replace(trim(w), '[./\\\\]+$', ''), ' ', '') "
           "else 'https://' || replace(regexp_replace(trim(w), '[./\\\\]+$', ''), ' ', '') end) end)")
    return f"list_filter(list_transform({parts}, lambda w: {one}), lambda y: y is not null)"


def _fmt(d: str) -> str:
    return (f"(case when substring({d}, 1, 2) in {inlist(MOBILE_PREFIXES)} then '+48' || {d} "
            f"else '+48 ' || substring({d}, 1, 2) || ' ' || substring({d}, 3, 3) || ' ' || substring({d}, 6, 2) "
            f"|| ' ' || substring({d}, 8, 2) end)")


def phone_list_raw(x: str) -> str:
    segs = f"string_split_regex({clean(x)}, '[,;|/]+')"
    raw = f"list_transform({segs}, lambda s: regexp_replace(s, '[^\\p{{Nd}}]', '', 'g'))"
    ds = f"list_transform({raw}, lambda r: case when starts_with(r, '00') then substring(r, 3) else r end)"
    per = (f"list_transform({ds}, lambda d: case "
           f"when length(d) = 9 then [{_fmt('d')}] "
           f"when length(d) = 11 and starts_with(d, '48') then [{_fmt('substring(d, 3)')}] "
           f"when length(d) > 11 and starts_with(d, '48') and (length(d) - 2) % 9 = 0 then "
           f"list_transform(range(0, (length(d) - 2) // 9), lambda i: {_fmt('substring(d, 3 + i * 9, 9)')}) "
           f"when length(d) > 9 and length(d) % 9 = 0 then "
           f"list_transform(range(0, length(d) // 9), lambda i: {_fmt('substring(d, 1 + i * 9, 9)')}) "
           f"when length(d) > 9 then ['+' || d] else []::varchar[] end)")
    return f"flatten({per})"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def join_or_null(lst: str, sep: str = ", ") -> str:
    return f"(case when len({lst}) > 0 then array_to_string({lst}, {q(sep)}) end)"


def is_mobile(p: str) -> str:
    return f"(length({p}) = 12 and starts_with({p}, '+48') and substring({p}, 4, 2) in {inlist(MOBILE_PREFIXES)})"


def phone_json(lst: str) -> str:
    item = (f"{{'number': p, 'type': case when {is_mobile('p')} then 'mobile' when starts_with(p, '+48 ') "
            f"then 'landline' else 'unknown' end, 'countryCode': case when starts_with(p, '+48') then 'PL' end}}")
    return f"(case when len({lst}) > 0 then cast(to_json(list_transform({lst}, lambda p: {item})) as varchar) end)"
