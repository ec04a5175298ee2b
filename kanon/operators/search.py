"""Company search: dynamic filters (F2–F11), projection catalog, ordering and paging.

All predicates are plain Column expressions combined with ``&``, so Catalyst
pushes what it can (``>=``/``<=`` on dates, ``IS NOT NULL``) into the parquet
scan and prunes every column not referenced by the filter or the projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanon.functions.common import clamp, present
from kanon.operators.identity import search_order


def _blank(v) -> bool:
    return v is None or (isinstance(v, str) and v.strip() == "")


def eq_ci(column: str, value: str | None) -> Column | None:
    """``upper(col) = upper(trim(value))``; blank value = no filter."""
    if _blank(value):
        return None
    return F.upper(F.col(column)) == F.upper(F.lit(value.strip()))


#: Collations: equal whatever the case and accents are (Ł is L); equal whatever the case is.
PLACE_COLLATION, TEXT_COLLATION = "UNICODE_CI_AI", "UTF8_LCASE"


def place_key(column: str | Column, collation: str = PLACE_COLLATION) -> Column:
    """the column under a collation, as a key to filter, join or group by. The stored text is compared as it is; nothing is
    folded row by row."""
    return F.collate(F.col(column) if isinstance(column, str) else column, collation)


def eq_place(column: str, value: str | None, collation: str = PLACE_COLLATION) -> Column | None:
    """the text equals the value under a collation; blank value = no filter."""
    if _blank(value):
        return None
    return place_key(column, collation) == F.lit(value.strip())


def contains_ci(column: str, value: str | None) -> Column | None:
    """``col ILIKE '%value%'`` — ``%``/``_`` typed by the user stay wildcards."""
    if _blank(value):
        return None
    return F.col(column).ilike("%" + value.strip() + "%")


def prefix_ci(column: str, value: str | None) -> Column | None:
    """prefix match; trailing ``%`` is stripped first."""
    if _blank(value):
        return None
    return F.col(column).ilike(value.strip().rstrip("%") + "%")


def has_source(value: str | None, column: str = "registry_sources") -> Column | None:
    """``upper(value) = any(registry_sources)``."""
    if _blank(value):
        return None
    return F.array_contains(F.col(column), value.strip().upper())


def presence(column: str, flag: bool | None) -> Column | None:
    """tri-state presence; blank counts as absent."""
    if flag is None:
        return None
    return present(column) if flag else ~present(column)


def between_dates(column: str, date_from: str | None = None, date_to: str | None = None) -> Column | None:
    """F8: inclusive date range (pushed down to parquet)."""
    preds = []
    if date_from is not None:
        preds.append(F.col(column) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        preds.append(F.col(column) <= F.lit(date_to).cast("date"))
    return reduce(lambda a, b: a & b, preds) if preds else None


def conjunction(preds) -> Column:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def source_profile(krs: str = "krs_number", ceidg: str = "ceidg_id") -> Column:
    """A2a source profile: CEIDG+KRS / KRS / CEIDG."""
    return (
        F.when(present(krs) & present(ceidg), "CEIDG+KRS")
        .when(present(krs), "KRS")
        .otherwise("CEIDG")
    )


def with_registry_sources(df: DataFrame) -> DataFrame:
    """Registry source array derived from the source profile (``CEIDG+KRS`` -> [CEIDG, KRS])."""
    if "registry_sources" in df.columns:
        return df
    return df.withColumn("registry_sources", F.split(source_profile(), r"\+"))


def search_filter(
    *,
    nip=None, regon=None, name=None, country=None, voivodeship=None, county=None, municipality=None,
    city=None, status=None, main_pkd_code=None, legal_form=None, registry_source=None, krs_number=None,
    has_krs=None, has_phone=None, has_email=None, has_website=None,
) -> Column:
    """search predicate set (county / municipality / city / name are *contains*)."""
    return conjunction([
        eq_ci("nip", nip), eq_ci("regon", regon), contains_ci("name", name),
        eq_ci("country", country), eq_ci("voivodeship", voivodeship),
        contains_ci("county", county), contains_ci("municipality", municipality), contains_ci("city", city),
        eq_ci("status", status), eq_ci("main_pkd_code", main_pkd_code), eq_ci("legal_form", legal_form),
        has_source(registry_source), eq_ci("krs_number", krs_number),
        presence("krs_number", has_krs), presence("phone", has_phone),
        presence("email", has_email), presence("website", has_website),
    ])


def analytics_filter(
    *,
    voivodeship=None, county=None, municipality=None, city=None, status=None, main_pkd_code=None,
    pkd_prefix=None, registry_source=None, legal_form=None, has_krs=None, has_email=None,
    has_phone=None, has_website=None, started_from=None, started_to=None,
) -> Column:
    """analytics predicate set (county / municipality *exact*, city contains, prefix, date range)."""
    return conjunction([
        eq_ci("voivodeship", voivodeship), eq_ci("county", county), eq_ci("municipality", municipality),
        contains_ci("city", city), eq_ci("status", status), eq_ci("main_pkd_code", main_pkd_code),
        has_source(registry_source), eq_ci("legal_form", legal_form), presence("krs_number", has_krs),
        prefix_ci("main_pkd_code", pkd_prefix), presence("email", has_email), presence("phone", has_phone),
        presence("website", has_website), between_dates("started_on", started_from, started_to),
    ])


# --- Column catalog (F11) ------------------------------------------------------------------
# API name -> (stored column, cast to text?). The 60 selectable names.
CATALOG: dict[str, tuple[str, bool]] = {
    "ceidgId": ("ceidg_id", False), "nip": ("nip", False), "regon": ("regon", False), "name": ("name", False),
    "status": ("status", False), "statusNumber": ("status_number", False), "isCurrent": ("is_current", False),
    "currentRank": ("current_rank", False), "legalForm": ("legal_form", False),
    "registeredOn": ("registered_on", False), "startedOn": ("started_on", False),
    "suspendedOn": ("suspended_on", False), "endedOn": ("ended_on", False), "removedOn": ("removed_on", False),
    "resumedOn": ("resumed_on", False), "ownerFirstName": ("owner_first_name", False),
    "ownerLastName": ("owner_last_name", False), "ownerNip": ("owner_nip", False),
    "ownerRegon": ("owner_regon", False), "country": ("country", False), "city": ("city", False),
    "voivodeship": ("voivodeship", False), "county": ("county", False), "municipality": ("municipality", False),
    "street": ("street", False), "building": ("building", False), "unit": ("unit", False),
    "postalCode": ("postal_code", False), "terc": ("terc", False), "simc": ("simc", False), "ulic": ("ulic", False),
    "mainPkdCode": ("main_pkd_code", False), "registrySources": ("registry_sources", True),
    "krsNumber": ("krs_number", False), "krsRegisterType": ("krs_register_type", False),
    "krsCourtName": ("krs_court_name", False), "krsLastEntryDate": ("krs_last_entry_date", False),
    "krsUpdatedAtUtc": ("krs_updated_at", False), "krsRepresentatives": ("krs_representatives", True),
    "phone": ("phone", False), "phoneMobile": ("phone_mobile", False), "phoneLandline": ("phone_landline", False),
    "phonesJson": ("phones_json", True), "email": ("email", False), "website": ("website", False),
    "electronicDeliveryAddress": ("electronic_delivery_address", False),
    "otherContactForm": ("other_contact_form", False), "pkdCodes": ("pkd_codes", True),
    "citizenships": ("citizenships", True), "correspondenceAddress": ("correspondence_address", True),
    "additionalBusinessAddresses": ("additional_business_addresses", True),
    "permissions": ("permissions", True), "restrictions": ("restrictions", True),
    "sourceIndexUrl": ("source_index_url", False), "sourceDetailUrl": ("source_detail_url", False),
    "firstSeenAtUtc": ("first_seen_at", False), "updatedAtUtc": ("updated_at", False),
    "rawIndexPayload": ("raw_index_payload", True), "rawDetailPayload": ("raw_detail_payload", True),
    "rawKrsPayload": ("raw_krs_payload", True),
}
DEFAULT_COLUMNS = ("ceidgId", "nip", "regon", "name", "status", "legalForm", "country", "city", "mainPkdCode",
                   "registrySources")
_BY_LOWER = {k.lower(): k for k in CATALOG}


class NoValidColumns(ValueError):
    pass


def resolve_columns(spec: str | None) -> list[str]:
    """comma list → known API names (trimmed, unknown dropped, case-insensitive distinct)."""
    names = DEFAULT_COLUMNS if spec is None or spec.strip() == "" else [s.strip() for s in spec.split(",")]
    out: list[str] = []
    for n in names:
        canon = _BY_LOWER.get(n.lower()) if n else None
        if canon is not None and canon not in out:
            out.append(canon)
    if not out:
        raise NoValidColumns("no valid columns requested")
    return out


def text_cast(c: Column, dtype) -> Column:
    """JSON/array columns as text: arrays like ``{a,b}``, everything else as-is."""
    from pyspark.sql.types import ArrayType

    if isinstance(dtype, ArrayType):
        return F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}"))
    return c.cast("string")


def with_catalog(df: DataFrame) -> DataFrame:
    """``df`` with every stored column of the catalog; those it lacks are NULL text."""
    absent = dict.fromkeys(c for c, _ in CATALOG.values() if c not in df.columns)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])


def project(df: DataFrame, spec: str | None) -> DataFrame:
    """Select the resolved catalog columns under their API names; Catalyst prunes the rest."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for api in resolve_columns(spec):
        stored, as_text = CATALOG[api]
        c = F.col(stored)
        cols.append((text_cast(c, types[stored]) if as_text else c).alias(api))
    return df.select(*cols)


def page(df: DataFrame, page_no: int | None = 1, size: int | None = 25, order: list[Column] | None = None) -> DataFrame:
    """L2: ``order by ... offset (page-1)*size limit size``; page<=0 → 1, size<=0 → 25, max 100."""
    page_no = 1 if page_no is None or page_no <= 0 else page_no
    size = clamp(size, 25, 1, 100)
    ordered = df.orderBy(*(order or search_order(df)))
    return ordered.offset((page_no - 1) * size).limit(size) if page_no > 1 else ordered.limit(size)


def total_rows(df: DataFrame) -> DataFrame:
    """Row count of the filtered set (filter-only plan, no projected columns read)."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))
