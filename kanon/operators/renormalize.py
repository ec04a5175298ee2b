"""Re-normalisation of stored company rows (H15): with the write-time normalisers H1–H12, or with the batch rules.

One projection over the table (no shuffle); the phone array is computed once
per row and split into its four derived columns. The batch rules differ on purpose: an e-mail only loses its
blanks, a website without a dot stays, names are capitalised per run of letters and digits, street prefixes are
lower-cased and ``ul.`` / ``ulica`` dropped, unknown countries and postal codes stay as they are. The batch job ran twice: its
first form (:data:`FIRST_RULES`) kept the street prefix and the name of the country and wrote every Polish number
alike, its second (:data:`BATCH_RULES`) spaces landline numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanon.functions import contact as C
from kanon.functions import text as T

# column -> normaliser, for the columns a company table may carry
RULES = {
    "nip": T.digits, "regon": T.digits, "owner_nip": T.digits, "owner_regon": T.digits,
    "krs_number": lambda c: T.digits(c, 10),
    "name": T.clean_text, "status": T.status,
    "voivodeship": T.voivodeship, "county": T.place_name, "municipality": T.place_name, "city": T.place_name,
    "owner_first_name": T.person_name, "owner_last_name": T.person_name,
    "legal_form": T.legal_form, "main_pkd_code": T.activity_code, "country": T.country_code,
    "street": T.street, "postal_code": T.postal_code, "building": T.clean_text, "unit": T.clean_text,
    "email": C.email_list, "website": C.website_list,
}


def renormalize(df: DataFrame) -> DataFrame:
    """Apply every rule whose column is present; ``phone`` is re-derived with its mobile / landline / JSON forms."""
    out = df.select(*[RULES[c](F.col(c)).alias(c) if c in RULES else F.col(c) for c in df.columns])
    if "phone" in df.columns:
        out = C.with_phone_columns(out, F.col("phone"))
    return out


# Street prefixes that the batch rules lower-case, linking words of legal forms, names of the country.
STREET_PREFIXES = ("Ul", "Al", "Pl", "Bulw", "Os")
LEGAL_FORM_LINKS = ("Z", "W", "I")
COUNTRY_NAMES = ("PL", "POLSKA", "RP", "RZECZPOSPOLITA POLSKA")


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def capitalised(c: Column) -> Column:
    """Every run of letters and digits starts upper-case and goes on lower-case."""
    runs = F.regexp_extract_all(F.lower(_trimmed(c)), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))), F.substr(r, F.lit(2)))), "")


def batch_website(c: Column) -> Column:
    site = F.lower(F.regexp_replace(_trimmed(c), "/+$", ""))
    return F.when(_trimmed(c) == "", None).when(F.lower(_trimmed(c)).rlike("^https?://"), site).when(
        F.contains(c, F.lit(".")), F.concat(F.lit("https://"), site)).otherwise(F.lower(_trimmed(c)))


def batch_street(c: Column) -> Column:
    return _blank(F.trim(F.regexp_replace(F.coalesce(first_street(c), F.lit("")), r"(?i)^(ul\.|ulica)\s*", "")))


def batch_legal_form(c: Column) -> Column:
    out = capitalised(c)
    for w in LEGAL_FORM_LINKS:
        out = F.replace(out, F.lit(f" {w} "), F.lit(f" {w.lower()} "))
    return _blank(out)


def batch_country(c: Column) -> Column:
    up = F.upper(_trimmed(c))
    return F.when(up.isin(*COUNTRY_NAMES), "PL").otherwise(_blank(up))


def batch_postal_code(c: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]+", "")
    return F.when(F.length(d) == 5, F.concat(F.substr(d, F.lit(1), F.lit(2)), F.lit("-"), F.substr(d, F.lit(3)))).otherwise(_blank(_trimmed(c)))


def batch_voivodeship(c: Column) -> Column:
    """The official spelling of a voivodeship written in capitals, with or without Polish letters; others are capitalised."""
    plain = str.maketrans("ĄĆĘŁŃÓŚŹŻ", "ACELNOSZZ")
    spellings = {key: name for name in T.VOIVODESHIPS.values() for key in (name.upper(), name.upper().translate(plain))}
    lookup = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.coalesce(F.element_at(lookup, F.upper(_trimmed(c))), _blank(capitalised(c)))


def first_street(c: Column) -> Column:
    """Prefixes are lower-cased and stay."""
    out = capitalised(c)
    for p in STREET_PREFIXES:
        out = F.regexp_replace(out, rf"^{p}\.", f"{p.lower()}.")
    return _blank(out)


_DIGITS = lambda c: _blank(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", ""))
_NAME = lambda c: _blank(capitalised(c))

BATCH_RULES = {
    "nip": _DIGITS, "regon": _DIGITS, "owner_nip": _DIGITS, "owner_regon": _DIGITS,
    "krs_number": lambda c: F.when(_DIGITS(c).isNotNull(), F.lpad(_DIGITS(c), 10, "0")),
    "status": lambda c: _blank(F.upper(_trimmed(c))),
    "email": lambda c: _blank(F.lower(F.regexp_replace(_trimmed(c), r"\s+", ""))), "website": batch_website,
    "owner_first_name": _NAME, "owner_last_name": _NAME, "county": _NAME, "municipality": _NAME, "city": _NAME,
    "voivodeship": batch_voivodeship, "phone": C.batch_phones, "legal_form": batch_legal_form, "country": batch_country, "street": batch_street, "postal_code": batch_postal_code,
    "main_pkd_code": lambda c: _blank(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z]+", ""))),
}


FIRST_RULES = BATCH_RULES | {
    "street": first_street, "country": lambda c: _blank(F.upper(_trimmed(c))), "phone": lambda c: C.batch_phones(c, C.format_plain),
}


def renormalize_batch(df: DataFrame, rules: dict = BATCH_RULES) -> DataFrame:
    """H15 as the stored-row jobs do it: every batch rule whose column is present."""
    return df.select(*[rules[c](F.col(c)).alias(c) if c in rules else F.col(c) for c in df.columns])


def split_ordinal(df: DataFrame, key: str, list_col: str, out: str = "item") -> DataFrame:
    """``regexp_split_to_table(list, '\\s*,\\s*') with ordinality`` (1-based ordinal)."""
    return df.select(key, F.posexplode(F.split(F.col(list_col), r"\s*,\s*")).alias("_pos", out)).select(
        key, (F.col("_pos") + 1).alias("ordinal"), out)
