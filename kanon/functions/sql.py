"""The normalisers as SQL functions, so they can be used in plain SQL text.

Each function is a SQL function with the normaliser's own expression as its body (``CREATE TEMPORARY FUNCTION ... RETURN``): no
Python runs, the body is inlined and optimised like any other SQL. The body is the text that Spark gives for the
Column; operators in it are written as function calls, whose names are quoted here (casts and structs have a syntax of their own).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kanon.functions import contact as C
from kanon.functions import text as T

#: SQL name -> normaliser (H1-H12) of one text.
NORMALISERS = {
    "norm_clean": T.clean_text, "norm_title": T.place_name, "norm_person": T.person_name, "norm_street": T.street, "norm_country": T.country_code,
    "norm_voivodeship": T.voivodeship, "norm_email": C.email_list, "norm_website": C.website_list, "norm_phone": C.phone_list,
    "norm_phone_mobile": lambda c: C.phone_set(c)["mobile"], "norm_phone_landline": lambda c: C.phone_set(c)["landline"], "norm_phones_json": lambda c: C.phone_set(c)["json"],
    "norm_digits": T.digits, "norm_krs_number": lambda c: T.digits(c, 10), "norm_code": T.activity_code, "norm_status": T.status, "norm_legal_form": T.legal_form,
    "norm_postal_code": T.postal_code, "fold_accents": lambda c: T.fold_accents(c, True), "content_hash": T.content_hash,
}

_PIECE = re.compile(r"'(?:[^'\\]|\\.)*'|`[^`]*`|(?P<syntax>(?:TRY_)?CAST|STRUCT)\(|(?P<name>[A-Za-z_][A-Za-z_0-9]*|[-+*/%<>=!&|^~]+)\(|->", re.S | re.I)


def sql_text(c: Column) -> str:
    """SQL text of a Column that the parser reads back as the same expression."""

    def quoted(m: re.Match) -> str:
        return f"`{m['name']}`(" if m["name"] else m[0]

    return _PIECE.sub(quoted, c._jc.node().sql())


def register(spark: SparkSession, names: dict = NORMALISERS) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, normaliser in names.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN {sql_text(normaliser(F.col('v')))}")
    return list(names)
