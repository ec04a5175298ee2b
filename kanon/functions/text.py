"""Text normalisers (H1–H5, H10–H12) as ``Column -> Column`` expressions.

No Python UDFs: everything is regexp / translate / higher-order array
functions, so it runs inside whole-stage codegen (or the JVM interpreter for
lambdas) with no Python worker round trip.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kanon.functions.common import col

# ------------------------------------------------------------------ H1 clean text
WS_RUN = r"(?U)\s+"


def clean_text(c) -> Column:
    """H1: blank → NULL, whitespace runs → one space, trimmed."""
    return F.nullif(F.trim(F.regexp_replace(col(c), WS_RUN, " ")), F.lit(""))


# ------------------------------------------------------------------ H11 accent folding
@lru_cache(maxsize=None)
def fold_table(fold_l_stroke: bool = False) -> tuple[str, str]:
    """(from, to) strings for ``translate``: every BMP letter whose canonical decomposition is one
    base character plus non-spacing marks maps to that base character. Built from the Unicode
    data rule, not typed by hand. ``ł``/``Ł`` have no decomposition; the second variant folds them too."""
    src, dst = [], []
    for cp in range(0x00C0, 0x3000):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if d == ch:
            continue
        base = "".join(x for x in d if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    if fold_l_stroke:
        src += ["ł", "Ł"]
        dst += ["l", "L"]
    return "".join(src), "".join(dst)


def fold_accents(c, fold_l_stroke: bool = False) -> Column:
    """Remove diacritics (precomposed via translate, stray combining marks via regex)."""
    src, dst = fold_table(fold_l_stroke)
    return F.regexp_replace(F.translate(col(c), src, dst), r"\p{Mn}+", "")


# ------------------------------------------------------------------ H2 Polish title case
# A word starts at a letter and runs through letters, marks, numbers and apostrophes;
# every other character separates words (the culture title-casing rule).
# Regex word boundaries: word characters are letters, non-spacing marks, digits, connectors.
_W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
# a whole word (maximal run of word characters) made only of roman-numeral letters; what stands before it is looked at
# after its first letter, so that other characters are passed over at the cost of one class test
ROMAN_WORD = rf"(?i)([IVXLCDM](?<!{_W}[IVXLCDM])[IVXLCDM]+)(?!{_W})"
_OPEN, _CLOSE = "\ue002", "\ue003"


# Private-use characters used as in-flight markers (never present in registry text).
_WORD_MARK = "\ue000"
_SHARP_S_PARKED = "\ue001"
# the first letter of each run of letters / marks / digits / apostrophes
# (the parked ``ß`` counts as a letter)
TITLE_START = "(^|[^\\p{L}\\p{M}\\p{N}'" + _SHARP_S_PARKED + "])([\\p{M}\\p{N}']*+)([\\p{L}" + _SHARP_S_PARKED + "])"


def _each_match(c: Column, pattern: str, change) -> Column:
    """``change`` applied to group 1 of every match: matches are bracketed, the text is split on the opening
    bracket (usually one part), and the bracketed prefix of each later part is changed."""
    parts = F.split(F.regexp_replace(c, pattern, _OPEN + "$1" + _CLOSE), _OPEN)
    fixed = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(
        change(F.substring_index(p, _CLOSE, 1)), F.substr(p, F.instr(p, _CLOSE) + 1))))
    return F.array_join(fixed, "")


def title_case(c) -> Column:
    """H2: lower, capitalise every word (also after hyphens / digits), then whole words made only of
    ``IVXLCDM`` (2+ letters) upper-cased. ``initcap`` alone differs (``Jastrzębie-zdrój``, ``Ii``).

    The word pass runs natively: a marker + space is put before the first letter of every run,
    ``initcap`` (which capitalises after spaces) does the casing, the markers are removed. ``ß`` is
    parked on a private-use character meanwhile, because ``initcap`` would turn it into ``Ss``."""
    low = F.translate(F.lower(clean_text(c)), "ß", _SHARP_S_PARKED)
    marked = F.regexp_replace(low, TITLE_START, "$1$2" + _WORD_MARK + " $3")
    titled = F.translate(F.regexp_replace(F.initcap(marked), _WORD_MARK + " ", ""), _SHARP_S_PARKED, "ß")
    return _each_match(titled, ROMAN_WORD, F.upper)


person_name = title_case
place_name = title_case


# ------------------------------------------------------------------ H3 street
STREET_PREFIX = r"(?i)^(ul\.|ulica\s+)"


def street(c) -> Column:
    """H3: title case, then drop a leading ``ul.`` / ``ulica``."""
    return F.nullif(F.trim(F.regexp_replace(title_case(c), STREET_PREFIX, "")), F.lit(""))


# ------------------------------------------------------------------ H4 country
# Names that mean Poland.
POLAND_ALIASES = ("PL", "POLSKA", "RP", "RZECZPOSPOLITA POLSKA")


def country_code(c) -> Column:
    """H4: folded upper text; Polish aliases → ``PL``; anything else returned as folded upper text."""
    key = F.upper(fold_accents(clean_text(c)))
    return F.when(key.isin(*POLAND_ALIASES), F.lit("PL")).otherwise(key)


# ------------------------------------------------------------------ H5 voivodeship
# Folded upper-case key -> canonical voivodeship name.
VOIVODESHIPS = {
    "DOLNOSLASKIE": "Dolnośląskie",
    "KUJAWSKO-POMORSKIE": "Kujawsko-Pomorskie",
    "LUBELSKIE": "Lubelskie",
    "LUBUSKIE": "Lubuskie",
    "LODZKIE": "Łódzkie",
    "MALOPOLSKIE": "Małopolskie",
    "MAZOWIECKIE": "Mazowieckie",
    "OPOLSKIE": "Opolskie",
    "PODKARPACKIE": "Podkarpackie",
    "PODLASKIE": "Podlaskie",
    "POMORSKIE": "Pomorskie",
    "SLASKIE": "Śląskie",
    "SWIETOKRZYSKIE": "Świętokrzyskie",
    "WARMINSKO-MAZURSKIE": "Warmińsko-Mazurskie",
    "WIELKOPOLSKIE": "Wielkopolskie",
    "ZACHODNIOPOMORSKIE": "Zachodniopomorskie",
}


def voivodeship(c) -> Column:
    """H5: lookup on the folded key (``ł`` kept, so ``ŁÓDZKIE`` falls through to title case)."""
    cleaned = clean_text(c)
    key = F.upper(fold_accents(cleaned))
    lookup = F.create_map(*[F.lit(x) for kv in VOIVODESHIPS.items() for x in kv])
    return F.coalesce(F.element_at(lookup, key), title_case(cleaned))


# ------------------------------------------------------------------ H10 codes / status / legal form
def activity_code(c) -> Column:
    """Alphanumerics only, upper; empty → NULL (``62.01.Z`` → ``6201Z``)."""
    return F.nullif(F.upper(F.regexp_replace(clean_text(c), "[^0-9A-Za-z]+", "")), F.lit(""))


def digits(c, pad: int | None = None) -> Column:
    """H9: digits only (Unicode decimal digits), NULL when none; left-pad to ``pad`` but never truncate."""
    d = F.nullif(F.regexp_replace(clean_text(c), r"(?U)\D+", ""), F.lit(""))
    if pad is None:
        return d
    return F.when(F.length(d) < pad, F.lpad(d, pad, "0")).otherwise(d)


def postal_code(c) -> Column:
    """Exactly 5 digits → ``##-###``; otherwise the cleaned text."""
    d = digits(c)
    return F.when(F.length(d) == 5, F.overlay(d, F.lit("-"), 3, 0)).otherwise(clean_text(c))


def status(c) -> Column:
    """Cleaned, upper-cased."""
    return F.upper(clean_text(c))


# Connective words written lower-case inside legal form names.
SMALL_LEGAL_WORDS = ("Z", "W", "I", "Oraz", "O", "Na", "Pod", "Przy")


def legal_form(c) -> Column:
    """Title case, then the small connective words lower-cased as whole words."""
    return _each_match(title_case(c), rf"(?<!{_W})({'|'.join(SMALL_LEGAL_WORDS)})(?!{_W})", F.lower)


# ------------------------------------------------------------------ H12 source status
# Source status code / spelling -> canonical status.
SOURCE_STATUS = {"1": "AKTYWNY", "2": "WYKRESLONY", "AKTYWNY": "AKTYWNY", "WYKRESLONY": "WYKRESLONY",
                 "WYKREŚLONY": "WYKRESLONY"}


def source_status(c) -> Column:
    """Registry status code → canonical status, else NULL."""
    s = status(c)
    lookup = F.create_map(*[F.lit(x) for kv in SOURCE_STATUS.items() for x in kv])
    return F.element_at(lookup, s)


# ------------------------------------------------------------------ H13
def content_hash(c) -> Column:
    """Lower-hex SHA-256 of the UTF-8 text."""
    return F.sha2(col(c), 256)
