"""Input / output pairs for the normalisers, written from their rules."""

import random

import pytest

from conftest import one
from pyspark.sql import functions as F

from kanon.functions import contact as C
from kanon.functions import dates as DT
from kanon.functions import text as T


@pytest.mark.parametrize("raw,expected", [
    ("OPOLSKIE", "Opolskie"), ("świętokrzyskie", "Świętokrzyskie"), ("  Slaskie", "Śląskie"),
    ("zachodniopomorskie ", "Zachodniopomorskie"), ("warminsko-mazurskie", "Warmińsko-Mazurskie"),
])
def test_voivodeship(spark, raw, expected):
    assert one(spark, T.voivodeship, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("ŻANETA", "Żaneta"), ("kowal-nowak", "Kowal-Nowak"), ("BIELSKO-BIAŁA", "Bielsko-Biała"),
    ("PLAC KAROLA IV", "Plac Karola IV"), ("3rd  lane", "3Rd Lane"), ("d'arc", "D'arc"),
    ("mix civil", "MIX CIVIL"),  # quirk: whole words of roman-numeral letters are upper-cased
    ("straße", "Straße"), ("ßa", "ßa"), ("   ", None), (None, None),
])
def test_title_case(spark, raw, expected):
    assert one(spark, T.title_case, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("UL. KAROLA IV", "Karola IV"), ("ulica Topolowa", "Topolowa"), ("Bulwar Odrzański", "Bulwar Odrzański"),
    ("ul.", None),
])
def test_street(spark, raw, expected):
    assert one(spark, T.street, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("PL", "PL"), ("Polska", "PL"), ("POLSKA", "PL"), ("rzeczpospolita  polska", "PL"), ("Österreich", "OSTERREICH"),
    ("de", "DE"), ("", None),
])
def test_country(spark, raw, expected):
    assert one(spark, T.country_code, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("600 100 200", "+48600100200"),
    ("+48600100201, 730100202, 880100203", "+48600100201, +48730100202, +48880100203"),
    ("510100204 510100205", "+48510100204, +48510100205"),
    ("+48 22 1000206", "+48 22 100 02 06"),
    ("121000207", "+48 12 100 02 07"),
    ("0048600100208", "+48600100208"),
    ("48510100209510100210", "+48510100209, +48510100210"),
    ("1234567890123456789012", "+1234567890123456789012"),
    ("12 34", None), ("", None),
])
def test_phones(spark, raw, expected):
    assert one(spark, C.phone_list, raw) == expected


def test_phone_struct(spark):
    s = one(spark, C.phone_set, "+48 71 1000211, 600100212")
    assert s["all"] == "+48 71 100 02 11, +48600100212"
    assert s["mobile"] == "+48600100212" and s["landline"] == "+48 71 100 02 11"
    assert '"type":"landline"' in s["json"] and '"type":"mobile"' in s["json"]
    empty = one(spark, C.phone_set, "abc")
    assert empty["all"] is None and empty["json"] is None


def test_email_and_website(spark):
    assert one(spark, C.email_list, "Ola@Mail.TEST. , ola@mail.test; z@y.pl") == "ola@mail.test, z@y.pl"
    assert one(spark, C.email_list, "no address") is None
    assert one(spark, C.website_list, "WWW.SKLEP.TEST") == "https://www.sklep.test"
    assert one(spark, C.website_list, "http://A.pl/ www.b.pl, noDot") == "http://a.pl, https://www.b.pl"


@pytest.mark.parametrize("fn,raw,expected", [
    (T.activity_code, "47.11.Z", "4711Z"), (T.activity_code, " 4711z ", "4711Z"),
    (T.postal_code, "49300", "49-300"), (T.postal_code, "12", "12"),
    (T.legal_form, "FUNDACJA W LIKWIDACJI I ZARZĄD Z URZĘDU", "Fundacja w Likwidacji i Zarząd z Urzędu"),
    (T.source_status, "1", "AKTYWNY"), (T.source_status, "wykreślony", "WYKRESLONY"), (T.source_status, "x", None),
    (T.status, " aktywny ", "AKTYWNY"),
])
def test_codes_and_forms(spark, fn, raw, expected):
    assert one(spark, fn, raw) == expected


def test_digits_never_truncate(spark):
    assert one(spark, lambda c: T.digits(c, 10), "12-34") == "0000001234"
    assert one(spark, lambda c: T.digits(c, 10), "123456789012") == "123456789012"
    assert one(spark, T.digits, "abc") is None


def test_fold_accents_variants(spark):
    assert one(spark, T.fold_accents, "Łąka źdźbło") == "Łaka zdzbło"
    assert one(spark, lambda c: T.fold_accents(c, True), "Łąka źdźbło") == "Laka zdzblo"


def test_renormalising_is_a_noop(spark):
    """Normalised e-mails, codes and phones are fixed points."""
    for fn, v in [(C.email_list, "a@b.pl, c@d.pl"), (T.activity_code, "4711Z"), (C.phone_list, "+48 12 100 02 07")]:
        once = one(spark, fn, v)
        assert one(spark, fn, once) == once


def test_multi_format_date(spark):
    import datetime as dt

    for raw in ("03.02.2011", "2011-02-03", "03-02-2011", "20110203"):
        assert one(spark, DT.parse_date, raw) == dt.date(2011, 2, 3)
    assert one(spark, DT.parse_date, "bad") is None
    assert one(spark, DT.read_int, "6.55") is None and one(spark, DT.read_int, " 12 ") == 12
    assert one(spark, DT.read_bool, "TRUE") is True and one(spark, DT.read_bool, "0") is False


def test_title_patterns_by_definition(spark):
    """Roman words and word starts, as found by the plain form of their patterns."""
    rng = random.Random(7)
    chars = "ivxIVXLcdMm" * 3 + "ab\u0142\u00df\ue0011\u0663_'-. #\u0301\U0001d400\u2160"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    w = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
    roman = rf"(?i)(?<!{w})([IVXLCDM]{{2,}})(?!{w})"
    start = T.TITLE_START.replace("*+", "*")
    same = lambda a, b, to: F.regexp_replace("t", a, to) == F.regexp_replace("t", b, to)
    assert df.filter(~same(T.ROMAN_WORD, roman, "<$1>") | ~same(T.TITLE_START, start, "$1$2< $3")).count() == 0
    assert df.filter(F.col("t").rlike(roman)).count() > 100


def test_lists_joined_and_postal_code(spark):
    for text, email, site in [("a@b.pl, A@B.pl; c@d.pl.", "a@b.pl, c@d.pl", "https://a@b.pl, https://c@d.pl"), ("none", None, None), ("", None, None),
                              (None, None, None), ("./", None, None)]:
        assert (one(spark, C.email_list, text), one(spark, C.website_list, text)) == (email, site)
    for text, code in [("00950", "00-950"), (" 00 950 ", "00-950"), ("\u0663\u0663950", "\u0663\u0663-950"), ("0095", "0095"), ("x  1", "x 1"), (None, None)]:
        assert one(spark, T.postal_code, text) == code
