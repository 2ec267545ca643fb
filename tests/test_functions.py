import pytest
from pyspark.sql import functions as F

from vetrina import vocab
from vetrina.functions import text as t
from vetrina.functions import values as v


def test_normalized_text(one):
    assert one(t.normalized_text, ["Città, È  bella!", "  ", None, "ﬁne ½", "A+B/c-d.e"]) == ["citta e bella", None, None, "fine 1 2", "a+b/c-d.e"]


def test_clean_title(one):
    given = ["Giacca 10 mAh in offerta", "Power bank 10,5 - GB", "Best-Seller NOVITÀ", "Promozione promo felpa"]
    assert one(t.clean_title, given) == ["giacca 10mah", "power bank 10 5gb", None, "felpa"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("S, M, L", "s, m, l"), ("38,5", "38.5"), ("One Size", "taglia unica"), ("EU 42", "42"), ("S, M, S", "s, m"), ("TU", "taglia unica"), ("taglia unica", "taglia unica"), ("38/39", "38, 39"), ("", None), (None, None)],
)
def test_normalized_size(one, given, expected):
    assert one(t.normalized_size, [given]) == [expected]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("1.299,00 €", 1299.0), ("1,299.00", 1299.0), ("19,90", 19.9), ("1.299", 1.299), ("1,299", 1.299), ("abc", None), ("", None), ("-5", -5.0), ("1-2", None), (None, None)],
)
def test_parsed_price(one, given, expected):
    assert one(v.parsed_price, [given]) == [expected]


def test_ean_and_mpn(one):
    assert one(v.valid_ean, ["0000000000017", "12345678", "123", "00000000", "80 12-345 67", None]) == ["0000000000017", "12345678", None, None, None, None]
    assert one(v.valid_mpn, ["AB-12", "n/a", "-", "x", " A1_b/2 ", None]) == ["AB-12", None, None, None, "A1_b/2", None]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Camicia Oxford Nera - M", "Camicia Oxford"),
        ("Borsa in tessuto intrecciato e pelle", "Borsa"),
        ("Sneakers bianche uomo con", "Sneakers"),
        ("Pantaloni jean", "Pantaloni Jeans"),
        ("Felpa in cotone e", "Felpa"),
        ("Air Force 1", "Air Force 1"),
        ("Giacca, in offerta, da", "Giacca"),
        ("Rosso", "Rosso"),
        ("Scarpa in / con e .", "Scarpa"),
        ("in", "in"),
    ],
)
def test_display_title(one, given, expected):
    assert one(t.display_title, [given]) == [expected]


def test_display_title_without_brand(one):
    assert one(lambda c: t.display_title(c, F.lit("red wing (c")), ["Stivale Red Wing (C Classic"]) == ["Stivale Classic"]


def test_display_text(one):
    assert one(t.display_text, ["a\u0000b\tc", "é", " \n "]) == ["a b c", "é", None]


def test_rules_take_the_first_of_the_list(one):
    assert one(lambda c: t.first_rule(c, vocab.COLOR_RULES), ["red and black", "sneakers.", ""]) == ["nero", None, None]
    assert one(lambda c: t.canonical_value(c, vocab.COLOR_RULES), ["Bianca", "Fucsia"]) == ["bianco", "fucsia"]
    assert t.attribute_terms("blu", vocab.COLOR_RULES) == ["blu", "blue", "navy"]
    assert t.attribute_terms("fucsia", vocab.COLOR_RULES) == ["fucsia"]
    assert t.attribute_terms(None, vocab.COLOR_RULES) == []


def test_sizes_in_titles(one):
    given = ["Giacca taglia: M/L", "Scarpa - 42", "Polo XXL estate", "Guanti taglia unica", "Nike 97"]
    assert one(t.extracted_size, given) == ["m, l", "42", None, "taglia unica", None]
    assert one(t.without_size, given) == ["Giacca", "Scarpa", "Polo  estate", "Guanti", "Nike 97"]


def test_title_issues(one):
    given = ["", "Camicia con", "Camicia nera", "Camicia and", "Camicia"]
    assert one(t.title_issues, given) == [["titolo_vuoto"], ["connettivo_finale", "preposizione_finale"], ["attributo_nel_titolo"], ["connettivo_finale"], []]


def test_colors(one):
    assert one(t.visual_colors, ["White/Black", "gold-ish red", None]) == [["bianco", "nero"], ["oro", "rosso"], []]
    pair = lambda a, b: t.color_conflict(t.visual_colors(F.lit(a)), t.visual_colors(F.lit(b)))
    assert one(lambda c: F.array(pair("nero", "blue"), pair("nero", "black"), pair("multicolore", "blu"), pair("", "blu")), ["x"]) == [[True, False, False, False]]


def test_prices(spark):
    rows = spark.createDataFrame([(100.0, 80.0), (100.0, 120.0), (0.0, 50.0), (None, 10.0), (100.0, 0.0)], "r double, s double")
    price, sale = v.price_pair(F.col("r"), F.col("s"))
    assert [tuple(x) for x in rows.select(price, sale).collect()] == [(100.0, 80.0), (100.0, None), (None, None), (None, None), (100.0, None)]
    shown = rows.select(v.effective_price(F.col("r"), F.col("s")).alias("e"), v.shown_price(F.col("r"), F.col("s")).alias("p"), v.card_discount(F.col("r"), F.col("s")).alias("c")).collect()
    assert [tuple(x) for x in shown[:2]] == [(80.0, 80.0, 20), (120.0, 100.0, None)]


def test_fingerprints(spark):
    rows = spark.createDataFrame([("a", "", "b"), ("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    got = [r.h for r in rows.select(v.content_hash(F.col("x"), F.col("y"), F.col("z")).alias("h")).collect()]
    assert got[0] == got[1] == got[2]
    got = [r.h for r in rows.select(v.operational_hash(F.lit(1), F.lit(None), F.col("x"), F.col("y"), F.col("z")).alias("h")).collect()]
    assert got[0] == got[1] != got[2]


def test_availability(spark):
    rows = spark.createDataFrame([("in_stock", "0"), ("out_of_stock", "1"), ("", "yes"), ("", "Sold Out"), ("", "")], "availability string, in_stock string")
    assert [r.a for r in rows.select(v.is_available(rows.columns).alias("a")).collect()] == [True, False, True, False, False]
    assert rows.select("in_stock").select(v.is_available(["other"]).alias("a")).first().a is False


def test_dates_and_labels(one):
    assert one(v.catalog_date, ["2024-07-01 10:00:00.123456+00", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00", "x"]) == ["01/07/2024 12:00", "01/01/2024 11:00", None, None]
    assert one(lambda c: v.formatted_price(F.lit(5), c), ["eur", "chf", ""]) == ["€5.00", "5.00 CHF", "€5.00"]
    assert one(lambda c: v.size_label(F.lit("0"), c), ["Cappello blu", "Giacca"]) == ["Taglia non specificata", "Taglie 0"]
    assert one(lambda c: v.retry_seconds(c), ["retry in 12s", "retry in 1.5 s", "no"]) == [13.0, 2.5, 30.0]
    assert one(v.synthetic_id, ["a"]) == [int("ca978112ca1bbdc", 16)]
