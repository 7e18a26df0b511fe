import pytest
from pyspark.sql import functions as F

from pricewright.functions import similarity as s
from pricewright.functions import text as t
from pricewright.plans import understand as u


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw", ["Nike Men's Café & Bar (X)", "", "ÀÉÎ õü ½", "a/b - c.d", "  many   blanks ", "ﬁne"])
def test_squash_agrees_with_its_plain_form(spark, raw):
    assert one(spark, t.squash(F.lit(raw))) == u.squash(raw)


def test_null_is_empty(spark):
    null = F.lit(None).cast("string")
    assert one(spark, t.squash(null)) == "" and one(spark, t.slug(null)) == "" and one(spark, t.brand_of(null)) == ""
    assert one(spark, t.price(null))["amount"] is None


@pytest.mark.parametrize("raw,want", [("$129.99", (129.99, "USD")), ("USD 1,299.00", (1299.0, "USD")), ("£99.95", (99.95, "GBP")), ("84.5", (84.5, "USD")), ("", (None, "USD")), ("CA$ 12", (12.0, "CAD"))])
def test_prices(spark, raw, want):
    assert tuple(one(spark, t.price(F.lit(raw)))) == want


@pytest.mark.parametrize("raw,want", [("US M 10.5", "10.5"), ("9", "9"), ("10 1/2", "10.5"), ("9½", "9.5"), ("XL", "xl"), ("09", "9")])
def test_sizes(spark, raw, want):
    assert one(spark, t.shoe_size(F.lit(raw))) == want


@pytest.mark.parametrize(
    "title,want",
    [
        ("Nike Air Max 90 Men's Shoes (HM0089-100) - White/Black", ("nike", "air max 90", "white / black", "HM0089-100", "men")),
        ("New Balance 990v6 Grey", ("new balance", "990v6", "grey", "", "")),
        ("adidas Originals Samba OG | Cloud White/Core Black", ("adidas", "samba og", "cloud white / core black", "", "")),
        ("", ("", "", "", "", "")),
    ],
)
def test_titles(spark, title, want):
    assert tuple(one(spark, t.parse_title(F.lit(title)))) == want


def test_colourways(spark):
    assert one(spark, t.colourway(F.lit("White/White/Black"))) == "white / black"
    assert one(spark, t.colourway(F.lit("black and white"))) == "black / white"
    assert one(spark, t.colourway(F.lit("Lost and Found"))) == "lost and found"


def test_similarities(spark):
    lit = F.lit
    assert one(spark, s.model_similarity(lit("990v6"), lit("990v5"))) == 0.0
    assert one(spark, s.model_similarity(lit("990v6"), lit("990v6 made in usa"))) >= 0.9
    assert one(spark, s.trigram_similarity(lit("ultrabost"), lit("ultraboost"))) == pytest.approx(0.75)
    assert one(spark, s.genders_agree(lit(""), lit("men"))) and not one(spark, s.genders_agree(lit("women"), lit("men")))


def test_variants(spark):
    assert one(spark, t.variants(F.lit("990v6"))) == ["990", "v6"] and one(spark, t.variants(F.lit("samba"))) == []


def test_questions():
    x = u.parse("cheapest nike air max 90 in size 10.5 under $120")
    assert (x.brands, x.size, x.max_price, x.terms) == (("nike",), "10.5", 120.0, "air max 90")
    assert u.parse("used 990v6 without shipping").include_shipping is False
    assert u.parse("deals on sambas").intent == "deals"
    assert u.parse(None).terms == ""


def test_expansion_keeps_its_origin():
    found = u.expand("panda dunks")
    assert found["white"] == (0.9, {"panda"}) and found["dunk"][1] == {"panda", "dunks"} and found["panda"][0] == 1.0
    assert u.expand("cheapest shoes")["shoes"][0] == 1.0


def test_refinement_keeps_what_patterns_found():
    x = u.parse("nike size 9")
    y = u.refine(x, lambda q: '```json\n{"size": "12", "gender": "men", "brands": ["adidas"], "intent": "nonsense"}\n```')
    assert (y.size, y.gender, y.brands, y.intent) == ("9", "men", ("adidas", "nike"), "compare")
    assert u.refine(x, lambda q: "no json") == x
    assert u.refine(x, lambda q: 1 / 0) == x


def test_price_curve_runs_by_number():
    from pricewright.cli import by_size

    assert list(by_size({"10": 1.0, "9.5": 2.0, "XL": 3.0, "9": 4.0, "M": 5.0})) == ["9", "9.5", "10", "M", "XL"]
    assert by_size(None) == {}
