import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelwright.functions import extract, text


def each(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in rows.select("i", column(F.col("s")).alias("r")).orderBy("i").select("r").collect()]


def test_digits(spark):
    cases = {"1O0": "100", "25.OO": "25.00", "l50": "150", "I00": "100", "S0": "50", "2S.50": "25.50", "B5.00": "85.00", "Z50": "250", "G00": "600", "D.5": "0.5", "45,50": "45.50", "iLbgd": "iLbgd", "1,2,3": "1.2,3"}
    assert each(spark, cases, text.fix_digits) == list(cases.values())


def test_words(spark):
    cases = {"MADE IN 1NDIA": "MADE IN INDIA", "ENTERPR1SES": "ENTERPRISES", "pr0ducts": "PRODUCTS", "Country of Origin": "COUNTRY of ORIGIN", "Net Weight": "NET QUANTITY", "plain": "plain", "5 grarnrns": "5 grams", "Café MFR": "Café MFG."}
    assert each(spark, cases, text.fix_words) == list(cases.values())


def test_lines(spark):
    cases = {"a\r\nb\n": "a\nb", "": "", "x 1NDIA\vy": "x INDIA\ny", None: ""}
    assert each(spark, cases, text.clean_lines) == list(cases.values())


def test_units(spark):
    assert each(spark, ["q", "rnl", "kq", "KG", "ML", "Ltr"], text.fix_unit) == ["g", "ml", "kg", "kg", "ml", "ltr"]
    assert each(spark, ["gm", "gms", "kgs", "ltr", "litres", "pcs", " XYZ "], text.canonical_unit) == ["g", "g", "kg", "l", "l", "pcs", "xyz"]


def test_validators(spark):
    u = text.UNCERTAIN
    assert [tuple(r) for r in each(spark, ["lOO g", "250gm", "2 kg", "0 g", "1.50 ltr", "4 furlong", None], extract.quantity)] == [("100 g", True), (None, False), ("2 kg", True), (u, False), ("1.5 l", True), (None, False), (None, False)]
    assert [tuple(r) for r in each(spark, ["Rs. 2S.OO", "1,250.00", "1,250", "40.00.", "", "2000000"], extract.price)] == [("25.00", True, 25.0), (u, False, None), ("1.25", True, 1.25), (u, False, None), (None, False, None), (u, False, None)]
    assert each(spark, ["1,250.00"], lambda c: extract.price(c, strict=True))[0][2] == 1250.0
    assert [tuple(r) for r in each(spark, ["08/2O26", "31/02/2026", "l2/25", "7.25 in text", "Aug 2026", "13/1999", "05/06/1999"], extract.date)] == [("08/2026", True), ("31/02/2026", True), ("12/2025", True), ("07/2025", True), ("Aug 2026", True), (None, False), (None, False)]
    assert [tuple(r) for r in each(spark, ["1OO12345678901", "123456789012", "12"], extract.license_number)] == [("10012345678901", True), (u, False), (None, False)]


def test_similarity(spark):
    rows = spark.createDataFrame([("abc", "abc", 1.0), ("", "", 1.0), ("", "x", 0.0), ("fssai 100123456", "fssai 10O123456", 1 - 1 / 15), ("a b " * 200, "a c " * 200, 1 / 3)], "a string, b string, s double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in rows.select(text.similarity(F.col("a"), F.col("b")), "s").collect())


def test_title_and_items(spark):
    assert each(spark, ["made in INDIA", "o'neil x2y"], text.title) == ["Made In India", "O'Neil X2Y"]
    assert each(spark, ["Flour (a, b), Salt; and oil, x, Sugar.*", "a,(b,c),dd", ""], text.split_items) == [["Flour (a, b)", "Salt", "Sugar"], ["(b,c)", "dd"], []]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1 \t\n()[],;.", max_size=30), min_size=20, max_size=40))
def test_invariants(spark, values):
    once = each(spark, values, text.squeeze)
    assert each(spark, once, text.squeeze) == once
    for item in (x for items in each(spark, values, text.split_items) for x in items):
        assert len(item) >= 1 and item == item.strip()


def test_a_text_is_searched_once_for_each_form_of_a_date(spark):
    column = extract.date(F.col("s"))
    shown = spark.createDataFrame([("x",)], "s string").select(column)._jdf.queryExecution().analyzed().toString()
    assert shown.split(" AS ")[0].count("regexp_extract(") == 3


def test_texts_without_a_company_s_word_are_not_searched_for_one(spark):
    # The pattern is tried from each of these letters to the end: minutes for one text.
    long = "Ab, " * 20_000
    rows = spark.createDataFrame([(0, long), (1, "Acme Foods Plot 7")], "k int, t string").select("k", extract.maker(F.col("t"))["value"].alias("v"))
    start = time.perf_counter()
    assert sorted(map(tuple, rows.collect())) == [(0, None), (1, "Acme Foods Plot 7")]
    assert time.perf_counter() - start < 30


def test_items_are_cut_in_steps_of_words_not_of_characters(spark):
    label = "Salt (sea; rock [x, y]), " + "a" * 300_000 + ", and oil; Cocoa*."
    rows = spark.createDataFrame([(label,)], "t string").select(text.split_items(F.col("t")).alias("v"))
    start = time.perf_counter()
    assert rows.head()["v"] == ["Salt (sea; rock [x, y])", "a" * 300_000, "Cocoa"]
    assert time.perf_counter() - start < 30
