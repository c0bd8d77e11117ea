"""Parsers and normalisers of single values."""

from pyspark.sql import functions as F

from ledgerline.functions import values as v


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "x string").select(expression.alias("y")).first()["y"]


def test_three_number_parsers_strip_different_things(spark):
    assert float(one(spark, " $1,234.50 ", v.coerced("x"))) == 1234.5
    assert one(spark, "1,234", v.loose("x")) == 1234.0
    assert one(spark, "1,234", v.strict("x")) is None
    assert one(spark, "$5", v.loose("x")) is None
    assert one(spark, "", v.strict("x")) is None
    assert float(one(spark, "0", v.strict("x"))) == 0


def test_combined_values_are_cut_only_at_spaced_slashes(spark):
    assert one(spark, "400.00 / 100.00", v.parts("x")) == ["400.00", "100.00"]
    assert one(spark, "AB/2627/I/000001", v.parts("x")) == ["AB/2627/I/000001"]
    assert one(spark, "10- / IO-0", v.parts("x")) == ["10-", "IO-0"]


def test_tax_ids(spark):
    good = "27ABCDE1234F1Z5"
    assert one(spark, good, v.repaired_gstin("x")) == good
    assert one(spark, good + "7", v.repaired_gstin("x")) == good
    assert one(spark, "DE 123", v.repaired_gstin("x")) == "DE123"
    assert one(spark, "short", v.is_gstin("x")) is False


def test_ad_codes_with_doubled_glyphs(spark):
    code = "1234567-8901234"
    assert one(spark, code, v.repaired_ad_code("x")) == code
    assert one(spark, "".join(c * 2 for c in code), v.repaired_ad_code("x")) == code
    assert one(spark, "12345", v.repaired_ad_code("x")) == "12345"


def test_currency_country_state(spark):
    assert one(spark, "euro", v.currency("x")) == "EUR"
    assert one(spark, "U.S. Dollars", v.currency("x")) == "USD"
    assert one(spark, "xyz", v.currency("x")) == "XYZ"
    assert one(spark, "Euros only", v.currency("x")) == "Euros only"
    assert one(spark, "India", v.country("x")) == "IN"
    assert one(spark, "Peru", v.country("x")) == "Peru"
    assert one(spark, "Maharashtra (27)", v.state_digits("x")) == "27"
    assert one(spark, "Goa", v.state_digits("x")) == "Goa"


def test_dates_without_padding(spark):
    assert one(spark, "5-6-2026", v.parsed_date("x")) is not None
    assert one(spark, "08 Aug 2026", v.parsed_date("x")) is not None
    assert one(spark, "soon", v.parsed_date("x")) is None


def test_header_total_adds_parts_only_for_combined_numbers(spark):
    d = spark.createDataFrame([("400.00 / 100.00", "A / B"), ("400.00 / 100.00", "A"), ("7.5", "A"), ("x", "A / B")], "t string, n string")
    got = [r["y"] for r in d.select(v.header_total("t", "n").alias("y")).collect()]
    assert [None if x is None else float(x) for x in got] == [500.0, None, 7.5, None]


def test_money_in_both_conventions(spark):
    got = one(spark, "1,750.29 22,65 1.803,21 40.000 12.5 01.02.2026", v.money_in("x"))
    assert [float(x) for x in got] == [1750.29, 22.65, 1803.21]


def test_ocr_keys_and_labels(spark):
    assert one(spark, "SI-O0l1", v.ocr_key("x")) == one(spark, "S1-0011", v.ocr_key("x"))
    assert one(spark, "VALVE P/N: P-0001 Type: T7", v.first_labelled((r"(?i)P\s*/\s*N\.?\s*[:\-]?\s*([A-Za-z0-9\-\./]{3,})",), "x")) == "P-0001"
    assert one(spark, "P/O: ab12 P/O: AB12 P/O: X99", v.all_labelled((r"(?i)P\s*/\s*O\.?\s*[:\-]?\s*([A-Za-z0-9\-]{3,})",), "x")) == ["ab12", "X99"]


def test_template_types_and_aliases(spark):
    assert one(spark, "Item_Qty", v.column_type("x")) == "number"
    assert one(spark, "Cess Amount", v.column_type("x")) == "string"
    assert one(spark, "SIMS_Rgn_Date", v.column_type("x")) == "string"
    assert one(spark, "Item_Ser_No", v.column_alias("x")) == "Item Serial Number"


def test_unwrapped_and_tariff_tail(spark):
    assert one(spark, '{"value": "7"}', v.unwrapped("x")) == "7"
    assert one(spark, "plain", v.unwrapped("x")) == "plain"
    assert one(spark, "VALVE 84818090A OTHER VALVES", v.without_tariff_tail("x")) == "VALVE"
    assert one(spark, "VALVE DN50", v.without_tariff_tail("x")) == "VALVE DN50"


def test_cost_of_unknown_models_takes_the_default(spark):
    d = spark.createDataFrame([("gpt-5-nano", 1000, 200, 100), ("other", 1000, 200, 100)], "m string, i int, c int, o int")
    a, b = [r["y"] for r in d.select(v.token_cost("m", "i", "c", "o").alias("y")).collect()]
    assert a["input_tokens"] == 800 and a["total_tokens"] == 1100
    assert a["cost_usd"] == round(800 / 1e6 * 0.05 + 200 / 1e6 * 0.005 + 100 / 1e6 * 0.4, 6)
    assert b["cost_usd"] == round(800 / 1e6 * 0.1 + 200 / 1e6 * 0.025 + 100 / 1e6 * 0.4, 6)
    assert F is not None
