"""Rules: a valid invoice, then one field changed at a time."""

import pytest

from ledgerline.operators import retry, rules

ITEM = dict(doc_id="d", pos=1, ser_no="1", description="WIDGET", part_number="P-1", model_or_type="", order_number="", hsn="84818090", quantity="10", unit="NOS", unit_price="10.00", line_amount="100.00", tariff_qty="10", tariff_unit="NOS", country_of_origin="IN", state_code="07", total_packages="2", igst_rate="18%", igst_amount="18.00")
HEADER = dict(doc_id="d", invoice_number="INV-1", invoice_total="100.00", invoice_date="2026-08-08", currency="USD", supplier_tax_id="27ABCDE1234F1Z5", ad_code="1234567-8901234", iec_number="ABCDE12345", country_of_origin="in", state_code="7", total_packages="2", invoice_text="")


CASES: list[tuple[list[dict], dict]] = []


def case(items=None, **header) -> str:
    """Adds an invoice to the batch that is validated at once; gives its id."""
    CASES.append((items if items is not None else [{}], header))
    return f"d{len(CASES) - 1}"


@pytest.fixture(scope="module")
def found(spark):
    """All findings of all cases, by document."""
    own = spark.createDataFrame([tuple((ITEM | {"pos": i, "doc_id": f"d{n}"} | x)[k] for k in ITEM) for n, (rows, _) in enumerate(CASES) for i, x in enumerate(rows, 1)], ", ".join(f"{k} {'int' if k == 'pos' else 'string'}" for k in ITEM))
    heads = spark.createDataFrame([tuple((HEADER | h | {"doc_id": f"d{n}"}).values()) for n, (_, h) in enumerate(CASES)], ", ".join(f"{k} string" for k in HEADER))
    checks = rules.validate(own, heads).cache()
    out = {"all": checks}
    for row in checks.collect():
        out.setdefault(row["doc_id"], []).append(row)
    yield out
    checks.unpersist()


def statuses(rows, rule, field=None):
    return sorted(r["status"] for r in rows if r["rule"] == rule and (field is None or r["field"] == field))


VALID = case()
HALF_EVEN = case([{"quantity": "0.5", "unit_price": "4.69"}])
TWICE = case([{"order_number": "PO1"}, {"order_number": "po 1"}], invoice_text="P/O: PO1", invoice_total="200.00")
BAD = case([{"line_amount": "90"}], currency="EURO", invoice_total="90.00")
EMPTY = case([])


def test_a_valid_invoice_has_no_error(found):
    assert {r["status"] for r in found[VALID]} <= {"PASS", "NOT_CHECKED"}
    verdicts = {r["doc_id"]: r for r in rules.verdicts(found["all"]).collect()}
    assert verdicts[VALID]["valid"] and verdicts[BAD]["status"] == "INVALID"


AMOUNTS = [({}, "PASS"), ({"line_amount": "100.05"}, "PASS"), ({"line_amount": "100.06"}, "ERROR"), ({"line_amount": "0"}, "WARNING"), ({"unit_price": ""}, "NOT_CHECKED"), ({"line_amount": "1,00"}, "NOT_CHECKED"), ({"quantity": "0.5", "unit_price": "4.69", "line_amount": "2.34"}, "PASS")]
AMOUNTS = [(case([change]), status) for change, status in AMOUNTS]


@pytest.mark.parametrize(("doc", "status"), AMOUNTS)
def test_quantity_times_price(found, doc, status):
    assert statuses(found[doc], "QTY_X_UNIT_PRICE") == [status]


def test_rounding_is_half_even(found):
    row = next(r for r in found[HALF_EVEN] if r["rule"] == "QTY_X_UNIT_PRICE")
    assert row["expected"] == "2.34"


TOTALS = [
        ([{}], {}, "HEADER_LINE_TOTAL", ["PASS"]),
        ([{}], {"invoice_total": "150.00"}, "LINE_ITEMS_INCOMPLETE", ["ERROR"]),
        ([{}], {"invoice_total": "150.00"}, "HEADER_LINE_TOTAL", []),
        ([{}], {"invoice_total": "90.00"}, "HEADER_LINE_TOTAL", ["ERROR"]),
        ([{}], {"invoice_total": "150.00", "invoice_text": "ADD AIR FREIGHT:-  50.00"}, "HEADER_LINE_TOTAL", ["PASS"]),
        ([{}], {"invoice_total": "145.00", "invoice_text": "ADD AIR FREIGHT 50.00\nLESS DISCOUNT 5.00\nPACKING 9.00"}, "HEADER_LINE_TOTAL", ["PASS"]),
        ([{}], {"invoice_total": "150.00", "invoice_text": "FREIGHT 50.00%"}, "LINE_ITEMS_INCOMPLETE", ["ERROR"]),
        ([{}, {"line_amount": ""}], {}, "HEADER_LINE_TOTAL", ["NOT_CHECKED"]),
        ([{}], {"invoice_total": ""}, "HEADER_LINE_TOTAL", ["NOT_CHECKED"]),
        ([{}], {"invoice_number": "A / B", "invoice_total": "60.00 / 40.00"}, "HEADER_LINE_TOTAL", ["PASS"]),
        ([{}], {"invoice_number": "A / B", "invoice_total": "100.00"}, "MULTI_INVOICE_TOTAL_SPLIT", ["ERROR"]),
        ([{}], {"invoice_number": "AB/2627/I/000001"}, "MULTI_INVOICE_TOTAL_SPLIT", []),
]
TOTALS = [(case(items, **header), rule, status) for items, header, rule, status in TOTALS]


@pytest.mark.parametrize(("doc", "rule", "status"), TOTALS)
def test_totals(found, doc, rule, status):
    assert statuses(found[doc], rule) == status


def test_the_smallest_bridge_wins(spark):
    d = spark.createDataFrame([("ADD A 1.00\nADD B 2.00\nADD C 3.00",)], "t string")
    from pyspark.sql import functions as F

    found = rules.bridging(F.lit(10).cast("decimal(28,2)"), F.lit(13).cast("decimal(28,2)"), rules.adjustments("t"))
    assert [x["label"] for x in d.select(found.alias("b")).first()["b"]] == ["ADD C"]


ITEM_RULES = [
        ({"country_of_origin": "D E"}, {}, "COUNTRY_OF_ORIGIN_CONSISTENCY", ["WARNING"]),
        ({}, {"country_of_origin": ""}, "COUNTRY_OF_ORIGIN_CONSISTENCY", []),
        ({"tariff_qty": "11"}, {}, "QTY_VS_TARIFF_QTY", ["ERROR"]),
        ({"tariff_unit": "kg"}, {}, "UNIT_VS_TARIFF_UNIT", ["WARNING"]),
        ({"state_code": "8"}, {}, "STATE_CODE_CONSISTENCY", ["WARNING"]),
        ({"state_code": ""}, {}, "STATE_CODE_CONSISTENCY", ["NOT_CHECKED"]),
        ({"total_packages": "3"}, {}, "PACKAGE_COUNT_CONSISTENCY", ["WARNING"]),
        ({}, {"total_packages": ""}, "PACKAGE_COUNT_CONSISTENCY", []),
        ({"igst_amount": "19.00"}, {}, "TAX_RECONCILIATION", ["ERROR"]),
        ({"igst_amount": None}, {}, "TAX_RECONCILIATION", ["NOT_CHECKED"]),
        ({"hsn": "12"}, {}, "HSN_FORMAT", ["ERROR"]),
        ({"hsn": "12345"}, {}, "HSN_FORMAT", ["WARNING"]),
        ({"hsn": ""}, {}, "HSN_FORMAT", []),
        ({"description": "X P/N: P-2"}, {}, "PART_NUMBER_SOURCE_MATCH", ["ERROR"]),
        ({"description": "X P/N: p-1"}, {}, "PART_NUMBER_SOURCE_MATCH", ["PASS"]),
        ({"description": "X P/N: P-2", "part_number": ""}, {}, "PART_NUMBER_SOURCE_MATCH", ["WARNING"]),
        ({"order_number": "PO77"}, {"invoice_text": "P/O: 77PO77"}, "ORDER_NUMBER_SOURCE_MATCH", ["PASS"]),
        ({"order_number": "PO77"}, {"invoice_text": "P/O: ABC"}, "ORDER_NUMBER_SOURCE_MATCH", ["ERROR"]),
        ({"order_number": "PO77"}, {}, "ORDER_NUMBER_SOURCE_MATCH", ["NOT_CHECKED"]),
]
ITEM_RULES = [(case([change], **header), rule, status) for change, header, rule, status in ITEM_RULES]


@pytest.mark.parametrize(("doc", "rule", "status"), ITEM_RULES)
def test_item_rules(found, doc, rule, status):
    assert statuses(found[doc], rule) == status


FORMATS = [("currency", "EURO", ["ERROR"]), ("currency", "XYZ", ["WARNING"]), ("currency", "", []), ("invoice_date", "soon", ["WARNING"]), ("invoice_date", "", ["NOT_CHECKED"]), ("iec_number", "x", ["WARNING"]), ("invoice_total", "abc", ["ERROR"])]
FORMATS = [(case(**{field: value}), field, status) for field, value, status in FORMATS]


@pytest.mark.parametrize(("doc", "field", "status"), FORMATS)
def test_header_formats(found, doc, field, status):
    assert statuses(found[doc], "FORMAT_TYPE", field) == status


def test_imports_do_not_judge_foreign_tax_ids(spark):
    own = spark.createDataFrame([tuple(ITEM.values())], ", ".join(f"{k} {'int' if k == 'pos' else 'string'}" for k in ITEM))
    heads = spark.createDataFrame([tuple((HEADER | {"supplier_tax_id": "DE1"}).values())], ", ".join(f"{k} string" for k in HEADER))
    rows = rules.validate(own, heads, "import").collect()
    assert statuses(rows, "FORMAT_TYPE", "supplier_tax_id") == ["NOT_CHECKED"]
    assert statuses(rows, "TAX_RECONCILIATION") == ["NOT_CHECKED"]
    assert statuses(rows, "STATE_CODE_CONSISTENCY") == []


def test_repeated_orders_are_judged_once(found):
    assert statuses(found[TWICE], "ORDER_NUMBER_SOURCE_MATCH") == ["PASS"]


def test_feedback_goes_to_the_pass_that_can_mend_it(found):
    told = {r["doc_id"]: r for r in retry.feedback(found["all"]).collect()}
    assert "[FORMAT_TYPE] currency" in told[BAD]["header_feedback"] and "QTY_X_UNIT_PRICE" not in told[BAD]["header_feedback"]
    assert "ITEM 1: [QTY_X_UNIT_PRICE]" in told[BAD]["items_feedback"]
    assert VALID not in told


def test_a_document_without_items(found):
    assert statuses(found[EMPTY], "HEADER_LINE_TOTAL") == ["NOT_CHECKED"]


def test_the_array_of_checks_is_made_once_and_compiled(spark):
    own = spark.createDataFrame([("d", 1, "2", "3", "6")], "doc_id string, pos int, quantity string, unit_price string, line_amount string")
    found = rules.item_checks(own, spark.createDataFrame([("d",)], "doc_id string"), rules=["QTY_X_UNIT_PRICE"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.lower() and "size(array" not in plan


def test_shared_values_are_made_once(spark):
    """A finding's status, and the numbers and texts it turns on, are not made again for each of its fields."""
    from ledgerline.plans.invoices import headers, items

    made = rules.item_checks(items(spark, "/root/testdata/sf0.001").withColumnRenamed("rate", "igst_rate"), headers(spark, "/root/testdata/sf0.001"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 30
    assert plan.count("Window [") == 2  # the position, and an order number's least one: items are read once


def test_items_of_a_document_are_shuffled_once(spark):
    from pyspark.sql import functions as F

    from ledgerline.plans.invoices import items

    plan = items(spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(F.max("pos"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_numbers_print_without_zeros_at_the_end(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    d = spark.createDataFrame([(Decimal(x),) for x in ("100.000000", "0.000000", "-0.500000", "12.340000", "7.000001")], "x decimal(18,6)")
    assert [r.t for r in d.select(rules.text(F.col("x")).alias("t")).collect()] == ["100", "0", "-0.5", "12.34", "7.000001"]


def test_results_equal_those_of_rows_of_findings(spark):
    """Also for documents without header or items, with two headers, with one order number in two spellings or twice in a place, and without a key."""
    order = lambda doc, pos, number: ITEM | {"doc_id": doc, "pos": pos, "order_number": number}
    rows = [order("a", 2, "po 1"), order("a", 1, "PO1"), order("a", 3, "PO2"), order("a", 4, ""), order("a", 1, "P O1"), order("alone", 1, "PO9"), order("twice", 1, "PO1"), order("twice", 2, "PO1"), order(None, 1, "PO1"), order("a", None, "PO1"), order("bad", 1, "PO7") | {"quantity": "x", "line_amount": "1"}]
    heads = [HEADER | {"doc_id": d, "invoice_text": text, "invoice_total": total} for d, text, total in (("a", "P/O: PO1", "500"), ("twice", "P/O: PO1", "200"), ("twice", "P/O: PO5", "1"), ("empty", "", ""), (None, "P/O: PO1", "100"), ("bad", "P/O: PO1", "90"))]
    own = spark.createDataFrame([tuple(x[k] for k in ITEM) for x in rows], ", ".join(f"{k} {'int' if k == 'pos' else 'string'}" for k in ITEM))
    headers = spark.createDataFrame([tuple(h.values()) for h in heads], ", ".join(f"{k} string" for k in HEADER))
    want = rules.result_documents(rules.validate(own, headers))
    made = rules.validation_results(own, headers)
    assert made.columns == want.columns
    made, want = ({r["doc_id"]: r for r in d.collect()} for d in (made, want))
    assert set(made) == {"a", "alone", "twice", "empty", "bad", None} and made == want
    assert sum(c["rule"] == "ORDER_NUMBER_SOURCE_MATCH" for c in made["a"]["checks"]) == 3


def test_findings_of_results_are_not_shuffled(spark):
    """What is dealt out is what findings are made from; of a table's rows only those without a key go by findings."""
    from ledgerline.plans import catalogue

    def dealt(node):
        own = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())] if node.nodeName() == "Exchange" else []
        return own + [x for i in range(node.children().size()) for x in dealt(node.children().apply(i))]

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["result_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().executedPlan()
        types = dealt(plan.children().apply(0) if plan.nodeName() == "Union" else plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert types and not [x for x in types if x == "binary" or "struct" in x]
