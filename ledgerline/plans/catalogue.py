"""All queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import sheets
from ..functions import tables as t
from ..functions import values as v
from ..operators import classify, clean, layout, likeness, lines, repair, retry, rules
from ..operators import text as tx
from ..sources import extractors, folders
from . import checks_sql
from . import pages as made
from .invoices import HEADERS, ITEMS, ORDERED, duck, frame, headers, items

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TOL = "0.05"
I, H = f"({duck(ITEMS)})", f"({duck(HEADERS)})"


def short_methods(spark) -> None:
    """Wide projections as many small methods: Java never compiles a method of more than 8,000 bytes, and runs a whole stage in one such method some times slower."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def groups_in_order(spark) -> None:
    """Groups of rows that lie in order by their key are folded as they come, neither hashed nor sorted again."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def query(oracle: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            short_methods(spark)
            groups_in_order(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- rules ----------------------------------------------------------------------

_ITEM = ("doc_id", "rule", "status", "item", "retryable")


def _of(spark, sf_dir, rule):
    return rules.item_checks(items(spark, sf_dir), headers(spark, sf_dir), rules=[rule])


def _item_sql(rule: str, status: str, columns: str = "", where: str = "s IS NOT NULL", source: str = I) -> str:
    retry_ = "(s = 'ERROR')" if rule in t.RETRYABLE else "false"
    return f"SELECT doc_id, '{rule}' AS rule, s AS status, pos AS item, {retry_} AS retryable{columns} FROM (SELECT *, {status} AS s FROM (SELECT i.*, h.country_of_origin AS ho, h.state_code AS hs, h.invoice_text AS ht FROM {source} i LEFT JOIN {H} h USING (doc_id)) z) y WHERE {where}"


_EXPECTED = "round_even(CAST(quantity AS DECIMAL(18,6)) * unit_price, 2)"
_QTY = f"CASE WHEN quantity IS NULL OR unit_price IS NULL OR line_amount IS NULL THEN 'NOT_CHECKED' WHEN line_amount = 0 AND {_EXPECTED} > 0 THEN 'WARNING' WHEN abs({_EXPECTED} - line_amount) <= {TOL} THEN 'PASS' ELSE 'ERROR' END"


@query(_item_sql("QTY_X_UNIT_PRICE", _QTY, f", CASE WHEN s <> 'NOT_CHECKED' THEN CAST(abs({_EXPECTED} - line_amount) AS DECIMAL(38,6)) END AS difference"))
def qty_x_unit_price(spark, sf_dir):
    return _of(spark, sf_dir, "QTY_X_UNIT_PRICE").select(*_ITEM, "difference")


_TAX = f"CASE WHEN line_amount IS NULL OR rate IS NULL OR igst_amount IS NULL THEN 'NOT_CHECKED' WHEN abs(round_even(CAST(line_amount * rate AS DECIMAL(38,6)) / 100, 2) - igst_amount) <= {TOL} THEN 'PASS' ELSE 'ERROR' END"


@query(_item_sql("TAX_RECONCILIATION", _TAX))
def tax_reconciliation(spark, sf_dir):
    own = items(spark, sf_dir).withColumnRenamed("rate", "igst_rate")
    return rules.item_checks(own, headers(spark, sf_dir), rules=["TAX_RECONCILIATION"]).select(*_ITEM)


@query(
    f"""SELECT doc_id, 'REQUIRED_FIELD_MISSING' AS rule, CASE WHEN x IS NULL OR x = '' THEN 'ERROR' ELSE 'PASS' END AS status, pos AS item, (x IS NULL OR x = '') AS retryable, f AS field
    FROM (SELECT doc_id, pos, unnest(['Item_Ser_No', 'Item_Desc', 'Item_Qty', 'Item_Unit_Price']) AS f, unnest([ser_no, description, CAST(quantity AS VARCHAR), CAST(unit_price AS VARCHAR)]) AS x FROM {I} i) z"""
)
def required_fields(spark, sf_dir):
    return _of(spark, sf_dir, "REQUIRED_FIELD_MISSING").select(*_ITEM, "field")


_SQUEEZE = "upper(regexp_replace(coalesce({}, ''), '\\s+', '', 'g'))"
_HO, _IO = _SQUEEZE.format("ho"), _SQUEEZE.format("country_of_origin")


@query(_item_sql("COUNTRY_OF_ORIGIN_CONSISTENCY", f"CASE WHEN {_HO} = '' THEN NULL WHEN {_IO} = '' THEN 'NOT_CHECKED' WHEN {_IO} = {_HO} THEN 'PASS' ELSE 'WARNING' END"))
def origin_consistency(spark, sf_dir):
    return _of(spark, sf_dir, "COUNTRY_OF_ORIGIN_CONSISTENCY").select(*_ITEM)


@query(_item_sql("QTY_VS_TARIFF_QTY", "CASE WHEN quantity IS NULL OR tariff_qty IS NULL THEN 'NOT_CHECKED' WHEN quantity = tariff_qty THEN 'PASS' ELSE 'ERROR' END"))
def tariff_quantity(spark, sf_dir):
    return _of(spark, sf_dir, "QTY_VS_TARIFF_QTY").select(*_ITEM)


_U, _TU = _SQUEEZE.format("unit"), _SQUEEZE.format("tariff_unit")


@query(_item_sql("UNIT_VS_TARIFF_UNIT", f"CASE WHEN {_U} = '' OR {_TU} = '' THEN 'NOT_CHECKED' WHEN {_U} = {_TU} THEN 'PASS' ELSE 'WARNING' END"))
def tariff_unit(spark, sf_dir):
    return _of(spark, sf_dir, "UNIT_VS_TARIFF_UNIT").select(*_ITEM)


@query(_item_sql("STATE_CODE_CONSISTENCY", "CASE WHEN coalesce(hs, '') = '' THEN NULL WHEN state_code = '' THEN 'NOT_CHECKED' WHEN ltrim(state_code, '0') = ltrim(hs, '0') THEN 'PASS' ELSE 'WARNING' END"))
def state_code(spark, sf_dir):
    return _of(spark, sf_dir, "STATE_CODE_CONSISTENCY").select(*_ITEM)


_DIGITS = "length(regexp_replace(hsn, '\\D', '', 'g'))"


@query(_item_sql("HSN_FORMAT", f"CASE WHEN hsn = '' THEN NULL WHEN {_DIGITS} IN (4, 6, 8) THEN 'PASS' WHEN {_DIGITS} BETWEEN 1 AND 3 THEN 'ERROR' ELSE 'WARNING' END"))
def hsn_format(spark, sf_dir):
    return _of(spark, sf_dir, "HSN_FORMAT").select(*_ITEM)


_PN = "nullif(regexp_extract(description, 'P/N: ([A-Za-z0-9./-]{3,})', 1), '')"


@query(_item_sql("PART_NUMBER_SOURCE_MATCH", f"CASE WHEN {_PN} IS NULL THEN 'NOT_CHECKED' WHEN upper({_PN}) = upper(part_number) THEN 'PASS' WHEN part_number = '' THEN 'WARNING' ELSE 'ERROR' END"))
def part_source_match(spark, sf_dir):
    return _of(spark, sf_dir, "PART_NUMBER_SOURCE_MATCH").select(*_ITEM)


_TY = "nullif(regexp_extract(description, 'Type: ([A-Za-z0-9./-]{2,})', 1), '')"


@query(_item_sql("MODEL_SOURCE_MATCH", f"CASE WHEN {_TY} IS NULL THEN 'NOT_CHECKED' WHEN upper({_TY}) = upper(model_or_type) THEN 'PASS' WHEN model_or_type = '' THEN 'WARNING' ELSE 'ERROR' END"))
def model_source_match(spark, sf_dir):
    return _of(spark, sf_dir, "MODEL_SOURCE_MATCH").select(*_ITEM)


_FIRST = f"(SELECT *, row_number() OVER (PARTITION BY doc_id, upper(order_number) ORDER BY pos) AS n FROM {I} ii)"


@query(_item_sql("ORDER_NUMBER_SOURCE_MATCH", "CASE WHEN n > 1 OR order_number = '' THEN NULL WHEN coalesce(ht, '') = '' THEN 'NOT_CHECKED' WHEN contains(upper(order_number), 'PO' || doc_id) OR contains('PO' || doc_id, upper(order_number)) THEN 'PASS' ELSE 'ERROR' END", source=_FIRST))
def order_no_source_match(spark, sf_dir):
    return _of(spark, sf_dir, "ORDER_NUMBER_SOURCE_MATCH").select(*_ITEM)


_SUMS = f"(SELECT doc_id, count(*) AS n, count(line_amount) AS k, CAST(sum(line_amount) AS DECIMAL(28,6)) AS s, count(total_packages) AS np, CAST(sum(total_packages) AS DECIMAL(28,6)) AS ps, min(total_packages) AS pmin, max(total_packages) AS pmax FROM {I} i GROUP BY doc_id)"
@query(f"{checks_sql.WITH} SELECT doc_id, rule, status, retryable FROM checks WHERE rule IN ('HEADER_LINE_TOTAL', 'LINE_ITEMS_INCOMPLETE', 'MULTI_INVOICE_TOTAL_SPLIT')")
def header_line_total(spark, sf_dir):
    return rules.document_checks(items(spark, sf_dir), headers(spark, sf_dir), rules=rules.TOTAL_RULES, fields=()).select("doc_id", "rule", "status", "retryable")


@query(
    f"""SELECT doc_id, CASE WHEN np = 0 OR np IS NULL THEN 'NOT_CHECKED' WHEN ps = hp OR (pmin = hp AND pmax = hp) THEN 'PASS' ELSE 'WARNING' END AS status, CASE WHEN np > 0 THEN {checks_sql.number("hp")} END AS expected, CASE WHEN np > 0 AND ps <> hp AND NOT (pmin = hp AND pmax = hp) THEN {checks_sql.number("ps")} END AS actual
    FROM (SELECT doc_id, TRY_CAST(nullif(total_packages, '') AS DECIMAL(18,6)) AS hp FROM {H} hh) h LEFT JOIN {_SUMS} z USING (doc_id) WHERE hp IS NOT NULL"""
)
def package_counts(spark, sf_dir):
    return rules.document_checks(items(spark, sf_dir), headers(spark, sf_dir), rules=["PACKAGE_COUNT_CONSISTENCY"]).select("doc_id", "status", "expected", "actual")


@query(f"{checks_sql.WITH} SELECT doc_id, field, status, actual FROM checks WHERE rule = 'FORMAT_TYPE' AND item IS NULL")
def format_types(spark, sf_dir):
    return rules.document_checks(items(spark, sf_dir), headers(spark, sf_dir), rules=["FORMAT_TYPE"]).select("doc_id", "field", "status", "actual")


@query(
    f"""SELECT doc_id, n_items, CAST(count(*) FILTER (WHERE e) AS BIGINT) AS n_error_items FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n_items, ({_QTY}) = 'ERROR' OR quantity IS NULL OR unit_price IS NULL OR ser_no IS NULL OR ({_DIGITS} BETWEEN 1 AND 3) OR quantity <> tariff_qty OR (nullif(regexp_extract(description, 'P/N: ([A-Za-z0-9./-]{{3,}})', 1), '') IS NOT NULL AND upper(regexp_extract(description, 'P/N: ([A-Za-z0-9./-]{{3,}})', 1)) <> upper(part_number) AND part_number <> '') OR ({_TY} IS NOT NULL AND upper({_TY}) <> upper(model_or_type) AND model_or_type <> '') AS e FROM {I} i) z GROUP BY doc_id, n_items"""
)
def erroneous_items(spark, sf_dir):
    own = items(spark, sf_dir)
    asked = [r for r in rules.ITEM_RULES if r != "ORDER_NUMBER_SOURCE_MATCH"]
    bad = rules.item_checks(own, headers(spark, sf_dir), rules=asked, fields=["item"]).filter(F.col("status") == "ERROR").groupBy("doc_id").agg(F.countDistinct("item").alias("n"))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_items")).join(bad, "doc_id", "left").select("doc_id", "n_items", F.coalesce("n", F.lit(0)).cast("long").alias("n_error_items"))


def _taxed(spark, sf_dir):
    return items(spark, sf_dir).withColumnRenamed("rate", "igst_rate"), headers(spark, sf_dir)


@query(checks_sql.VERDICTS)
def validate_invoice(spark, sf_dir):
    """Every document's verdict over all rules."""
    return rules.verdicts(rules.validate(*_taxed(spark, sf_dir), fields=()))


@query(checks_sql.CHECKS)
def all_checks(spark, sf_dir):
    """Every finding with its message."""
    return rules.validate(*_taxed(spark, sf_dir)).select("doc_id", "rule", "status", "message", "item", "field", "expected", "actual", "difference", "retryable")


@query(checks_sql.RESULTS)
def result_documents(spark, sf_dir):
    found = rules.validation_results(*_taxed(spark, sf_dir))
    return found.select("doc_id", "valid", "status", F.size("errors").alias("n_errors"), F.size("checks").alias("n_checks"), F.array_join(F.col("warnings")["message"], "\n").alias("warnings"), F.array_join("passed_rules", ",").alias("passed"))


@query(checks_sql.FEEDBACK)
def retry_feedback(spark, sf_dir):
    return retry.feedback(rules.validate(*_taxed(spark, sf_dir)))


_GAPS = "SELECT doc_id, CASE WHEN count(*) = count(line_amount) THEN sum(line_amount) END AS s FROM {} i WHERE quantity IS NOT NULL OR unit_price IS NOT NULL OR line_amount IS NOT NULL GROUP BY doc_id"
_NEW = f"(SELECT doc_id, pos, quantity, unit_price, CASE WHEN part % 21 = 0 THEN NULL ELSE CAST(line_amount + part % 3 AS DECIMAL(18,2)) END AS line_amount FROM {I} i)"


@query(
    f"""SELECT doc_id, (t IS NULL OR og IS NULL OR coalesce(ng <= og, false)) AS accept FROM (
      SELECT h.doc_id, TRY_CAST(h.invoice_total AS DECIMAL(28,6)) AS t, abs(TRY_CAST(h.invoice_total AS DECIMAL(28,6)) - a.s) AS og,
      abs(TRY_CAST(h.invoice_total AS DECIMAL(28,6)) - b.s) AS ng FROM {H} h LEFT JOIN ({_GAPS.format(I)}) a USING (doc_id) LEFT JOIN ({_GAPS.format(_NEW)}) b USING (doc_id)) z"""
)
def retry_loop_accept(spark, sf_dir):
    old = items(spark, sf_dir).withColumnRenamed("line_amount", "line_total")
    new = old.withColumn("line_total", F.when(F.col("part") % 21 != 0, (F.col("line_total") + F.col("part") % 3).cast("decimal(18,2)")))
    totals = headers(spark, sf_dir).select("doc_id", F.col("invoice_total").try_cast("decimal(28,6)").alias("total"))
    return retry.accepted(new, old, totals)


@query(made.ROUNDS_SQL)
def reextraction_rounds(spark, sf_dir):
    heads = frame(spark, sf_dir, made.READ_TOTALS)
    read_again = lambda attempt, pending: frame(spark, sf_dir, made.read_items(attempt)).join(pending, "doc_id", "left_semi")

    def judge(rows):
        checks = rules.item_checks(rows.withColumnRenamed("line_total", "line_amount"), heads, rules=["QTY_X_UNIT_PRICE"], fields=("rule", "status"))
        return checks.groupBy("doc_id").agg((F.count_if(F.col("status") == "ERROR") == 0).alias("valid"), F.bool_or("retryable").alias("again"))

    rows, verdicts = retry.rounds(frame(spark, sf_dir, made.read_items(1)), read_again, judge, heads, 2)
    sums = rows.groupBy("doc_id").agg(F.sum("line_total").cast("decimal(28,2)").alias("amount"))
    return verdicts.join(sums, "doc_id").select("doc_id", "attempts", F.when(F.col("valid"), "validated").otherwise("validation_failed").alias("status"), "amount")


# --- cleaning --------------------------------------------------------------------


def _raw_items(spark, sf_dir):
    own = items(spark, sf_dir)
    fields = F.create_map(*[x for k, c in (("product_description", F.when(F.col("part") % 41 == 0, "Stainless rod").otherwise(F.col("description"))), ("part_no", F.col("part_number")), ("type", F.col("model_or_type")), ("order_number", F.col("order_number")), ("hsn_code", F.col("hsn")), ("quantity", F.concat(F.lit(" "), F.col("quantity").cast("string"))), ("unit_price", F.concat(F.lit("$"), F.col("unit_price").cast("string"))), ("line_total", F.col("line_amount").cast("string")), ("unit_of_measurement", F.col("unit")), ("fta_code", F.when(F.col("part") % 15 == 0, "GNX200").when(F.col("part") % 15 == 1, "1234567-7654321").otherwise("F1")), ("ohms", F.when(F.col("part") % 43 == 0, "47"))) for x in (F.lit(k), c.cast("string"))])
    return own.select("doc_id", "pos", F.map_filter(fields, lambda _, x: x.isNotNull()).alias("fields"))


_RAW = f"(SELECT *, CASE WHEN part % 41 = 0 THEN 'Stainless rod' ELSE description END AS d FROM {I} i)"
_CLEAN = f"""SELECT doc_id, pos, d AS product_description, part_number, CASE WHEN part % 43 = 0 THEN CASE WHEN m = '' THEN '47 OHMS' ELSE m || ' (47 OHMS)' END ELSE m END AS model_or_type, quantity, unit_price, CAST(line_amount AS DECIMAL(18,6)) AS line_total,
  CASE WHEN part % 15 = 0 THEN 'GNX200' END AS end_use_code, CASE WHEN part % 15 > 1 THEN 'F1' END AS fta_code, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) AS item_ser_no,
  CASE WHEN quantity > 0 AND unit_price > 0 AND line_amount = 0 THEN 'free_of_cost' WHEN quantity > 0 AND unit_price > 0 AND line_amount > 0 AND abs(CAST(quantity AS DECIMAL(18,6)) * unit_price - line_amount) > greatest(1, line_amount * CAST(0.02 AS DECIMAL(4,2))) THEN 'math_discrepancy' ELSE '' END AS warnings
FROM (SELECT *, CASE WHEN length(d) > 8 AND contains(lower(d), lower(model_or_type)) THEN '' ELSE model_or_type END AS m FROM {_RAW} r) z WHERE NOT (contains(upper(d), 'LESS') AND quantity IS NULL)"""


@query(_CLEAN)
def clean_items(spark, sf_dir):
    d = clean.items(_raw_items(spark, sf_dir))
    return d.select("doc_id", "pos", "product_description", "part_number", "model_or_type", "quantity", F.col("unit_price").cast("decimal(18,2)").alias("unit_price"), "line_total", "end_use_code", "fta_code", "item_ser_no", F.array_join("warnings", ",").alias("warnings"))


_CODES = "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in t.CURRENCY_ALIASES.items()) + "}"


@query(
    f"""SELECT doc_id, {", ".join(f"nullif(trim({c}), '') AS {c}" for c in ("invoice_number", "invoice_date", "ad_code", "iec_number", "country_of_origin"))},
    regexp_replace(regexp_replace(nullif(trim(total_packages), ''), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS total_packages, nullif(tax, '') AS supplier_tax_id, CASE WHEN prefix IS NOT NULL AND (own IS NULL OR lpad(own, 2, '0') <> prefix) THEN prefix ELSE own END AS state_code,
    coalesce({_CODES}[upper(replace(money, '.', ''))], CASE WHEN regexp_full_match(money, '[A-Za-z]{{3}}') THEN upper(money) ELSE money END) AS currency, 'N' AS reward_scheme_claim, TRY_CAST(nullif(trim(invoice_total), '') AS DECIMAL(18,6)) AS invoice_total_dec,
    CAST(CASE WHEN tax <> '' AND prefix IS NULL THEN 1 ELSE 0 END + CASE WHEN own IS NOT NULL AND lpad(own, 2, '0') <> prefix THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
    FROM (SELECT *, CASE WHEN regexp_matches(tax, '{t.GSTIN}') THEN left(tax, 2) END AS prefix, nullif(coalesce(nullif(regexp_extract(state_code, '\\b(\\d{{1,2}})\\b', 1), ''), trim(state_code)), '') AS own, nullif(trim(currency), '') AS money FROM (SELECT *, upper(trim(coalesce(supplier_tax_id, ''))) AS tax FROM {H} h) a) z"""
)
def clean_header(spark, sf_dir):
    raw = headers(spark, sf_dir)
    return clean.headers(raw).select("doc_id", "invoice_number", "invoice_date", "ad_code", "iec_number", "country_of_origin", "total_packages", "supplier_tax_id", "state_code", "currency", "reward_scheme_claim", "invoice_total_dec", F.size("warnings").cast("long").alias("n_warnings"))


_NONE = "(upper(trim({})) IN ('NA', 'N/A', '-', 'NIL', 'NONE', ''))"
_ORIGIN = f"CASE WHEN h.country_of_origin IS NULL OR h.country_of_origin = '0' OR {_NONE.format('h.country_of_origin')} THEN '' ELSE h.country_of_origin END"
_TEXT = lambda c: f"coalesce(CAST(CAST({c} AS DECIMAL(18,6)) AS VARCHAR), '')"
_BOTH = {"hsn": "i.hsn", "description": "product_description", "quantity": _TEXT("c.quantity"), "unit_price": _TEXT("c.unit_price"), "line_amount": _TEXT("c.line_total"), "unit": "i.unit", "tariff_qty": _TEXT("c.quantity"), "tariff_unit": "i.unit", "ser_no": "item_ser_no", "country_of_origin": _ORIGIN}
_MAPPED = {
    "export": {t.CONCEPTS["export"][k]: x for k, x in _BOTH.items()} | {"Item_End_Use": "coalesce(end_use_code, '')", "FTA Code": "coalesce(fta_code, '')", "State Code": "CASE WHEN h.state_code = '0' THEN '' ELSE coalesce(h.state_code, '') END", "ItmTotpkg": "CASE WHEN h.total_packages = '0' THEN '' ELSE coalesce(h.total_packages, '') END"},
    "import": {t.CONCEPTS["import"][k]: x for k, x in _BOTH.items()} | {"Item_End_Use": "coalesce(end_use_code, '')", "Model": "c.model_or_type", "COO Country": _ORIGIN},
}


def _wide_sql(shipment: str, columns) -> str:
    """All columns of a sheet; those that nothing is mapped to are empty."""
    cells = ", ".join(f"""{_MAPPED[shipment].get(c, "''")} AS "{c}\"""" for c in columns)
    return f"SELECT c.doc_id, c.pos, {cells}, c.part_number, c.model_or_type, i.order_number FROM ({_CLEAN}) c JOIN {I} i USING (doc_id, pos) LEFT JOIN {H} h ON h.doc_id = c.doc_id"


@query(_wide_sql("export", t.ITEM_COLUMNS))
def map_export(spark, sf_dir):
    return clean.sheet(clean.items(_raw_items(spark, sf_dir)), headers(spark, sf_dir), "export")


@query(_wide_sql("import", t.BOE_COLUMNS))
def map_import(spark, sf_dir):
    return clean.sheet(clean.items(_raw_items(spark, sf_dir)), headers(spark, sf_dir), "import")


_PACK = f"(SELECT doc_id, pos, part, CAST(q AS DECIMAL(18,6)) AS quantity, 'PN-' || (part % 5) AS part_number, CASE WHEN part % 2 = 0 THEN NULL ELSE p END AS unit_price FROM ({duck(ORDERED)}) o)"


@query(f"SELECT a.doc_id, a.pos FROM {_PACK} a WHERE NOT (a.unit_price IS NULL AND EXISTS (SELECT 1 FROM {_PACK} b WHERE b.doc_id = a.doc_id AND b.quantity = a.quantity AND b.part_number = a.part_number AND b.unit_price IS NOT NULL))")
def packing_list_dedupe(spark, sf_dir):
    own = frame(spark, sf_dir, ORDERED).select("doc_id", "pos", F.col("q").alias("quantity"), F.concat(F.lit("PN-"), (F.col("part") % 5).cast("string")).alias("part_number"), F.lit("").alias("product_description"), F.when(F.col("part") % 2 == 1, F.col("p")).alias("unit_price"))
    return clean.without_packing_list_repeats(own).select("doc_id", "pos")


@query(made.BUNDLE_SQL)
def bundle_dedupe(spark, sf_dir):
    return clean.without_bundle_repeats(frame(spark, sf_dir, made.BUNDLE), frame(spark, sf_dir, made.BUNDLE_TOTALS)).select("doc_id", "pos")


_SER = f"(SELECT doc_id, pos, CASE WHEN part % 6 = 0 THEN NULL ELSE line END AS s FROM ({duck(ORDERED)}) o)"


@query(
    f"""SELECT doc_id, pos, CASE WHEN bool_or(f) OVER (PARTITION BY doc_id) THEN CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) ELSE CAST(s AS VARCHAR) END AS item_ser_no
    FROM (SELECT *, coalesce(s <= last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS f FROM {_SER} z) y"""
)
def ser_no_reset(spark, sf_dir):
    own = frame(spark, sf_dir, ORDERED).select("doc_id", "pos", F.when(F.col("part") % 6 != 0, F.col("line").cast("string")).alias("item_ser_no"))
    return clean.renumbered(own).select("doc_id", "pos", "item_ser_no")


# --- texts ------------------------------------------------------------------------


def _paged(spark, sf_dir):
    """Documents whose lines are pages under headings."""
    d = read(spark, sf_dir, "documents")
    page = lambda x, i: F.concat(F.lit("=== PAGE "), (i + 1).cast("string"), F.lit(" OF 9 ===\n"), F.when((i % 2 == 1) & (F.length(x) % 3 == 0), "Air Waybill Shipper's name and address Notify party\n").otherwise(""), x, F.lit("\n"))
    return d.select("doc_id", F.concat(F.lit("lead\n"), F.array_join(F.transform(F.split("text", "\n"), page), "")).alias("text"))


_P = "(SELECT doc_id, i, x, len(parts) AS n, '=== PAGE ' || i || ' OF 9 ===' || chr(10) || CASE WHEN i % 2 = 0 AND length(x) % 3 = 0 THEN 'Air Waybill Shipper''s name and address Notify party' || chr(10) ELSE '' END || x || chr(10) AS page, (i % 2 = 0 AND length(x) % 3 = 0) AS waybill FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) a) b)"


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS page_no, md5(CASE WHEN n = 1 THEN 'lead' || chr(10) ELSE '' END || page) AS h FROM {_P} p")
def split_pages(spark, sf_dir):
    return tx.pages(_paged(spark, sf_dir)).select("doc_id", "page_no", F.md5("page").alias("h"))


@query(f"SELECT doc_id, CAST((i - 1) // 2 AS INTEGER) AS chunk_no, md5(string_agg(CASE WHEN n = 1 THEN 'lead' || chr(10) ELSE '' END || page, chr(10) || chr(10) ORDER BY i)) AS h FROM {_P} p GROUP BY doc_id, (i - 1) // 2")
def page_chunks(spark, sf_dir):
    return tx.page_chunks(tx.pages(_paged(spark, sf_dir))).select("doc_id", "chunk_no", F.md5("chunk").alias("h"))


@query(f"SELECT doc_id, md5(CASE WHEN k = 0 OR k = n OR n = 1 THEN w ELSE kept END) AS h FROM (SELECT doc_id, n, count(*) FILTER (WHERE waybill) AS k, 'lead' || chr(10) || string_agg(page, '' ORDER BY i) AS w, string_agg(page, '' ORDER BY i) FILTER (WHERE NOT waybill) AS kept FROM {_P} p GROUP BY doc_id, n) z")
def transport_pages(spark, sf_dir):
    return _paged(spark, sf_dir).select("doc_id", F.md5(tx.without_transport_pages("text")).alias("h"))


@query(
    """SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) >= 2)) / len(w) ELSE 0.0 END AS ratio
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[a-zA-Z0-9]')) AS w FROM documents) z"""
)
def word_quality(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.word_quality("text").alias("q")).select("doc_id", "q.n_words", "q.ratio")


def _pages_of_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_no"), "text")


_STATS = """(SELECT doc_id, i AS page_no, length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS chars, len(list_filter(w, lambda y: length(y) >= 2)) AS valid_words, len(list_filter(w, lambda y: length(y) < 2)) AS single_char_words
FROM (SELECT doc_id, i, x, list_filter(regexp_split_to_array(x, '\\s+'), lambda y: regexp_matches(y, '[a-zA-Z0-9]')) AS w FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) a) b) c)"""


@query(f"SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(chars AS INTEGER) AS chars, CAST(valid_words AS INTEGER) AS valid_words, CAST(single_char_words AS INTEGER) AS single_char_words FROM {_STATS} s")
def page_stats(spark, sf_dir):
    return layout.page_stats(_pages_of_documents(spark, sf_dir))


@query(
    f"""SELECT doc_id, (c / n < 150 OR w / n < 25 OR s > w * 0.8 OR (n > 1 AND dense < n / 2)) AS is_scanned, partial AS has_partial_pages
    FROM (SELECT doc_id, count(*) AS n, sum(chars) AS c, sum(valid_words) AS w, sum(single_char_words) AS s, count(*) FILTER (WHERE valid_words >= 25) AS dense, bool_or(chars > 0 AND valid_words < 25) AS partial FROM {_STATS} z GROUP BY doc_id) y"""
)
def is_scanned(spark, sf_dir):
    return layout.scanned(layout.page_stats(_pages_of_documents(spark, sf_dir)))


def _printed(spark, sf_dir):
    """(doc_id, text): the items' rows as a document prints them."""
    own = items(spark, sf_dir)
    row = F.concat(F.col("pos").cast("string"), F.lit(" │ "), F.col("part_number"), F.lit(" ITEM"), (F.col("part") % 7).cast("string"), F.lit(" │ "), F.when(F.col("part") % 2 == 0, "8481 80 90").otherwise("84818090"), F.lit(" │ "), F.coalesce(F.col("unit_price").cast("string"), F.lit("")), F.lit(" │ "), F.col("line_amount").cast("string"), F.when(F.col("part") % 3 == 0, F.concat(F.lit("\n   "), F.col("line_amount").cast("string"))).otherwise(""))
    return own.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", row.alias("r"))))["r"], "\n").alias("text"))


_ROW = "CAST(pos AS VARCHAR) || ' │ ' || part_number || ' ITEM' || (part % 7) || ' │ ' || CASE WHEN part % 2 = 0 THEN '8481 80 90' ELSE '84818090' END || ' │ ' || coalesce(CAST(unit_price AS VARCHAR), '') || ' │ ' || CAST(line_amount AS VARCHAR)"
_LINES = f"(SELECT doc_id, pos, {_ROW} AS r, CASE WHEN part % 3 = 0 THEN '   ' || CAST(line_amount AS VARCHAR) END AS extra FROM {I} i)"


@query(f"SELECT i.doc_id, i.pos, CAST(count(*) AS BIGINT) AS n_lines FROM {I} i JOIN {_LINES} l ON i.doc_id = l.doc_id WHERE length(i.part_number) >= 4 AND contains(lower(l.r), lower(i.part_number)) GROUP BY i.doc_id, i.pos")
def source_row_lines(spark, sf_dir):
    own = items(spark, sf_dir).select("doc_id", "pos", "part_number", F.lit("").alias("product_description"))
    return tx.source_lines(own, _printed(spark, sf_dir)).groupBy("doc_id", "pos").agg(F.count("*").alias("n_lines"))


@query(f"SELECT i.doc_id, i.pos, md5(string_agg(l.r || coalesce(chr(10) || l.extra, ''), chr(10) ORDER BY l.pos)) AS h FROM {I} i JOIN {_LINES} l ON i.doc_id = l.doc_id WHERE length(i.part_number) >= 4 AND contains(lower(l.r), lower(i.part_number)) GROUP BY i.doc_id, i.pos")
def row_blocks(spark, sf_dir):
    own = items(spark, sf_dir).select("doc_id", "pos", "part_number", F.lit("").alias("product_description"))
    return tx.item_blocks(own, _printed(spark, sf_dir)).select("doc_id", "pos", F.md5("block").alias("h"))


@query(f"SELECT doc_id, amount, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(CASE WHEN part % 3 = 0 THEN [unit_price, line_amount, line_amount] ELSE [unit_price, line_amount] END) AS amount FROM {I} i) z WHERE amount IS NOT NULL GROUP BY doc_id, amount")
def money_tokens(spark, sf_dir):
    return tx.money_counts(_printed(spark, sf_dir))


@query(made.REPAIRS_SQL)
def line_repairs(spark, sf_dir):
    """HSN codes, shifted prices, charge rows and unprinted amounts over printed rows."""
    # Rows without a document have no text. Said here, it holds for items and texts alike, and both read one shuffle of rows.
    own = frame(spark, sf_dir, made.READ).filter("doc_id is not null")
    end = F.concat(F.lit("\nTOTAL"), F.when(F.col("doc_id") % 2 == 0, "\nFREIGHT CHARGES │ 100.00").otherwise(""))
    texts = own.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "printed")))["printed"], "\n").alias("text")).select("doc_id", F.concat("text", end).alias("text"))
    items_ = own.select("doc_id", "pos", "product_description", "part_number", "hsn_code", "quantity", "unit_price", "line_total")
    return repair.line_items(items_, texts).select("doc_id", "pos", "hsn_code", "hsn_note", F.col("unit_price").cast("decimal(18,2)").alias("unit_price"), F.col("line_total").cast("decimal(18,2)").alias("line_total"), "price_note", "amount_note")


@query(made.HEADS_SQL)
def header_repairs(spark, sf_dir):
    own = clean._missing(frame(spark, sf_dir, made.HEADS), t.HEADER_FIELDS)
    return repair.header_values(own, frame(spark, sf_dir, made.HEAD_ITEMS)).select("doc_id", "invoice_total", "net_realisable_amount", "total_packages", "country_of_origin")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'IO-' || o_orderkey ELSE 'IO-' || o_orderkey || ' / X' || o_orderkey END AS invoice_number, (o_orderkey % 2 = 0) AS collapsed FROM orders")
def collapse_invoice_refs(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10-"), k, F.lit(" / IO-"), k)).otherwise(F.concat(F.lit("IO-"), k, F.lit(" / X"), k)).alias("invoice_number"), F.lit("").alias("invoice_date"), F.lit("").alias("invoice_total"), F.lit("").alias("invoice_text"))
    return repair.collapsed_references(d).select("doc_id", "invoice_number", "collapsed")


@query(made.SUPPLIED_SQL)
def supplier_formats(spark, sf_dir):
    return repair.supplier_numbers(frame(spark, sf_dir, made.SUPPLIED), frame(spark, sf_dir, made.FORMATS)).select("doc_id", "invoice_number", "number_note")


def _stamped(spark, sf_dir):
    """Documents with the words of trade put in."""
    k = F.col("doc_id")
    lead = F.when(k % 6 == 0, "Shipping  Bill\nMEIS ").when(k % 6 == 1, "into bond egm ").when(k % 6 == 2, "Country of origin: India │ Final destination: Germany\n").when(k % 6 == 3, "Buyer: ACME, Pune, India\n").when(k % 6 == 4, "Exporter: ACME, Pune, India\n").otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text").alias("text"))


_STAMPED = "(SELECT doc_id, lower(CASE doc_id % 6 WHEN 0 THEN 'Shipping  Bill' || chr(10) || 'MEIS ' WHEN 1 THEN 'into bond egm ' WHEN 2 THEN 'Country of origin: India │ Final destination: Germany' || chr(10) WHEN 3 THEN 'Buyer: ACME, Pune, India' || chr(10) WHEN 4 THEN 'Exporter: ACME, Pune, India' || chr(10) ELSE '' END || text) AS low FROM documents)"


@query(f"SELECT doc_id, {made.phrase_points(t.EXPORT_STRONG, t.STRONG_POINTS)} + {made.phrase_points(t.EXPORT_WEAK, t.WEAK_POINTS)} AS export_score, {made.phrase_points(t.IMPORT_STRONG, t.STRONG_POINTS)} + {made.phrase_points(t.IMPORT_WEAK, t.WEAK_POINTS)} AS import_score FROM {_STAMPED} z")
def phrase_score(spark, sf_dir):
    return classify.keyword_scores(_stamped(spark, sf_dir)).select("doc_id", "export_score", "import_score")


@query(made.SHIPMENT_SQL)
def shipment_type(spark, sf_dir):
    return classify.detect(frame(spark, sf_dir, made.ADDRESSED)).drop("matched")


@query(made.PARTY_SQL)
def party_signals(spark, sf_dir):
    d = frame(spark, sf_dir, made.ADDRESSED)
    met = d.select("doc_id").join(classify.party_signals(d), "doc_id", "left")
    return met.select("doc_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("origin_home", "destination_home")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("buyer_home", "supplier_home")))


@query(made.NAMES_SQL)
def fuzzy_repeats(spark, sf_dir):
    n = frame(spark, sf_dir, made.NAMES)
    pairs = likeness.like_pairs(n.select("size", "part", "name"), n.select("size", F.col("part").alias("other"), F.col("misread").alias("name")), ["size"], "part", "other", "name", 0.6)
    return pairs.select("size", "part", "other", F.when(F.col("likeness") >= 0.85, "same").otherwise("like").alias("kind"))


# --- layout -------------------------------------------------------------------------

_SEGMENTS = "SELECT l_orderkey AS doc_id, 1 AS page_no, CAST(l_partkey % 600 AS INT) AS x1, CAST(l_suppkey % 800 AS INT) AS y1, CAST(l_partkey % 600 + l_linenumber * 40 - 100 AS INT) AS x2, CAST(l_suppkey % 800 + l_quantity AS INT) AS y2, 600 AS width, 800 AS height FROM {lineitem}"
_ANGLES = f"""(SELECT *, CASE WHEN g > 45 THEN g - 90 WHEN g < -45 THEN g + 90 ELSE g END AS norm, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS len FROM (SELECT *, CASE WHEN a <= -90 THEN a + 180 WHEN a > 90 THEN a - 180 ELSE a END AS g FROM (SELECT *, degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))) AS a FROM ({duck(_SEGMENTS)}) s) b) c)"""


@query(
    f"""SELECT doc_id, page_no, b AS skew_deg, n AS n_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round(total, 6) DESC, b) AS r FROM (SELECT doc_id, page_no, round_even(norm, 0) AS b, sum(len) AS total, count(*) AS n FROM {_ANGLES} z GROUP BY ALL) y) x WHERE r = 1"""
)
def skew_cluster(spark, sf_dir):
    return layout.skew_clusters(frame(spark, sf_dir, _SEGMENTS))


@query(made.HOUGH_SQL)
def hough_votes(spark, sf_dir):
    return lines.peaks(lines.votes(frame(spark, sf_dir, made.INK), made.INK_TILTS, made.INK_LEAST), made.INK_LEAST)


@query(made.CLIPPED_SQL)
def edge_clipping(spark, sf_dir):
    return layout.clipped_edges(frame(spark, sf_dir, made.RULED)).select("doc_id", "page_no", F.array_join("clipped_edges", ",").alias("edges"))


_WORDS = "SELECT l_orderkey AS doc_id, 1 AS page_no, CAST(l_linenumber AS INT) AS line_no, 'w' AS text, CAST(l_partkey % 60 * 10 AS DOUBLE) AS x0, CAST(l_partkey % 60 * 10 + 12 AS DOUBLE) AS x1, CAST(l_linenumber * 12 AS DOUBLE) AS top, CAST(l_linenumber * 12 + 8 AS DOUBLE) AS bottom, CAST(l_partkey % 5 AS DOUBLE) AS skew_deg, 600.0 AS page_width, 800.0 AS page_height FROM {lineitem}"


@query(
    f"""SELECT doc_id, line_no, round(CASE WHEN on_ THEN nx - 6 ELSE x0 END, 6) AS x0, round(CASE WHEN on_ THEN ny - 4 ELSE top END, 6) AS top FROM (SELECT *, abs(skew_deg) BETWEEN 0.3 AND 30 AS on_, 300 + dx * cos(th) - dy * sin(th) AS nx, 400 + dx * sin(th) + dy * cos(th) AS ny FROM (SELECT *, radians(-skew_deg) AS th, (x0 + x1) / 2 - 300 AS dx, (top + bottom) / 2 - 400 AS dy FROM ({duck(_WORDS)}) w) z) y"""
)
def deskew(spark, sf_dir):
    return layout.deskewed(frame(spark, sf_dir, _WORDS)).select("doc_id", "line_no", F.round("x0", 6).alias("x0"), F.round("top", 6).alias("top"))


@query(made.BOUNDARIES_SQL)
def column_boundaries(spark, sf_dir):
    words = layout.text_lines(frame(spark, sf_dir, made.CELLS))
    return layout.column_boundaries(words).select("doc_id", "page_no", F.array_join(F.transform("boundaries", lambda x: x.cast("string")), ",").alias("boundaries"))


@query(made.CANVAS_SQL)
def layout_canvas(spark, sf_dir):
    words = layout.text_lines(frame(spark, sf_dir, made.CELLS))
    pages = layout.canvas(words, layout.column_boundaries(words))
    return layout.document_text(pages).select("doc_id", F.md5("text").alias("h"))


@query(made.GLYPH_CANVAS_SQL)
def glyph_canvas(spark, sf_dir):
    pages = layout.page_canvas(frame(spark, sf_dir, made.CELL_GLYPHS))
    return layout.document_text(pages).select("doc_id", F.md5("text").alias("h"))


@query(made.GLYPHS_SQL)
def glyph_dedupe(spark, sf_dir):
    kept = layout.without_overlaid_glyphs(frame(spark, sf_dir, made.GLYPHS))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), ordered.alias("text"))


# --- sources and sinks -----------------------------------------------------------------


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 4 = 1 THEN replace(props, '}', ', "z": null}') ELSE props END AS whole FROM events""")
def json_repair(spark, sf_dir):
    """Answers broken in four ways, mended."""
    e = read(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.replace("props", F.lit("}"), F.lit(", \"z\": N/A,}"))).when(F.col("event_id") % 4 == 2, F.replace("props", F.lit('"'), F.lit("'"))).otherwise(F.concat(F.lit("Here you are: "), "props"))
    answers = extractors.parsed(e.select("event_id", broken.alias("answer")))
    return answers.select("event_id", F.get_json_object("json", "$.k").try_cast("long").alias("k"), F.col("json").alias("whole"))


@query(
    """SELECT conv_id, turn, CAST(greatest(0, n - n // 4) AS BIGINT) AS input_tokens, CAST(n + n // 2 AS BIGINT) AS total_tokens, round((n - n // 4) / 1e6 * pi + (n // 4) / 1e6 * pc + (n // 2) / 1e6 * 0.4, 6) AS cost_usd
    FROM (SELECT conv_id, turn, length(text) AS n, CASE WHEN role = 'user' THEN 0.05 ELSE 0.1 END AS pi, CASE WHEN role = 'user' THEN 0.005 ELSE 0.025 END AS pc FROM conversations) z"""
)
def token_cost(spark, sf_dir):
    n = F.length("text")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "gpt-5-nano").otherwise("unknown").alias("model"), n.alias("i"), F.floor(n / 4).cast("int").alias("c"), F.floor(n / 2).cast("int").alias("o"))
    return c.select("conv_id", "turn", v.token_cost("model", "i", "c", "o").alias("x")).select("conv_id", "turn", "x.input_tokens", "x.total_tokens", "x.cost_usd")


@query(
    """SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY lower(s)) > 1 THEN replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '__') ELSE s END AS out_name
    FROM (SELECT page_id, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS s FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || '.pdf' AS path FROM pages) a) b"""
)
def output_names(spark, sf_dir):
    paths = read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), F.lit(".pdf")).alias("path"))
    return folders.output_names(paths).select("page_id", "out_name")


@query(
    """SELECT count(*) FILTER (WHERE k > 1) AS ok, count(*) FILTER (WHERE k = 0) AS skipped, count(*) FILTER (WHERE k = 1) AS failed, CAST(sum(event_id) FILTER (WHERE k > 1) AS BIGINT) AS total_cost FROM (SELECT event_id, event_id % 5 AS k FROM events) z"""
)
def batch_summary(spark, sf_dir):
    k = F.col("event_id") % 5
    rows = read(spark, sf_dir, "events").select(folders.status_of(F.when(k == 1, "broken"), F.when(k == 0, "unknown type")).alias("status"), F.col("event_id").alias("cost_inr"), F.lit(1).alias("item_rows"), F.lit(1).alias("total_tokens"))
    return folders.summary(rows).select("ok", "skipped", "failed", F.col("total_cost_inr").cast("long").alias("total_cost"))


@query(made.TEMPLATE_SQL)
def template_schema(spark, sf_dir):
    """All template columns, and names made of parts, with their types, aliases and link column."""
    return sheets.template_columns(spark).unionByName(sheets.described(frame(spark, sf_dir, made.TEMPLATE_NAMES)))


@query(made.DOMAIN_SQL)
def domain_rules(spark, sf_dir):
    rows = clean.domain_cleaned(frame(spark, sf_dir, made.DOMAIN))
    named = {"FTA Code": "fta", "Cess Rate": "cess", "State Code": "state"}
    return rows.select("doc_id", "pos", "n", *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(named.get(c, c)) for c in rows.columns if c not in ("doc_id", "pos", "n")))


@query(made.DATES_SQL)
def date_forms(spark, sf_dir):
    return frame(spark, sf_dir, made.DATES).select("doc_id", F.date_format(v.parsed_date("written"), "yyyy-MM-dd").alias("day"))


@query(made.CODES_SQL)
def code_repairs(spark, sf_dir):
    d = frame(spark, sf_dir, made.CODES).withColumn("ad", v.repaired_ad_code("ad_code"))
    return d.select("doc_id", v.repaired_gstin("tax_id").alias("tax_id"), F.col("ad").alias("ad_code"), v.is_ad_code("ad").alias("ad_code_fits"), v.without_tariff_tail("description").alias("description"))


@query(made.COMPARED_SQL)
def result_comparison(spark, sf_dir):
    rows = extractors.compared(frame(spark, sf_dir, made.READINGS), frame(spark, sf_dir, made.READINGS_AGAIN), made.COMPARED)
    return rows.withColumnsRenamed({"left": "left_", "right": "right_"})
