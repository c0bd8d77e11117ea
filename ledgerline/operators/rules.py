"""Validation rules. Every finding is a row: a rule, a status, what it says, and what it compares.

A status is PASS, WARNING, ERROR or NOT_CHECKED. Conditions are ordered: what
cannot be checked comes first, so a null never falls through to an error. The
rules of one item are array expressions over its row and its header, exploded
together, so all item rules cost one projection; the rules of a document need one
aggregate by document. Only the rules and the fields of findings that are asked for
are built, so a question about one rule costs no more than that rule.

Items: doc_id, pos, description, part_number, model_or_type, order_number, hsn,
quantity, unit, unit_price, line_amount, tariff_qty, tariff_unit,
country_of_origin, state_code, total_packages, igst_rate, igst_amount (texts or
numbers). Headers: doc_id and the header fields. Columns that are missing count
as null; which of them the shipment's sheet has decides what is checked.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tables as t
from ..functions import values as v

FIELDS = ("seq", "rule", "status", "message", "item", "field", "expected", "actual", "difference")
ITEM_COLUMNS = ("ser_no", "description", "part_number", "model_or_type", "order_number", "hsn", "quantity", "unit", "unit_price", "line_amount", "tariff_qty", "tariff_unit", "country_of_origin", "state_code", "total_packages", "igst_rate", "igst_amount")
#: Fields of findings in results, by which they are in order.
RESULT_FIELDS = ("seq", "item", "rule", "field", "status", "message", "expected", "actual", "difference", "retryable")
AMOUNT = "decimal(38,6)"


def tolerance() -> Column:
    return F.lit(t.TOLERANCE).cast("decimal(18,6)")


def text(c) -> Column:
    """A decimal with a fraction as it prints, without zeros at the end."""
    return F.rtrim(F.rtrim(c.cast("string"), F.lit("0")), F.lit("."))


def say(*parts) -> Column:
    """A message of texts and columns; a null column leaves a gap."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])


@dataclass
class Check:
    """One rule's finding as columns; there is none where `status` is null. `says` has the message of each status that has one."""

    seq: int
    rule: str
    status: Column
    item: Column | None = None
    field: str | None = None
    expected: Column | None = None
    actual: Column | None = None
    difference: Column | None = None
    says: dict[str, Column] | None = None

    def column(self, fields: Sequence[str] = FIELDS) -> Column:
        return F.when(self.status.isNotNull(), F.struct(*[self._field(f).alias(f) for f in fields]))

    def result(self) -> Column:
        """The finding as results have it."""
        fields = {f: self._field(f) for f in FIELDS}
        fields["difference"] = fields["difference"].cast("double")
        fields["retryable"] = self.status == "ERROR" if self.rule in t.RETRYABLE else F.lit(False)
        return F.when(self.status.isNotNull(), F.struct(*[fields[f].alias(f) for f in RESULT_FIELDS]))

    def _field(self, name: str) -> Column:
        if name == "message":
            out = F.lit("")
            for status, words in (self.says or {}).items():
                out = F.when(self.status == status, words).otherwise(out)
            return out
        value = getattr(self, name)
        types = {"seq": "int", "item": "int", "difference": AMOUNT}
        return (value if isinstance(value, Column) else F.lit(value)).cast(types.get(name, "string"))


class Made:
    """Values that findings share, each made once for a row: by level, a level's from the ones before.

    Without it every finding would parse its numbers and judge its status again for each field that turns on them.
    """

    def __init__(self, frame: DataFrame):
        self.frame, self.levels = frame, ({}, {}, {})
        self.exact = {f.name for f in frame.schema if isinstance(f.dataType, (T.DecimalType, T.IntegralType))}

    def put(self, level: int, name: str, column: Column) -> Column:
        self.levels[level][f"__{level}_{name}"] = column
        return F.col(f"__{level}_{name}")

    def number(self, c: str) -> Column:
        return self.put(0, f"n_{c}", F.col(c).try_cast(v.DECIMAL) if c in self.exact else v.strict(c))

    def token(self, c: str) -> Column:
        return self.put(0, f"t_{c}", v.token(c))

    def given(self, c: str) -> Column:
        return F.col(c).isNotNull() if c in self.exact else F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    def status(self, rule: str, column: Column) -> Column:
        return self.put(2, f"s_{rule}", column)

    def rows(self) -> DataFrame:
        out = self.frame
        for level in self.levels:
            out = out.select("*", *[c.alias(name) for name, c in level.items()]) if level else out
        return out


def _has(shipment: str, concept: str) -> str | None:
    return t.CONCEPTS[shipment].get(concept)


def required(shipment: str, made: Made) -> list[Check]:
    out = []
    for concept in t.REQUIRED_CONCEPTS:
        name = _has(shipment, concept)
        out.append(Check(1, "REQUIRED_FIELD_MISSING", made.status(f"given_{concept}", F.when(made.given(concept), "PASS").otherwise("ERROR")), F.col("pos"), name, says={"ERROR": F.lit(f"{name} ({concept}) has no value")}))
    return out


def quantity_times_price(shipment: str, made: Made) -> list[Check]:
    q, p, a = made.number("quantity"), made.number("unit_price"), made.number("line_amount")
    expected = made.put(1, "product", F.bround(q * p, 2))
    gap = F.abs(expected - a)
    status = F.when(q.isNull() | p.isNull() | a.isNull(), "NOT_CHECKED").when((a == 0) & (expected > 0), "WARNING").when(gap <= tolerance(), "PASS").otherwise("ERROR")
    status = made.status("QTY_X_UNIT_PRICE", status)
    known = status != "NOT_CHECKED"
    product = (text(q), " x ", text(p), " = ", text(expected))
    says = {"NOT_CHECKED": F.lit("quantity, unit price or line amount is not given"), "WARNING": say(*product, ", but the line amount is 0: free of cost?"), "ERROR": say(*product, ", but the line amount is ", text(a), ", ", text(gap), " away")}
    return [Check(2, "QTY_X_UNIT_PRICE", status, F.col("pos"), _has(shipment, "line_amount"), F.when(known, text(expected)), F.when(known, text(a)), F.when(known, gap), says)]


def tax(shipment: str, made: Made) -> list[Check]:
    if shipment != "export":
        return []
    taxable, amount = made.number("line_amount"), made.number("igst_amount")
    rate = made.put(0, "rate", F.regexp_replace(F.col("igst_rate").cast("string"), r"[^\d.]", "").try_cast(v.DECIMAL))
    expected = made.put(1, "tax", F.bround(taxable * rate / 100, 2))
    gap = F.abs(expected - amount)
    status = F.when(taxable.isNull() | rate.isNull() | amount.isNull(), "NOT_CHECKED").when(gap <= tolerance(), "PASS").otherwise("ERROR")
    status = made.status("TAX_RECONCILIATION", status)
    known = status != "NOT_CHECKED"
    says = {"NOT_CHECKED": F.lit("taxable value, tax rate or tax amount is not given"), "ERROR": say(text(rate), " % of ", text(taxable), " = ", text(expected), ", but the tax amount is ", text(amount), ", ", text(gap), " away")}
    return [Check(4, "TAX_RECONCILIATION", status, F.col("pos"), _has(shipment, "igst_amount"), F.when(known, text(expected)), F.when(known, text(amount)), F.when(known, gap), says)]


def origin(shipment: str, made: Made) -> list[Check]:
    head, own = made.token("h_country_of_origin"), made.token("country_of_origin")
    status = made.status("COUNTRY_OF_ORIGIN_CONSISTENCY", F.when(head == "", None).when(own == "", "NOT_CHECKED").when(own == head, "PASS").otherwise("WARNING"))
    says = {"NOT_CHECKED": F.lit("the item names no country of origin"), "WARNING": say("the item comes from ", own, ", the header says ", head)}
    return [Check(5, "COUNTRY_OF_ORIGIN_CONSISTENCY", status, F.col("pos"), _has(shipment, "country_of_origin"), F.when(own != "", head), F.when(own != "", own), says=says)]


def tariff_quantity(shipment: str, made: Made) -> list[Check]:
    q, tq = made.number("quantity"), made.number("tariff_qty")
    status = made.status("QTY_VS_TARIFF_QTY", F.when(q.isNull() | tq.isNull(), "NOT_CHECKED").when(q == tq, "PASS").otherwise("ERROR"))
    says = {"NOT_CHECKED": F.lit("quantity or tariff quantity is not given"), "ERROR": say("quantity ", text(q), " is not the tariff quantity ", text(tq))}
    return [Check(5, "QTY_VS_TARIFF_QTY", status, F.col("pos"), _has(shipment, "tariff_qty"), F.when(tq.isNotNull(), text(q)), F.when(q.isNotNull(), text(tq)), F.when(q != tq, F.abs(q - tq)), says)]


def tariff_unit(shipment: str, made: Made) -> list[Check]:
    u, tu = made.token("unit"), made.token("tariff_unit")
    status = made.status("UNIT_VS_TARIFF_UNIT", F.when((u == "") | (tu == ""), "NOT_CHECKED").when(u == tu, "PASS").otherwise("WARNING"))
    says = {"NOT_CHECKED": F.lit("unit or tariff unit is not given"), "WARNING": say("unit ", u, " is not the tariff unit ", tu)}
    return [Check(5, "UNIT_VS_TARIFF_UNIT", status, F.col("pos"), _has(shipment, "tariff_unit"), F.when(status == "WARNING", u), F.when(status == "WARNING", tu), says=says)]


def state(shipment: str, made: Made) -> list[Check]:
    if not _has(shipment, "state_code"):
        return []
    head, own = made.token("h_state_code"), made.token("state_code")
    status = made.status("STATE_CODE_CONSISTENCY", F.when(head == "", None).when(own == "", "NOT_CHECKED").when(F.ltrim(own, F.lit("0")) == F.ltrim(head, F.lit("0")), "PASS").otherwise("WARNING"))
    says = {"NOT_CHECKED": F.lit("the item names no state code"), "WARNING": say("the item's state code is ", own, ", the header's ", head)}
    return [Check(5, "STATE_CODE_CONSISTENCY", status, F.col("pos"), _has(shipment, "state_code"), F.when(status == "WARNING", head), F.when(status == "WARNING", own), says=says)]


def label_match(rule: str, patterns, column: str, made: Made, seq: int = 6) -> list[Check]:
    printed = made.put(0, f"label_{column}", v.first_labelled(patterns, "description"))
    own = made.token(column)
    status = made.status(rule, F.when(printed.isNull(), "NOT_CHECKED").when(v.token(printed) == own, "PASS").when(own == "", "WARNING").otherwise("ERROR"))
    says = {"NOT_CHECKED": F.lit(f"the description labels no {column}"), "WARNING": say("the description says ", printed, f", {column} is empty"), "ERROR": say("the description says ", printed, f", {column} is ", F.col(column))}
    return [Check(seq, rule, status, F.col("pos"), column, printed, F.when(printed.isNotNull(), F.coalesce(F.col(column), F.lit(""))), says=says)]


def parts(shipment: str, made: Made) -> list[Check]:
    return label_match("PART_NUMBER_SOURCE_MATCH", t.PART_LABELS, "part_number", made)


def models(shipment: str, made: Made) -> list[Check]:
    return label_match("MODEL_SOURCE_MATCH", t.MODEL_LABELS, "model_or_type", made)


def order_match(shipment: str, made: Made) -> list[Check]:
    """Judged at the first item of every distinct order number (first_order), by the header's printed ones (h_orders)."""
    own, printed = made.token("order_number"), F.coalesce(F.col("h_orders"), F.array().cast("array<string>"))
    hit = F.exists(printed, lambda o: own.contains(v.token(o)) | v.token(o).contains(own))
    status = made.status("ORDER_NUMBER_SOURCE_MATCH", F.when(~F.col("first_order") | (own == ""), None).when(F.size(printed) == 0, "NOT_CHECKED").when(hit, "PASS").otherwise("ERROR"))
    shown = F.array_join(printed, ", ")
    says = {"NOT_CHECKED": F.lit("the document labels no order number"), "ERROR": say("the document's order numbers are ", shown, ", order_number is ", F.col("order_number"))}
    return [Check(7, "ORDER_NUMBER_SOURCE_MATCH", status, F.col("pos"), "order_number", F.when(F.size(printed) > 0, shown), F.when(F.size(printed) > 0, F.col("order_number")), says=says)]


def numeric_format(shipment: str, made: Made) -> list[Check]:
    out = []
    for concept in ("quantity", "unit_price"):
        raw = F.col(concept).cast("string")
        n = made.number(concept)
        status = made.status(f"format_{concept}", F.when(n >= 0, "PASS").when(raw.isNull() | (raw == ""), None).otherwise("ERROR"))
        wrong = say(f"{concept} ", raw, F.when(n.isNull(), " is not a number").otherwise(" is negative"))
        out.append(Check(8, "FORMAT_TYPE", status, F.col("pos"), _has(shipment, concept), actual=F.when(status == "ERROR", raw), says={"ERROR": wrong}))
    return out


def hsn_format(shipment: str, made: Made) -> list[Check]:
    raw = F.col("hsn").cast("string")
    n = made.put(0, "hsn_digits", F.length(F.regexp_replace(raw, r"\D", "")))
    status = made.status("HSN_FORMAT", F.when(F.coalesce(F.trim(raw), F.lit("")) == "", None).when(n.isin(4, 6, 8), "PASS").when(n.between(1, 3), "ERROR").otherwise("WARNING"))
    says = {"ERROR": say(raw, " has ", n, " digits, too few for a tariff code: a line number?"), "WARNING": say(raw, " has ", n, " digits, tariff codes have 4, 6 or 8")}
    return [Check(9, "HSN_FORMAT", status, F.col("pos"), _has(shipment, "hsn"), actual=F.when(status != "PASS", raw), says=says)]


#: Rules of items, in the order of their findings. What they need of headers is in NEEDS.
ITEM_RULES = {
    "REQUIRED_FIELD_MISSING": required, "QTY_X_UNIT_PRICE": quantity_times_price, "TAX_RECONCILIATION": tax, "COUNTRY_OF_ORIGIN_CONSISTENCY": origin, "QTY_VS_TARIFF_QTY": tariff_quantity,
    "UNIT_VS_TARIFF_UNIT": tariff_unit, "STATE_CODE_CONSISTENCY": state, "PART_NUMBER_SOURCE_MATCH": parts, "MODEL_SOURCE_MATCH": models, "ORDER_NUMBER_SOURCE_MATCH": order_match, "FORMAT_TYPE": numeric_format,
    "HSN_FORMAT": hsn_format,
}
NEEDS = {"COUNTRY_OF_ORIGIN_CONSISTENCY": "country_of_origin", "STATE_CODE_CONSISTENCY": "state_code", "ORDER_NUMBER_SOURCE_MATCH": "orders"}


def header_format(shipment: str) -> list[Check]:
    """Findings on the header alone."""
    total = v.header_total("invoice_total", "invoice_number")
    raw_total = v.filled("invoice_total")
    wrong = total.isNull() | (total < 0)
    out = [Check(10, "FORMAT_TYPE", F.when(raw_total.isNull(), None).when(wrong, "ERROR").otherwise("PASS"), field="invoice_total", actual=F.when(wrong, raw_total), says={"ERROR": say("invoice_total ", raw_total, F.when(total.isNull(), " is not a number").otherwise(" is negative"))})]
    out.append(Check(11, "REQUIRED_FIELD_MISSING", F.when(v.filled("invoice_number").isNull(), "ERROR").otherwise("PASS"), field="invoice_number", says={"ERROR": F.lit("invoice_number has no value")}))
    date = v.filled("invoice_date")
    dated = v.parsed_date(date)
    out.append(Check(12, "FORMAT_TYPE", F.when(date.isNull(), "NOT_CHECKED").when(dated.isNull(), "WARNING").otherwise("PASS"), field="invoice_date", actual=F.when(dated.isNull(), date), says={"NOT_CHECKED": F.lit("invoice_date has no value"), "WARNING": say("invoice_date ", date, " is not a date of a known form")}))
    money = F.upper(F.trim(v.filled("currency")))
    status = F.when(money.isNull(), None).when(money.isin(*t.KNOWN_CURRENCIES), "PASS").when(money.rlike("^[A-Z]{3}$"), "WARNING").otherwise("ERROR")
    out.append(Check(13, "FORMAT_TYPE", status, field="currency", actual=F.when(~money.isin(*t.KNOWN_CURRENCIES), money), says={"WARNING": say("currency ", money, " is not a common one"), "ERROR": say("currency ", money, " is not a currency code")}))
    tax_id = F.trim(v.filled("supplier_tax_id"))
    fits = v.is_gstin(tax_id)
    status = F.when(tax_id.isNull(), None).when(F.lit(shipment != "export"), "NOT_CHECKED").when(fits, "PASS").otherwise("WARNING")
    out.append(Check(14, "FORMAT_TYPE", status, field="supplier_tax_id", actual=F.when(status == "WARNING", tax_id), says={"NOT_CHECKED": F.lit("a foreign supplier's tax number has no fixed form"), "WARNING": say("supplier_tax_id ", tax_id, " does not have the form of one")}))
    ad = F.trim(v.filled("ad_code"))
    out.append(Check(15, "FORMAT_TYPE", F.when(ad.isNull(), None).when(v.is_ad_code(ad), "PASS").otherwise("WARNING"), field="ad_code", actual=F.when(~v.is_ad_code(ad), ad), says={"WARNING": say("ad_code ", ad, " does not have 14 digits")}))
    iec = F.trim(v.filled("iec_number"))
    fits = F.upper(iec).rlike("^[A-Z0-9]{10}$")
    out.append(Check(16, "FORMAT_TYPE", F.when(iec.isNull(), None).when(fits, "PASS").otherwise("WARNING"), field="iec_number", actual=F.when(~fits, iec), says={"WARNING": say("iec_number ", iec, " does not have 10 letters and digits")}))
    return out


# --- adjustments -------------------------------------------------------------


def adjustments(text_column) -> Column:
    """array<struct<label, amount>>: printed lines that lower or raise a total, each once, in order."""
    lines = F.split(F.coalesce(v.col(text_column), F.lit("")), r"\r\n|\n|\r")

    def candidate(line):
        amounts = F.regexp_extract_all(line, F.lit(t.ADJUST_AMOUNT), F.lit(1))
        down, up = line.rlike(t.ADJUST_DOWN), line.rlike(t.ADJUST_UP)
        amount = F.replace(F.try_element_at(amounts, F.lit(-1)), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
        label = F.regexp_replace(F.trim(F.regexp_replace(line, r"[│\s]+", " ")), r"\s*[\d,]+\.\d{2}\s*$", "")
        return F.when((F.size(amounts) > 0) & (down | up) & amount.isNotNull(), F.struct(F.substring(label, 1, 60).alias("label"), F.when(down, -amount).otherwise(amount).cast("decimal(18,2)").alias("amount")))

    return F.array_distinct(F.filter(F.transform(lines, candidate), lambda x: x.isNotNull()))


def bridging(base: Column, target: Column, candidates: Column) -> Column:
    """The smallest subset of the adjustments that leads from `base` to `target`; null if none, or if there are too many.

    Subsets go by size, then by the order of their members. One fold makes all
    of them with their sums: of each candidate, every subset so far with and without it.
    """
    k = F.size(candidates)
    kind = "array<struct<n:int,at:array<int>,total:decimal(28,2)>>"
    none = F.array(F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"), F.lit(0).cast("decimal(28,2)").alias("total"))).cast(kind)

    def grown(sets, i):
        amount = F.get(candidates, i)["amount"]
        more = F.transform(sets, lambda s: F.struct((s["n"] + 1).alias("n"), F.array_append(s["at"], i).alias("at"), (s["total"] + amount).cast("decimal(28,2)").alias("total")))
        return F.concat(sets, more).cast(kind)

    sets = F.aggregate(F.sequence(F.lit(0), k - 1), none, grown)
    fits = F.filter(sets, lambda s: (s["n"] > 0) & (F.abs(base + s["total"] - target) <= tolerance()))
    best = F.array_min(F.transform(fits, lambda s: F.struct(s["n"], s["at"])))["at"]
    return F.when(k.between(1, t.MAX_ADJUSTMENTS), F.transform(best, lambda i: F.get(candidates, i)))


#: Rules of documents that their totals decide.
TOTAL_RULES = ("MULTI_INVOICE_TOTAL_SPLIT", "HEADER_LINE_TOTAL", "LINE_ITEMS_INCOMPLETE")


def totals(documents: DataFrame) -> tuple[DataFrame, list[Check]]:
    """`documents` (header fields, invoice_text, n_items, n_amounts, line_sum) with `total`, `bridge` and `reached`, and their checks.

    The printed adjustments are read once, and only where the sums do not meet.
    """
    d = documents.withColumn("total", v.header_total("invoice_total", "invoice_number"))
    gap = F.abs(F.col("line_sum") - F.col("total"))
    apart = F.coalesce(gap > tolerance(), F.lit(False))
    d = d.withColumn("candidates", F.when(apart, adjustments("invoice_text")))
    d = d.withColumn("bridge", F.when(F.size("candidates") > 0, bridging(F.col("line_sum"), F.col("total"), F.col("candidates")))).drop("candidates")
    bridged = F.aggregate(F.col("bridge"), F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["amount"]).cast("decimal(28,2)"))
    d = d.withColumn("reached", F.when(F.col("bridge").isNotNull(), F.col("line_sum") + bridged).otherwise(F.col("line_sum")))
    numbers, amounts = F.size(v.parts("invoice_number")), F.size(v.parts("invoice_total"))
    several = F.when((numbers > 1) & v.filled("invoice_total").isNotNull() & (numbers != amounts), "ERROR")
    split = Check(3, "MULTI_INVOICE_TOTAL_SPLIT", several, field="invoice_total", expected=say(numbers, " totals joined by ' / '"), actual=F.col("invoice_total"), says={"ERROR": say("invoice_number names ", numbers, " invoices (", F.col("invoice_number"), "), invoice_total has ", amounts, " (", F.col("invoice_total"), "); copy each invoice's own printed total, in the same order")})
    known = F.coalesce((F.col("n_amounts") > 0) & F.col("total").isNotNull() & (F.col("n_amounts") == F.col("n_items")), F.lit(False))
    met = (gap <= tolerance()) | F.col("bridge").isNotNull()
    short = F.coalesce(known & (F.col("total") - F.col("line_sum") > tolerance()) & F.col("bridge").isNull(), F.lit(False))
    status = F.when(short, None).when(~known, "NOT_CHECKED").when(met, "PASS").otherwise("ERROR")
    reached, total = F.col("reached"), F.col("total")
    labels = F.array_join(F.transform(F.col("bridge"), lambda x: F.concat(x["label"], F.lit(" "), x["amount"].cast("string"))), ", ")
    says = {
        "NOT_CHECKED": F.when(total.isNull() | (F.col("n_amounts") == 0), "no total or no line amounts to compare").otherwise(say(F.col("n_items") - F.col("n_amounts"), " of ", F.col("n_items"), " items have no line amount")),
        "PASS": F.when(F.col("bridge").isNotNull(), say("the items' ", text(F.col("line_sum")), " become ", text(total), " by what is printed: ", labels)).otherwise(""),
        "ERROR": say("the items add up to ", text(reached), ", the header says ", text(total), ", ", text(F.abs(reached - total)), " less: the document itself may be wrong, so a person should look"),
    }
    whole = Check(3, "HEADER_LINE_TOTAL", status, field="invoice_total", expected=F.when(known, text(reached)), actual=F.when(known, text(total)), difference=F.when(known, F.abs(reached - total)), says=says)
    missing = Check(3, "LINE_ITEMS_INCOMPLETE", F.when(short, "ERROR"), field="line_items", expected=text(total), actual=text(F.col("line_sum")), difference=gap, says={"ERROR": say(F.col("n_amounts"), " items add up to ", text(F.col("line_sum")), ", ", text(gap), " short of the printed ", text(total), ": rows of the table are missing or misread, look on every page")})
    return d, [split, whole, missing]


def packages(shipment: str) -> list[Check]:
    """Over documents with n_packages, package_sum and package_same (all equal to the header's)."""
    if not _has(shipment, "total_packages"):
        return []
    head = v.strict("total_packages")
    fits = (F.col("package_sum") == head) | F.col("package_same")
    status = F.when(head.isNull(), None).when(F.col("n_packages") == 0, "NOT_CHECKED").when(fits, "PASS").otherwise("WARNING")
    says = {"NOT_CHECKED": F.lit("no item counts packages"), "WARNING": say("the items count ", text(F.col("package_sum")), " packages, the header ", text(head))}
    return [Check(5, "PACKAGE_COUNT_CONSISTENCY", status, field="total_packages", expected=F.when(F.col("n_packages") > 0, text(head)), actual=F.when(status == "WARNING", text(F.col("package_sum"))), says=says)]


# --- whole validation ----------------------------------------------------------


def _with_columns(df: DataFrame, names) -> DataFrame:
    return df.select(*df.columns, *[F.lit(None).cast("string").alias(n) for n in names if n not in df.columns])


def with_header(items: DataFrame, headers: DataFrame, needs: Collection[str] = tuple(NEEDS.values()), firsts: bool = True) -> DataFrame:
    """Items with h_ columns of their headers, and whether an item is the first of its order number, as far as needed.

    Order numbers are read from a header's text once, not once for each item. Without `firsts` every item counts as
    the first of its number, and who asks picks the first ones out later: finding them here sorts all items once more.
    """
    own = _with_columns(items, ITEM_COLUMNS)
    if not needs:
        return own
    head = _with_columns(headers, (*t.HEADER_FIELDS, "invoice_text"))
    columns = {"orders": v.all_labelled(t.ORDER_LABELS, "invoice_text")}
    head = head.select("doc_id", *[columns.get(c, F.col(c) if c in head.columns else F.lit(None)).alias(f"h_{c}") for c in needs])
    if "orders" in needs and not firsts:
        own = own.withColumn("first_order", F.lit(True))
    elif "orders" in needs:
        # The first item of an order number: items are read once, and a document's lie together for the join anyway.
        least = F.min("pos").over(Window.partitionBy("doc_id", "__order"))
        own = own.withColumn("__order", v.token("order_number")).withColumn("first_order", F.coalesce((F.col("__order") != "") & (F.col("pos") == least), F.lit(False))).drop("__order")
    return own.join(head, "doc_id", "left")


def exploded(df: DataFrame, checks: list[Check], fields: Sequence[str] = FIELDS) -> DataFrame:
    """(doc_id, `fields` of findings, retryable), one row for each finding.

    The array is made by a projection of its own, which Spark compiles; in the explosion, or inside a function on arrays, it would be interpreted. A plain explosion would have it filtered by its size first, and so made twice.
    """
    fields = [f for f in FIELDS if f in (*fields, "rule", "status")]
    found = df.select("doc_id", F.array(*[c.column(fields) for c in checks]).alias("c")).select("doc_id", F.explode_outer("c").alias("c")).filter(F.col("c").isNotNull()).select("doc_id", "c.*")
    return found.withColumn("retryable", (F.col("status") == "ERROR") & F.col("rule").isin(*t.RETRYABLE))


def item_checks(items: DataFrame, headers: DataFrame, shipment: str = "export", rules: Collection[str] = tuple(ITEM_RULES), fields: Sequence[str] = FIELDS) -> DataFrame:
    """Findings on items by the rules asked for."""
    made = Made(with_header(items, headers, [need for name, need in NEEDS.items() if name in rules]))
    checks = [c for name, build in ITEM_RULES.items() if name in rules for c in build(shipment, made)]
    return exploded(made.rows(), checks, fields)


def document_sums(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Headers with their items' counts and sums."""
    own = _with_columns(items, ITEM_COLUMNS)
    amount, pack = v.strict("line_amount"), v.strict("total_packages")
    sums = own.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.count(amount).alias("n_amounts"), F.sum(amount).cast("decimal(28,6)").alias("line_sum"), F.count(pack).alias("n_packages"),
        F.sum(pack).cast("decimal(28,6)").alias("package_sum"), F.min(pack).alias("package_min"), F.max(pack).alias("package_max"),
    )
    head = _with_columns(headers, (*t.HEADER_FIELDS, "invoice_text"))
    d = head.join(sums, "doc_id", "left").fillna(0, ["n_items", "n_amounts", "n_packages"])
    n = v.strict("total_packages")
    return d.withColumn("package_same", F.coalesce((F.col("package_min") == n) & (F.col("package_max") == n), F.lit(False)))


#: Rules of documents, in the order of their findings.
DOCUMENT_RULES = (*TOTAL_RULES, "TAX_RECONCILIATION", "PACKAGE_COUNT_CONSISTENCY", "FORMAT_TYPE", "REQUIRED_FIELD_MISSING")


def _judged(items: DataFrame, headers: DataFrame, shipment: str, rules: Collection[str]) -> tuple[DataFrame, list[Check]]:
    """Documents, and their checks by the rules asked for; items are summed up only for those that need it."""
    summed = any(r in rules for r in (*TOTAL_RULES, "PACKAGE_COUNT_CONSISTENCY"))
    d = document_sums(items, headers) if summed else _with_columns(headers, (*t.HEADER_FIELDS, "invoice_text"))
    made = []
    if any(r in rules for r in TOTAL_RULES):
        d, made = totals(d)
    if shipment != "export":
        made.append(Check(4, "TAX_RECONCILIATION", F.lit("NOT_CHECKED"), says={"NOT_CHECKED": F.lit("the sheet has no tax columns")}))
    if "PACKAGE_COUNT_CONSISTENCY" in rules:
        made += packages(shipment)
    made += header_format(shipment)
    return d, [c for c in made if c.rule in rules]


def document_checks(items: DataFrame, headers: DataFrame, shipment: str = "export", rules: Collection[str] = DOCUMENT_RULES, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Findings on documents by the rules asked for."""
    return exploded(*_judged(items, headers, shipment, rules), fields)


def validate(items: DataFrame, headers: DataFrame, shipment: str = "export", fields: Sequence[str] = FIELDS) -> DataFrame:
    """All findings of all documents."""
    return item_checks(items, headers, shipment, fields=fields).unionByName(document_checks(items, headers, shipment, fields=fields))


def verdicts(checks: DataFrame) -> DataFrame:
    """(doc_id, valid, status, n_errors, n_warnings, n_passed, n_not_checked, n_retryable) of each document."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = checks.groupBy("doc_id").agg(n("ERROR").alias("n_errors"), n("WARNING").alias("n_warnings"), n("PASS").alias("n_passed"), n("NOT_CHECKED").alias("n_not_checked"), F.count_if("retryable").alias("n_retryable"))
    return out.select("doc_id", (F.col("n_errors") == 0).alias("valid"), F.when(F.col("n_errors") == 0, "VALID").otherwise("INVALID").alias("status"), "n_errors", "n_warnings", "n_passed", "n_not_checked", "n_retryable")


def _results(whole: DataFrame) -> DataFrame:
    """The results of documents from (doc_id, checks), their checks in order."""
    of = lambda s: F.filter("checks", lambda c: c["status"] == s)
    # The errors are picked out once, before what is told of them.
    picked = whole.select("doc_id", of("ERROR").alias("errors"), of("WARNING").alias("warnings"), "checks", F.transform(of("PASS"), lambda c: c["rule"]).alias("passed_rules"))
    valid = F.size("errors") == 0
    return picked.select("doc_id", valid.alias("valid"), F.when(valid, "VALID").otherwise("INVALID").alias("status"), "errors", "warnings", "checks", "passed_rules")


def result_documents(checks: DataFrame) -> DataFrame:
    """One row a document: valid, status, and arrays of its errors, warnings, all checks and passed rules, in order.

    Differences are floating-point numbers here, as results are written to JSON.
    """
    item = F.struct(*[F.col(f).cast("double").alias(f) if f == "difference" else f for f in RESULT_FIELDS])
    return _results(checks.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("checks")))


def _item_findings(items: DataFrame, headers: DataFrame, shipment: str) -> DataFrame:
    """(doc_id, of_items): the findings on its items, not in order. Of each order number only the first item is judged by it."""
    made = Made(with_header(items, headers, firsts=False))
    checks = [c for build in ITEM_RULES.values() for c in build(shipment, made)]
    orders = [c for c in checks if c.rule == "ORDER_NUMBER_SOURCE_MATCH"]
    found = made.rows().select("doc_id", "pos", made.token("order_number").alias("number"), F.array(*[c.result() for c in checks if c not in orders]).alias("found"), *[c.result().alias("order") for c in orders])
    numbered = F.when(F.col("order").isNotNull() & F.col("pos").isNotNull(), F.struct("number", "pos", "order"))
    d = found.select("doc_id", "found", numbered.alias("numbered")).groupBy("doc_id").agg(F.collect_list("found").alias("found"), F.sort_array(F.collect_list("numbered")).alias("numbered"))
    kind = d.schema["numbered"].dataType.elementType["order"].dataType.simpleString()
    fold = f"struct<number:string,pos:int,kept:array<{kind}>>"
    none = F.struct(F.lit(None).alias("number"), F.lit(None).alias("pos"), F.array().alias("kept")).cast(fold)
    later = lambda a, x: F.coalesce((a["number"] == x["number"]) & (a["pos"] < x["pos"]), F.lit(False))
    kept = F.aggregate("numbered", none, lambda a, x: F.when(later(a, x), a).otherwise(F.struct(x["number"], x["pos"], F.array_append(a["kept"], x["order"])).cast(fold)), lambda a: a["kept"])
    return d.select("doc_id", F.concat(F.flatten("found"), kept).alias("of_items"))


def validation_results(items: DataFrame, headers: DataFrame, shipment: str = "export") -> DataFrame:
    """`result_documents` of all that `validate` finds, made where a document's items and header lie.

    Findings are many times as large as what they are made from, so they are collected by document at once: none
    becomes a row that is shuffled or sorted. Items without a document's key meet headers without one, which no join does.
    """
    keyed = F.col("doc_id").isNotNull()
    of_items = _item_findings(items.filter(keyed), headers.filter(keyed), shipment)
    d, checks = _judged(items.filter(keyed), headers.filter(keyed), shipment, DOCUMENT_RULES)
    of_header = d.select("doc_id", F.array(*[c.result() for c in checks]).alias("found")).groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("of_header"))
    both = of_items.join(of_header, "doc_id", "full")
    found = F.concat(*[F.coalesce(c, F.array()) for c in ("of_items", "of_header")])
    whole = both.select("doc_id", F.sort_array(F.array_compact(found)).alias("checks"))
    return _results(whole).unionByName(result_documents(validate(items.filter(~keyed), headers.filter(~keyed), shipment)))
