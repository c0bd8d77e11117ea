"""Repairs of extracted values by what the document itself prints.

Nothing is invented: a value changes only to a figure on the item's own printed
row, or elsewhere on the document where that is what the rule says. Each operator
returns its frame with notes of what it changed; charge rows go.

Raw items here: doc_id, pos, product_description, part_number, hsn_code, quantity,
unit_price, line_total (texts). Texts: doc_id, text.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _parser as regex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import values as v
from . import text as tx



def _cent() -> Column:
    return F.lit("0.01").cast("decimal(18,6)")


def hsn_on_row(rows: Column) -> Column:
    """The only HSN printed on an item's lines; codes with spaces count first."""
    spaced, plain = (F.flatten(F.transform(rows, lambda x: F.regexp_extract_all(x, F.lit(p), F.lit(1)))) for p in (t.HSN_SPACED, t.HSN_PLAIN))
    one = lambda codes: F.when(F.size(F.array_distinct(F.transform(codes, lambda x: F.replace(x, F.lit(" "), F.lit(""))))) == 1, F.array_min(codes))
    return F.when(F.size(spaced) > 0, one(spaced)).otherwise(one(plain))


def fused_hsn(raw, text) -> Column:
    """The code that follows a fused item number of one to four digits, where the text (its spaces single) prints it."""
    s = F.trim(F.regexp_replace(F.regexp_replace(v.col(raw), r"[^\d ]", " "), r"\s+", " "))
    lead, rest = F.substring_index(s, " ", 1), F.regexp_extract(s, r"^\d+ (.+)$", 1)
    fits = (rest != "") & (F.length(lead) <= 4) & F.length(F.replace(rest, F.lit(" "), F.lit(""))).isin(4, 6, 8)
    return F.when(fits & F.coalesce(v.col(text), F.lit("")).contains(rest), rest)


def home_hsn(raw, lines) -> Column:
    """The 8-digit code that the line of a 10-digit one prints with dots, if one with the same first six digits is the only one."""
    digits = F.regexp_replace(v.col(raw), r"\D", "")
    rows = F.filter(v.col(lines), lambda x: x.contains(F.trim(v.col(raw))))
    found = F.array_distinct(F.flatten(F.transform(rows, lambda x: F.regexp_extract_all(x, F.lit(r"((?<![\d.])\d{4}\.\d{2}\.\d{2}(?![\d.]))"), F.lit(1)))))
    same = F.filter(found, lambda x: F.substring(F.replace(x, F.lit("."), F.lit("")), 1, 6) == F.substring(digits, 1, 6))
    return F.when((F.length(digits) == 10) & (F.size(same) == 1), F.get(same, F.lit(0)))


# Steps of `line_items`. Their frame has items with what `with_texts` adds: nothing of it is shuffled, as a step joins nothing.


def with_texts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """`items` with their document's lines, which of those are theirs (text.with_lines), its text with single spaces and its numbers."""
    arrays = tx.line_arrays(texts.select("doc_id", "text")).withColumns({"__spaced": F.regexp_replace("text", r"\s+", " "), "__printed": v.numbers_in("text")})
    return tx.with_lines(items, arrays)


def without_charge_rows(d: DataFrame) -> DataFrame:
    """Without items that are a charge printed once below the table: a line that begins with its first word and holds one amount."""
    name = F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("product_description", F.lit("")), "[^A-Za-z ]+", " "), r"\s+", " ")))
    begins = F.concat(F.lit("(?i)^"), F.substring_index(name, " ", 1), F.lit(r"\b"))
    lines = F.transform("__lines", lambda x: F.trim(F.regexp_replace(x, r"[│\s]+", " ")))
    return d.filter(~F.coalesce(name.rlike(t.CHARGE_ROW) & F.exists(lines, lambda x: F.rlike(x, begins) & (F.regexp_count(x, F.lit(t.MONEY)) == 1)), F.lit(False)))


def hsn_codes(d: DataFrame) -> DataFrame:
    """With hsn_code repaired and hsn_note: fused, row or home."""
    digits = F.length(F.regexp_replace(F.coalesce("hsn_code", F.lit("")), r"\D", ""))
    open_ = (digits > 0) & ~digits.isin(4, 6, 8)
    d = d.withColumns({"__a": F.when(open_, fused_hsn("hsn_code", "__spaced")), "__b": F.when(digits.between(1, 3), hsn_on_row(F.transform("__at", tx.line_at))), "__c": F.when(open_, home_hsn("hsn_code", "__lines"))})
    note = F.when(F.col("__a").isNotNull(), "fused").when(F.col("__b").isNotNull(), "row").when(F.col("__c").isNotNull(), "home")
    return d.withColumns({"hsn_note": note, "hsn_code": F.coalesce("__a", "__b", "__c", "hsn_code")}).drop("__a", "__b", "__c")


def price_printed(price: Column, amounts: Column, block: Column) -> Column:
    """As money, or in cents as bare digits."""
    cents = F.bround(price * 100, 0).cast("decimal(18,0)").cast("string")
    return F.array_contains(amounts, price) | F.rlike(block, F.concat(F.lit(r"(?<![\d.,])"), cents, F.lit(r"(?![\d.,])")))


def shifted_prices(d: DataFrame) -> DataFrame:
    """With unit_price and line_total replaced by the one pair its row prints (the amount twice), and price_note."""
    d = d.withColumns({"__q": v.loose_decimal("quantity"), "__p": v.loose_decimal("unit_price"), "__a": v.loose_decimal("line_total")})
    q, p, a = F.col("__q"), F.col("__p"), F.col("__a")
    known = (q > 0) & p.isNotNull() & a.isNotNull()
    d = d.withColumn("__blocks", F.when(known, F.transform("__at", tx.block_at)))
    d = d.withColumn("__blocks", F.transform("__blocks", lambda x: F.struct(x.alias("block"), v.money_in(x).alias("m"))))
    cents = lambda x: x.cast("decimal(18,2)")
    right = (p == cents(p)) & (F.abs(q * p - a) <= _cent()) & F.exists("__blocks", lambda x: F.array_contains(x["m"], cents(p)) & F.array_contains(x["m"], cents(a)))

    def fits(x: Column) -> Column:
        twice = F.filter(F.array_distinct(x["m"]), lambda y: F.size(F.filter(x["m"], lambda z: z == y)) >= 2)
        made = F.transform(twice, lambda y: F.struct(cents(F.bround(y / q, 2)).alias("price"), y.alias("amount")))
        return F.filter(made, lambda y: ((y["price"] != y["amount"]) | (q == 1)) & (F.bround(y["price"] * q, 2) == y["amount"]) & price_printed(y["price"], x["m"], x["block"]))

    d = d.withColumn("__fits", F.when(~F.coalesce(right, F.lit(False)), F.array_distinct(F.flatten(F.transform("__blocks", fits)))))
    d = d.withColumn("__new", F.when(F.size("__fits") == 1, F.get("__fits", F.lit(0))))
    change = F.coalesce((F.col("__new.price") != p) | (F.col("__new.amount") != a), F.lit(False))
    new = lambda c, old: F.when(change, F.col(c).cast("string")).otherwise(F.col(old))
    return d.withColumns({"price_note": F.when(change, "shifted"), "unit_price": new("__new.price", "unit_price"), "line_total": new("__new.amount", "line_total")}).drop("__q", "__p", "__a", "__blocks", "__fits", "__new")


def unprinted_amounts(d: DataFrame) -> DataFrame:
    """With a line_total that the document does not print replaced by quantity times price, where it prints that; and amount_note."""
    d = d.withColumns({"__q": v.loose_decimal("quantity"), "__p": v.loose_decimal("unit_price"), "__a": v.loose_decimal("line_total")})
    q, p, a = F.col("__q"), F.col("__p"), F.col("__a")
    expected = F.bround(q * p, 2).cast(v.DECIMAL)
    change = F.coalesce((q > 0) & (p > 0) & (F.abs(expected - a) > _cent()) & ~F.array_contains("__printed", a) & F.array_contains("__printed", expected), F.lit(False))
    return d.withColumns({"amount_note": F.when(change, "unprinted"), "line_total": F.when(change, expected.cast("decimal(18,2)").cast("string")).otherwise(F.col("line_total"))}).drop("__q", "__p", "__a")


def line_items(items: DataFrame, texts: DataFrame) -> DataFrame:
    """All item repairs in their order: charge rows, HSN codes, shifted prices, unprinted amounts."""
    d = unprinted_amounts(shifted_prices(hsn_codes(without_charge_rows(with_texts(items, texts)))))
    return d.select("doc_id", *[c for c in items.columns if c != "doc_id"], "hsn_note", "price_note", "amount_note")


# --- headers ------------------------------------------------------------------------


#: Formats without three letters in a row that a name must have are tried on every name; they are broadcast up to this number.
BROADCAST_FORMATS = 10_000


def literals(pattern: str) -> list[str]:
    """Lower-case strings of three letters or more that every match of a pattern holds; none where that cannot be told."""
    out, run = [], []

    def close():
        if len(run) >= 3:
            out.append("".join(run).lower())
        run.clear()

    def walk(parsed):
        for op, value in parsed:
            if op is regex.LITERAL:
                run.append(chr(value))
            elif op is regex.SUBPATTERN:
                walk(value[-1])
            elif op in (regex.MAX_REPEAT, regex.MIN_REPEAT, regex.POSSESSIVE_REPEAT):
                close()
                if value[0]:  # once at least, but what follows need not follow the first time
                    walk(value[2])
                    close()
            elif op is not regex.AT:
                close()

    try:
        walk(regex.parse(pattern))
    except (re.error, OverflowError):
        return []
    close()
    return out


#: Lengths of the strings by which names and patterns meet: a literal is looked for by those of its pieces that have the greatest length it holds.
PIECES = (3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def _pieces(text: Column, lengths) -> Column:
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in lengths])) if lengths else F.array().cast("array<string>")


def fitting_formats(names: DataFrame, rules: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows of `names` with the rows of `rules` whose pattern is found in the name."""
    return tried_formats(names, rules, name, pattern).filter(F.rlike(F.col(name), F.col(pattern)))


def tried_formats(names: DataFrame, rules: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows of `names` with the rows of `rules` whose pattern may be found in the name.

    An index of the strings that patterns need: each pattern waits for the one of its pieces (long ones
    where it has a long string, so that names alike in every three letters are told apart) that fewest
    names have, and is tried on those names alone. A pattern of which no name has some piece fits none.
    """

    @F.pandas_udf("array<string>")
    def needed(patterns: pd.Series) -> pd.Series:
        def of(p):
            cut = [(w, max(n for n in PIECES if n <= len(w))) for w in literals(p)]
            return sorted({w[i : i + n] for w, n in cut for i in range(len(w) - n + 1)})

        return patterns.map(of)

    keyed = rules.withColumn("__need", needed(F.col(pattern)))
    told = keyed.agg(F.count_if(F.size("__need") == 0).alias("rest"), F.array_distinct(F.flatten(F.collect_set(F.transform("__need", lambda x: F.length(x))))).alias("lengths")).first()
    found = []
    if told["lengths"]:
        known = names.withColumn("__gram", F.explode(_pieces(F.lower(F.col(name)), sorted(told["lengths"]))))
        often = known.groupBy("__gram").agg(F.count("*").alias("__often"))
        waits = keyed.filter(F.size("__need") > 0).select(*rules.columns, F.explode("__need").alias("__gram")).join(often, "__gram", "left").groupBy(*rules.columns).agg(F.min(F.struct(F.coalesce("__often", F.lit(0)).alias("n"), F.col("__gram").alias("g"))).alias("__w"))
        met = known.join(waits.filter("__w.n > 0").select(*rules.columns, F.col("__w.g").alias("__gram")), "__gram").drop("__gram")
        found.append(met)
    if told["rest"] or not found:
        rest = keyed.filter(F.size("__need") == 0).drop("__need")
        found.append(names.crossJoin(F.broadcast(rest) if told["rest"] <= BROADCAST_FORMATS else rest))
    return reduce(lambda a, b: a.unionByName(b), found)


def supplier_numbers(headers: DataFrame, formats: DataFrame) -> DataFrame:
    """Invoice numbers whose prefix OCR misread, repaired by their supplier's format; and number_note.

    `formats`: supplier (pattern of the name), valid, misread (its first group is the core)
    and prefix. A part changes if its core is in the text. Patterns are tried on each distinct
    name that can fit them once; of several formats that fit a name the first by their patterns is taken.
    """
    wanted = ("supplier", "valid", "misread", "prefix")
    rules = formats.select(*[F.col(c).alias(f"__{c}") for c in wanted]).distinct()
    names = headers.select("supplier_name").filter(v.filled("supplier_name").isNotNull()).distinct()
    fits = fitting_formats(names, rules, "supplier_name", "__supplier")
    chosen = fits.groupBy("supplier_name").agg(F.min(F.struct(*[f"__{c}" for c in wanted])).alias("__f")).select("supplier_name", "__f.*")
    d = headers.join(chosen, "supplier_name", "left")
    core = lambda x: F.regexp_extract_all(x, F.col("__misread"), F.lit(1))[0]
    fix = lambda x: F.when(~F.rlike(x, F.col("__valid")) & F.rlike(x, F.col("__misread")) & F.col("invoice_text").contains(core(x)), F.concat(F.col("__prefix"), core(x))).otherwise(x)
    fixed = F.when(F.col("__valid").isNotNull() & v.filled("invoice_number").isNotNull(), F.array_join(F.transform(v.parts("invoice_number"), fix), " / ")).otherwise(F.col("invoice_number"))
    note = F.when(~fixed.eqNullSafe(F.col("invoice_number")), "supplier_format")
    return d.select(*[F.col(c) for c in headers.columns if c != "invoice_number"], fixed.alias("invoice_number"), note.alias("number_note"))


def collapsed_references(headers: DataFrame) -> DataFrame:
    """Combined invoice numbers that are one number read differently become one, with their dates and totals.

    Left alone if, within a group of equal keys, aligned dates or totals differ.
    The spelling with most letters stays, then the one printed most, then the first.
    """
    names, dates, sums = v.parts("invoice_number"), v.parts("invoice_date"), v.parts("invoice_total")
    d = headers.withColumns({"__n": names, "__k": F.transform(names, v.ocr_key), "__d": dates, "__t": sums})
    d = d.withColumns({"__da": F.size("__d") == F.size("__n"), "__ta": F.size("__t") == F.size("__n")})
    n = lambda i: F.get("__n", i)
    members = lambda k: F.filter(F.sequence(F.lit(0), F.size("__n") - 1), lambda i: F.get("__k", i) == k)
    one = lambda xs: F.size(F.array_distinct(xs)) == 1
    agrees = lambda k: (F.size(members(k)) == 1) | ((~F.col("__da") | one(F.transform(members(k), lambda i: F.get("__d", i)))) & (~F.col("__ta") | (one(F.transform(members(k), lambda i: v.loose(F.get("__t", i)))) & ~F.exists(members(k), lambda i: v.loose(F.get("__t", i)).isNull()))))
    keys = F.array_distinct("__k")
    change = (F.size("__n") > 1) & (F.size(keys) < F.size("__n")) & F.forall(keys, agrees)
    rank = lambda i: F.struct(F.length(F.regexp_replace(n(i), "[^A-Za-z]", "")).alias("a"), F.size(F.split(F.coalesce("invoice_text", F.lit("")), F.concat(F.lit(r"\Q"), n(i), F.lit(r"\E")), -1)).alias("b"), (-i).alias("c"))
    best = lambda k: n(-F.array_max(F.transform(members(k), rank))["c"])
    first = lambda column, k: F.get(column, F.array_min(members(k)))
    out = {"invoice_number": F.when(change, F.array_join(F.transform(keys, best), " / ")).otherwise(F.col("invoice_number"))}
    out["invoice_date"] = F.when(change & F.col("__da"), F.array_join(F.transform(keys, lambda k: first("__d", k)), " / ")).otherwise(F.col("invoice_date"))
    out["invoice_total"] = F.when(change & F.col("__ta"), F.array_join(F.transform(keys, lambda k: first("__t", k)), " / ")).otherwise(F.col("invoice_total"))
    return d.withColumns(out | {"collapsed": F.coalesce(change, F.lit(False))}).drop("__n", "__k", "__d", "__t", "__da", "__ta")


def header_values(headers: DataFrame, items: DataFrame, shipment: str = "export") -> DataFrame:
    """Header repairs from the text (invoice_text) and the items, after the references are collapsed; and header_notes, what changed.

    A net realisable amount goes without its phrase in the text. A total that is
    the FOB value gives way where that line is in rupees or the items contradict
    it. Packages come from the TOTAL line that holds the quantity after another
    number, else, where they are missing or equal the quantity, from the only
    smaller count of cartons. An export's foreign origin becomes the home country
    where the supplier is there and the origin is the destination.
    """
    amount, quantity = v.loose("line_total"), v.loose("quantity")
    sums = items.groupBy("doc_id").agg(F.count("*").alias("__rows"), F.count(amount).alias("__known"), F.sum(amount).alias("__sum"), F.sum(quantity).alias("__qty"))
    d = headers.join(sums, "doc_id", "left").withColumns({"__low": F.lower(F.coalesce("invoice_text", F.lit("")))} | {f"__{c}": F.col(c).cast("string") for c in NOTED})
    spoken = F.col("__low").rlike("net realis|net charge|realisable")
    d = d.withColumn("net_realisable_amount", F.when(spoken, F.col("net_realisable_amount")))
    total = v.loose("invoice_total")
    contradicts = F.coalesce((F.col("__rows") == F.col("__known")) & (F.abs(F.col("__sum") - total) > F.greatest(F.lit(1.0), total * 0.01)), F.lit(False))
    rows = F.split("__low", "\n")
    value = lambda x: F.replace(F.regexp_extract(x, t.FOB_VALUE, 1), F.lit(","), F.lit("")).try_cast("double")
    fob = F.get(F.filter(rows, lambda x: (value(x) > 0) & (F.abs(total - value(x)) <= F.greatest(F.lit(1.0), value(x) * 0.01))), F.lit(0))
    swap = F.coalesce((F.upper(F.trim(F.coalesce("currency", F.lit("")))) != "INR") & fob.isNotNull() & (fob.rlike(t.RUPEES) | contradicts), F.lit(False))
    d = d.withColumn("invoice_total", F.when(swap, F.col("net_realisable_amount").cast("string")).otherwise(F.col("invoice_total").cast("string")))
    lines = F.filter(F.split(F.coalesce("invoice_text", F.lit("")), r"\r\n|\n|\r"), lambda x: x.rlike(r"(?i)^\s*TOTAL\b"))
    numbers = F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda y: y.cast("double")))
    holding = F.filter(numbers, lambda x: F.array_contains(x, F.col("__qty")))
    after = F.get(F.filter(holding, lambda x: F.array_position(x, F.col("__qty")) > 1), F.lit(0))
    packs = v.loose("total_packages")
    current = F.when(F.coalesce(F.col("__qty") > 0, F.lit(False)) & (F.size(holding) > 0), F.get(after, F.lit(0))).otherwise(packs)
    counts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("invoice_text", F.lit("")), F.lit(t.CARTONS), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")))
    smaller = F.filter(counts, lambda x: (x > 0) & (x < F.col("__qty")))
    unsure = F.coalesce(F.col("__qty") > 0, F.lit(False)) & (current.isNull() | (current == F.col("__qty")))
    d = d.withColumn("total_packages", F.when(unsure & (F.size(smaller) == 1), F.get(smaller, F.lit(0))).otherwise(current))
    origin, target = v.home_country("country_of_origin"), v.home_country("country_of_destination")
    abroad = (F.lit(shipment) == "export") & F.lower(F.coalesce("supplier_address", F.lit(""))).rlike(rf"\b{t.HOME}\b") & (origin != "") & (origin != "IN") & ((origin == target) | (target == "IN"))
    d = d.withColumn("country_of_origin", F.when(abroad, "IN").otherwise(F.col("country_of_origin")))
    changed = [F.when(~F.col(c).cast("string").eqNullSafe(F.col(f"__{c}")) & ~(v.loose(c).isNotNull() & v.loose(c).eqNullSafe(v.loose(f"__{c}"))), note) for c, note in NOTED.items()]
    return d.withColumn("header_notes", F.array_compact(F.array(*changed))).drop("__rows", "__known", "__sum", "__qty", "__low", *[f"__{c}" for c in NOTED])


#: Header fields that repairs change, and the notes of that.
NOTED = {"net_realisable_amount": "net_amount_not_printed", "invoice_total": "total_is_fob_value", "total_packages": "packages_from_text", "country_of_origin": "origin_is_home"}

