"""Parsers and normalisers of single values, as column expressions.

Three number parsers differ in what they strip on purpose: `coerced` (currency
signs and commas), `loose` (commas), `strict` (nothing). All give null where the
text is no number; an empty text is null, 0 stays 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t

DECIMAL = "decimal(18,6)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c) -> Column:
    """Null for an empty or blank text."""
    c = col(c).cast("string")
    return F.when(F.trim(c) != "", c)


def unwrapped(c) -> Column:
    """The value inside a JSON object {"value": ...}, or the text itself."""
    c = col(c)
    inner = F.get_json_object(c, "$.value")
    return F.when(F.trim(c).startswith("{") & c.contains('"value"'), inner).otherwise(c)


def coerced(c) -> Column:
    return F.trim(F.translate(F.trim(col(c).cast("string")), "$€£₹,", "")).try_cast(DECIMAL)


def loose(c) -> Column:
    c = F.trim(F.replace(col(c).cast("string"), F.lit(","), F.lit("")))
    return F.when(~c.rlike("(?i)^(true|false)$"), c.try_cast("double"))


def loose_decimal(c) -> Column:
    c = F.trim(F.replace(col(c).cast("string"), F.lit(","), F.lit("")))
    return c.try_cast(DECIMAL)


def strict(c) -> Column:
    c = col(c).cast("string")
    return F.when(c != "", c.try_cast(DECIMAL))


def parts(c) -> Column:
    """A combined value's parts: cut at slashes with a space on at least one side."""
    cut = F.split(F.coalesce(col(c).cast("string"), F.lit("")), t.COMBINED)
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def token(c) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\s+", ""))


def description_key(c) -> Column:
    plain = F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def ocr_key(c) -> Column:
    """Equal for references that OCR confuses: I and L with 1, O with 0."""
    return F.regexp_replace(F.translate(F.upper(col(c)), "ILO", "110"), "[^A-Z0-9]", "")


def squashed(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), r"[│|\s]+", " ")))


def is_gstin(c) -> Column:
    return F.coalesce(col(c).rlike(t.GSTIN), F.lit(False))


def repaired_gstin(c) -> Column:
    v = F.replace(F.upper(F.trim(col(c))), F.lit(" "), F.lit(""))
    return F.when((F.length(v) == 16) & ~v.rlike(t.GSTIN) & F.substring(v, 1, 15).rlike(t.GSTIN), F.substring(v, 1, 15)).otherwise(v)


def is_ad_code(c) -> Column:
    c = col(c)
    return F.coalesce(c.rlike(t.AD_CODE) & (F.length(F.replace(c, F.lit("-"), F.lit(""))) == 14), F.lit(False))


def repaired_ad_code(c) -> Column:
    """Every other character, where that is a code and the whole is not (doubled glyphs)."""
    v = F.trim(col(c))
    half = F.array_join(F.filter(F.split(v, ""), lambda x, i: i % 2 == 0), "")
    return F.when(~is_ad_code(v) & is_ad_code(half), half).otherwise(v)


def currency(c) -> Column:
    s = F.trim(col(c))
    key = F.upper(F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), r"\s+", " "))
    names = F.create_map(*[F.lit(x) for pair in t.CURRENCY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, key), F.when(s.rlike("^[A-Za-z]{3}$"), F.upper(s)), s)


def country(c) -> Column:
    up = F.upper(F.trim(col(c)))
    return F.when(up.isin("INDIA", "IND"), "IN").when(up.isin("USA", "UNITED STATES", "UNITED STATES OF AMERICA"), "USA").otherwise(col(c))


def home_country(c) -> Column:
    up = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(up.isin("INDIA", "IND", "IN"), "IN").otherwise(up)


def state_digits(c) -> Column:
    """Digits in parentheses, else the first that stand alone, else the text."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    found = F.coalesce(filled(F.regexp_extract(s, r"\((\d{1,2})\)", 1)), filled(F.regexp_extract(s, r"\b(\d{1,2})\b", 1)))
    return F.coalesce(found, s)


def parsed_date(c) -> Column:
    s = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in t.DATE_FORMATS])


def without_tariff_tail(c) -> Column:
    head = F.trim(F.regexp_extract(col(c), t.TARIFF_TAIL, 1))
    return F.when(head != "", head).otherwise(col(c))


def header_total(total, number) -> Column:
    """A single number, or the sum of a combined total's parts where the invoice number is combined too."""
    numbers = F.filter(F.transform(parts(total), lambda x: x.try_cast(DECIMAL)), lambda x: x.isNotNull())
    added = F.aggregate(numbers, F.lit(0).cast("decimal(28,6)"), lambda a, x: (a + x).cast("decimal(28,6)"))
    return F.coalesce(strict(total).cast("decimal(28,6)"), F.when((F.size(parts(number)) > 1) & (F.size(numbers) > 0), added))


def first_labelled(patterns, c) -> Column:
    return F.coalesce(*[F.when(F.coalesce(col(c), F.lit("")).rlike(p), F.regexp_extract(F.coalesce(col(c), F.lit("")), p, 1)) for p in patterns])


def all_labelled(patterns, c) -> Column:
    """All labelled values, first seen first; those that differ only in case or spaces count once."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(p), F.lit(1)) for p in patterns])
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: token(y) == token(x)))


def numbers_in(c) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(t.NUMBER), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast(DECIMAL)), lambda x: x.isNotNull()))


def money_value(token_column) -> Column:
    """The amount of a printed two-decimal figure, in either decimal convention."""
    x = col(token_column)
    whole = F.regexp_replace(F.substring(x, F.lit(1), F.length(x) - 3), "[.,]", "")
    return F.concat(whole, F.lit("."), F.substring(x, -2, 2)).try_cast("decimal(18,2)")


def money_in(c) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(t.MONEY), F.lit(1))
    return F.filter(F.transform(found, money_value), lambda x: x.isNotNull())


def display(c) -> Column:
    return F.coalesce(unwrapped(c), F.lit(""))


def column_type(name) -> Column:
    """string or number, from a template column's name."""
    low = F.lower(col(name))
    hint = low.rlike("|".join(t.NUMBER_HINTS))
    return F.when(low.isin(*t.ALWAYS_STRING) | low.contains("date"), "string").when(hint, "number").otherwise("string")


def column_alias(name) -> Column:
    words = F.filter(F.split(F.replace(col(name), F.lit("_"), F.lit(" ")), r"\s+"), lambda x: x != "")
    names = F.create_map(*[F.lit(x) for pair in t.ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(names, F.lower(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")


def token_cost(model, input_tokens, cached_tokens, output_tokens) -> Column:
    """struct of counts and cost; unknown models take the default price."""
    known = F.create_map(*[x for m, a, b, c in t.PRICES for x in (F.lit(m), F.struct(F.lit(a).alias("i"), F.lit(b).alias("c"), F.lit(c).alias("o")))])
    price = F.coalesce(F.try_element_at(known, col(model)), F.try_element_at(known, F.lit(t.PRICES[-1][0])))
    fresh = F.greatest(F.lit(0), col(input_tokens) - col(cached_tokens))
    usd = fresh / 1e6 * price["i"] + col(cached_tokens) / 1e6 * price["c"] + col(output_tokens) / 1e6 * price["o"]
    return F.struct(fresh.cast("long").alias("input_tokens"), col(cached_tokens).cast("long").alias("cached_input_tokens"), col(output_tokens).cast("long").alias("output_tokens"), (col(input_tokens) + col(output_tokens)).cast("long").alias("total_tokens"), F.round(usd, 6).alias("cost_usd"), F.round(usd * t.USD_TO_INR, 4).alias("cost_inr"))


def is_reasoning_model(model) -> Column:
    return col(model).rlike(t.REASONING_MODELS)
