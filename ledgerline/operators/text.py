"""Operators on layout text: pages, lines, table rows and their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import values as v


def page_array(text, ocr_headings: bool = False) -> Column:
    """The pages of a text, cut before each page heading; a text with fewer than two headings is one page."""
    text = v.col(text)
    cut = F.split(text, f"{t.PAGE_MARKER}|{t.OCR_PAGE_MARKER}" if ocr_headings else t.PAGE_MARKER)
    heading = r"^=+\s*PAGE\s+\d+\s+OF\s+\d+|^--- Page \d+ \(OCR\) ---" if ocr_headings else r"^=+\s*PAGE\s+\d+\s+OF\s+\d+"
    pages = F.filter(cut, lambda x: x.rlike(heading))
    return F.when(F.size(pages) > 1, pages).otherwise(F.array(text))


def pages(docs: DataFrame, text: str = "text", ocr_headings: bool = False) -> DataFrame:
    """(doc_id, page_no, page): page_no from 1."""
    return docs.select("doc_id", F.posexplode(page_array(text, ocr_headings)).alias("p", "page")).select("doc_id", (F.col("p") + 1).alias("page_no"), "page")


def page_chunks(paged: DataFrame, per_chunk: int = 2) -> DataFrame:
    """(doc_id, chunk_no, chunk): consecutive pages joined by a blank line."""
    keyed = paged.groupBy("doc_id", F.floor((F.col("page_no") - 1) / per_chunk).cast("int").alias("chunk_no"))
    return keyed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page"))), lambda x: x["page"]), "\n\n").alias("chunk"))


def is_transport_page(page) -> Column:
    """A waybill or bill of lading with at least two labels of its form."""
    page = v.col(page)
    return page.rlike(t.TRANSPORT) & (F.regexp_count(page, F.lit(t.TRANSPORT_FORM)) >= 2)


def without_transport_pages(text) -> Column:
    """The text without transport pages, unless none or all are such."""
    whole = page_array(text)
    kept = F.filter(whole, lambda p: ~is_transport_page(p))
    change = (F.size(whole) > 1) & (F.size(kept) > 0) & (F.size(kept) < F.size(whole))
    return F.when(change, F.array_join(kept, "")).otherwise(v.col(text))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): line_no from 0."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r")).alias("line_no", "line"))


def table_heading(page) -> Column:
    """The first line that names a quantity and an item column, with up to five lines after it that hold no data; '' if none."""
    rows = F.split(F.coalesce(v.col(page), F.lit("")), r"\r\n|\n|\r")
    is_head = lambda x: x.rlike(t.QTY_HEADING) & x.rlike(t.ITEM_HEADING) & ~x.rlike(r"^\s*\d")
    at = F.get(F.filter(F.transform(rows, lambda x, i: F.when(is_head(x), i)), lambda x: x.isNotNull()), F.lit(0))
    after = F.slice(rows, at + 2, F.lit(5))
    stop = F.get(F.filter(F.transform(after, lambda x, i: F.when(x.rlike(t.DATA_LINE), i)), lambda x: x.isNotNull()), F.lit(0))
    block = F.concat(F.array(F.get(rows, at)), F.filter(F.slice(after, F.lit(1), F.coalesce(stop, F.size(after))), lambda x: F.trim(x) != ""))
    return F.coalesce(F.when(at.isNotNull(), F.array_join(F.transform(block, lambda x: F.rtrim(x)), "\n")), F.lit(""))


def row_keys(part, description) -> Column:
    """What finds an item's printed row: its part number (4 or more characters), the first 20 characters of its description (8 or more)."""
    p = F.lower(F.trim(F.coalesce(v.col(part), F.lit(""))))
    d = v.squashed(F.coalesce(v.col(description), F.lit("")))
    return F.array_compact(F.array(F.when(F.length(p) >= 4, p), F.when(F.length(d) >= 8, F.substring(d, 1, 20))))


def _found(keys: Column, line: Column) -> Column:
    return F.exists(keys, lambda k: line.contains(k))


#: Items of a document from which on lines and items meet by the last characters of keys, not all with all.
MANY_ITEMS, GRAM = 200, 4


#: One pattern, so that a line is looked through once: blank, a row's start, a sum or a tariff code.
BLOCK_END = rf"^ *\z|(?:{t.ROW_START})|(?:{t.BLOCK_STOP})|(?:{t.HSN_SPACED})|(?:{t.HSN_PLAIN})"


def ends_block(line) -> Column:
    line = v.col(line)
    return line.isNull() | line.rlike(BLOCK_END)


def line_arrays(texts: DataFrame) -> DataFrame:
    """`texts` with __lines and, of each line, __plain (as keys are searched in) and __ends (it begins something else)."""
    d = texts.withColumn("__lines", F.split(F.coalesce(F.col("text"), F.lit("")), r"\r\n|\n|\r"))
    return d.withColumns({"__plain": F.transform("__lines", lambda x: v.squashed(x)), "__ends": F.transform("__lines", lambda x: ends_block(x))})


def _by_grams(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, pos, __at): a line meets only items whose key ends in GRAM characters that it has somewhere (keys are never shorter)."""
    grams = F.when(F.length("plain") >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("plain") - (GRAM - 1)), lambda i: F.substr(F.col("plain"), i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))
    asked = lines(texts).select("doc_id", "line_no", v.squashed("line").alias("plain")).withColumn("__gram", F.explode(grams))
    marked = items.select("doc_id", "pos", F.explode("__keys").alias("__key")).withColumn("__gram", F.substr("__key", F.lit(-GRAM), F.lit(GRAM)))
    met = asked.join(marked, ["doc_id", "__gram"]).filter(F.col("plain").contains(F.col("__key")))
    return met.groupBy("doc_id", "pos").agg(F.sort_array(F.collect_set("line_no")).alias("__at"))


def with_lines(items: DataFrame, arrays: DataFrame, how: str = "left") -> DataFrame:
    """`items` with what `arrays` has of their document, and __at: the numbers of the lines that hold a key of the item.

    Documents meet their items once, and each item is tried on the lines where it lies: no pair of them is a row. Documents of
    more than MANY_ITEMS items are counted first; if there are any, theirs are found by grams.
    """
    keyed = items.withColumn("__keys", row_keys("part_number", "product_description"))
    tried = F.filter(F.transform("__plain", lambda x, i: F.when(_found(F.col("__keys"), x), i)), lambda i: i.isNotNull())
    crowded = items.groupBy("doc_id").agg(F.count("*").alias("__n")).filter(F.col("__n") > MANY_ITEMS).select("doc_id")
    if crowded.isEmpty():
        return keyed.join(arrays, "doc_id", how).withColumn("__at", F.when(F.size("__keys") > 0, tried)).drop("__keys")
    own, texts = (d.join(crowded, "doc_id", "left_semi") for d in (keyed, arrays.select("doc_id", "text")))
    d = keyed.join(crowded.withColumn("__many", F.lit(True)), "doc_id", "left").join(arrays, "doc_id", how).join(_by_grams(own, texts).withColumnRenamed("__at", "__found"), ["doc_id", "pos"], "left")
    return d.withColumn("__at", F.when(F.col("__many"), F.col("__found")).when(F.size("__keys") > 0, tried)).drop("__keys", "__many", "__found")


def line_at(i: Column) -> Column:
    return F.get("__lines", i)


def block_at(i: Column) -> Column:
    """A line with up to two lines that continue it."""
    ends = lambda k: F.coalesce(F.get("__ends", k), F.lit(True))
    return F.when(ends(i + 1), line_at(i)).when(ends(i + 2), F.concat_ws("\n", line_at(i), line_at(i + 1))).otherwise(F.concat_ws("\n", line_at(i), line_at(i + 1), line_at(i + 2)))


def _met(items: DataFrame, texts: DataFrame) -> DataFrame:
    return with_lines(items.select("doc_id", "pos", "part_number", "product_description"), line_arrays(texts.select("doc_id", "text")), "inner")


def source_lines(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, line): the printed lines of each item. `items`: doc_id, pos, part_number, product_description."""
    found = F.transform("__at", lambda i: F.struct(i.alias("line_no"), line_at(i).alias("line")))
    return _met(items, texts).select("doc_id", "pos", F.inline(found))


def source_blocks(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, block): each printed line with up to two lines that continue it."""
    found = F.transform("__at", lambda i: F.struct(i.alias("line_no"), block_at(i).alias("block")))
    return _met(items, texts).select("doc_id", "pos", F.inline(found))


def item_blocks(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, pos, block): all blocks of an item as one text, in the order of their lines; items without any are left out."""
    return _met(items, texts).filter(F.size("__at") > 0).select("doc_id", "pos", F.array_join(F.transform("__at", block_at), "\n").alias("block"))


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, block): all blocks of an item as one text."""
    return blocks.groupBy("doc_id", "pos").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "block")))["block"], "\n").alias("block"))


def money_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, amount, n): how often each two-decimal amount is printed."""
    return docs.select("doc_id", F.explode(v.money_in(text)).alias("amount")).groupBy("doc_id", "amount").agg(F.count("*").alias("n"))


def word_quality(text) -> Column:
    """struct<n_words, ratio>: words with a letter or digit, and the share of those with two or more characters."""
    words = F.filter(F.split(F.coalesce(v.col(text), F.lit("")), r"\s+"), lambda w: w.rlike("[a-zA-Z0-9]"))
    long = F.filter(words, lambda w: F.length(w) >= 2)
    return F.struct(F.size(words).alias("n_words"), F.when(F.size(words) > 0, F.size(long) / F.size(words)).otherwise(0.0).alias("ratio"))


def looks_garbled(text) -> Column:
    q = word_quality(text)
    return (q["n_words"] >= 20) & (q["ratio"] < 0.5)
