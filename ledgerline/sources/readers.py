"""Connectors to what lies outside Spark: page readers and OCR, behind one interface, each optional.

A reader turns the bytes of a document into page texts. Nothing here is needed by
the operators, which start from texts, words or segments in tables.
"""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import layout
from ..operators import text as tx

#: A function from a document's bytes to its page texts, with the name of its method.
Reader = tuple[str, Callable[[bytes], list[str]]]


def plain_text(content: bytes) -> list[str]:
    """UTF-8 text with form feeds between pages."""
    return content.decode("utf-8", "replace").split("\f")


def glyph_reader() -> Callable[[bytes], list[tuple]] | None:
    """Glyphs of digital PDF pages as (page_no, seq, text, top, bottom, x0, x1, page_width, page_height), where the library for it is installed."""
    if importlib.util.find_spec("pdfplumber") is None:
        return None

    def read(content: bytes) -> list[tuple]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [(n, i, g["text"], g["top"], g["bottom"], g["x0"], g["x1"], float(p.width), float(p.height)) for n, p in enumerate(pdf.pages, 1) for i, g in enumerate(p.chars)]

    return read


GLYPHS = "page_no int, seq int, text string, top double, bottom double, x0 double, x1 double, page_width double, page_height double"


def glyphs(docs: DataFrame, read: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(doc_id, glyph columns) of all documents (doc_id, content); broken ones have none."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = read(bytes(content))
                except Exception:
                    rows = []
                yield pd.DataFrame([(doc, *r) for r in rows], columns=["doc_id", *(c.split()[0] for c in GLYPHS.split(", "))])

    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {key}, {GLYPHS}")


def canvas_texts(docs: DataFrame, read: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(doc_id, text): all pages of digital documents drawn by the layout operators, each under its heading."""
    from ..operators import layout
    from .folders import checkpointed

    rows = checkpointed(glyphs(docs, read))
    pages = rows.groupBy("doc_id", "page_no").agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    return layout.document_text(layout.page_canvas(rows.drop("page_width", "page_height"), pages))


def layout_reader() -> Reader | None:
    """The library's own layout text of digital PDF pages, where it is installed; for the engine's own canvas see canvas_texts."""
    if importlib.util.find_spec("pdfplumber") is None:
        return None

    def read(content: bytes) -> list[str]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [p.extract_text(layout=True) or "" for p in pdf.pages]

    return "layout_text", read


def page_texts(docs: DataFrame, readers: list[Reader], least_chars: int = 40) -> DataFrame:
    """(doc_id, page_no, text, method, error): the first reader whose text is long enough wins, else the last that gave any; failures are rows."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                pages, method, error = [], None, None
                for name, read in readers:
                    try:
                        got = read(bytes(content))
                    except Exception as e:  # a broken file is that file's status
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if got:
                        pages, method = got, name
                    if sum(len(p.strip()) for p in got) >= least_chars:
                        break
                rows += [(doc, i, p, method, None) for i, p in enumerate(pages, 1)] or [(doc, None, None, None, error or "no text")]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "method", "error"]).astype({"page_no": "Int32"})

    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {key}, page_no int, text string, method string, error string")


def readings(docs: DataFrame, read: Callable[[bytes], tuple[list[str], str]]) -> DataFrame:
    """(doc_id, pages, method, seconds, error): what `read` makes of every document (doc_id, content); failures are rows."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                start = time.perf_counter()
                try:
                    pages, method = read(bytes(content))
                    rows.append((doc, list(pages), method, time.perf_counter() - start, None))
                except Exception as e:  # a broken file is that file's status
                    rows.append((doc, [], None, time.perf_counter() - start, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "pages", "method", "seconds", "error"])

    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {key}, pages array<string>, method string, seconds double, error string")


DIGITAL, CONTAINER = "2d_layout_canvas", "ocrmypdf_docker"


def routed_texts(docs: DataFrame, digital, container=None, images=None, force: bool | None = None, least_chars: int = 40, again: Callable[[bytes], str] | None = None) -> DataFrame:
    """(doc_id, text, method, seconds, error): the best of each document's readings; failures are rows.

    Readings are a table, and their rank decides: the text layer; a container that skips pages with text; a
    container that reads all anew; `images`; a text layer that looked like a scan's. A reading counts from
    `least_chars` characters on. Each reader gets only the documents that no better one has settled, and
    among them only those its rank is for:

        force    text layer first    container, skipping text    container, all anew
        None     unless a scan's     unless pages are partial    yes
        False    yes                 yes                         no
        True     no                  no                          yes

    Garbled readings that are no text layer give way to `again` (content -> text), if that is better.
    """
    from .folders import checkpointed

    stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    enough = F.length(stripped(F.array_join("pages", "\n"))) >= least_chars
    ranked = lambda d, rank, usable: d.withColumns({"rank": F.lit(rank), "usable": usable})

    own = checkpointed(readings(docs.limit(0) if force is True else docs, lambda content: (digital(content), DIGITAL)))
    pages = own.select("doc_id", F.posexplode("pages").alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page_no"), "text")
    seen = docs.select("doc_id").join(layout.scanned(layout.page_stats(pages)), "doc_id", "left")
    seen = checkpointed(seen.select("doc_id", F.coalesce("is_scanned", F.lit(True)).alias("scan"), F.coalesce("has_partial_pages", F.lit(False)).alias("partial")))
    trusted = F.lit(True) if force is False else ~F.col("scan")
    found = ranked(own.join(seen, "doc_id"), 1, enough & trusted).drop("scan", "partial")

    by_container = lambda anew: lambda content: ((digital(made), CONTAINER) if (made := container(content, anew)) else ([], CONTAINER))
    by_images = lambda content: ([x] if (x := (told := images(content))[0]) else [], f"ocr_{told[1]}")
    readers = [
        (2, container and by_container(False), F.lit(force is False) | (F.lit(force is None) & ~F.col("partial")), enough),
        (3, container and by_container(True), F.lit(force is not False), enough),
        (4, images and by_images, F.lit(True), F.size("pages") > 0),
    ]
    for rank, read, wanted, usable in readers:
        if read is not None:
            left = docs.join(seen.filter(wanted).select("doc_id"), "doc_id", "left_semi").join(found.filter("usable").select("doc_id"), "doc_id", "left_anti")
            found = found.unionByName(ranked(checkpointed(readings(left, read)), rank, usable))
    found = found.unionByName(ranked(own, 5, enough).withColumns({"seconds": F.lit(0.0), "error": F.lit(None).cast("string")}))

    best = F.min_by(F.when(F.col("usable"), F.struct("pages", "method")), F.when(F.col("usable"), F.col("rank")))
    chosen = checkpointed(found.groupBy("doc_id").agg(best.alias("b"), F.sum("seconds").alias("seconds"), F.max("error").alias("error")).select("doc_id", "b.pages", "b.method", "seconds", "error"))
    texts = chosen.select("doc_id", F.array_join("pages", "\n\n").alias("text"), "method")
    if again is not None:
        doubtful = texts.filter((F.col("method") != DIGITAL) & tx.looks_garbled("text"))
        turned = checkpointed(readings(docs.join(doubtful.select("doc_id"), "doc_id", "left_semi"), lambda content: ([again(content)], "")))
        texts = layout.recovered(texts, turned.select("doc_id", F.array_join("pages", "").alias("text")))
    d = docs.select("doc_id").join(chosen.drop("method"), "doc_id", "left").join(texts, "doc_id", "left")
    text = v.filled(F.when(F.col("method").isin(DIGITAL, CONTAINER), headed("pages", F.col("doc_id"))).otherwise(F.col("text")))
    error = F.when(text.isNull(), F.coalesce("error", F.lit("no text")))
    return d.select("doc_id", text.alias("text"), F.when(text.isNotNull(), F.col("method")).alias("method"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), error.alias("error"))


def headed(pages, name) -> Column:
    """An array of pages as one text: those that have any, each under the heading of layout.document_text."""
    rule = "=" * 35
    page = lambda p, i: F.when(p.rlike(r"\S"), F.concat(F.lit(f"\n{rule} PAGE "), (i + 1).cast("string"), F.lit(" OF "), F.size(pages).cast("string"), F.lit(" ("), name.cast("string"), F.lit(f") {rule}\n"), p))
    return F.regexp_replace(F.array_join(F.array_compact(F.transform(pages, page)), "\n"), r"^\s+|\s+$", "")


def compared(docs: DataFrame, readers: list[Reader]) -> DataFrame:
    """(doc_id, reader, seconds, words, chars, status): every reader on every document, side by side."""
    import time

    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                for name, read in readers:
                    start = time.perf_counter()
                    try:
                        text = "\n".join(read(bytes(content)))
                        status = "ok" if len(text.strip()) >= 40 else "no text"
                    except Exception as e:
                        text, status = "", f"FAILED: {e}"
                    rows.append((doc, name, time.perf_counter() - start, len(text.split()), len(text.strip()), status))
            yield pd.DataFrame(rows, columns=["doc_id", "reader", "seconds", "words", "chars", "status"])

    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {key}, reader string, seconds double, words long, chars long, status string")


def route(stats: DataFrame) -> DataFrame:
    """(doc_id, route): digital, partial (some pages need OCR) or scanned."""
    return stats.select("doc_id", F.when(F.col("is_scanned"), "scanned").when(F.col("has_partial_pages"), "partial").otherwise("digital").alias("route"))
