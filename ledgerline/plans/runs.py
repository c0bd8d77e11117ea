"""Whole runs: from texts of documents to results with a status each, and from folders to files and a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as t
from ..operators import classify, clean, layout, retry, rules
from ..sources import folders

CLIPPED = "table clipped -- scan it again, or allow clipped tables"
UNKNOWN = "unknown shipment type -- name it"
ITEM_SHEETS = {"export": t.EXPORT_SHEET, "import": t.IMPORT_SHEET}

#: Documents: doc_id, text, and where known method, seconds, error, clipped_edges and reasons (arrays).
OPTIONAL = {"method": "string", "seconds": "double", "error": "string", "clipped_edges": "array<string>", "reasons": "array<string>"}


def with_types(documents: DataFrame, shipment: str = "auto", allow_clipped: bool = False, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents with shipment_type, its scores and signal, and `refused` or `error` where they go no further.

    A clipped table is refused before anything else is paid for. Digital text whose type
    is unknown is read once more by `again` (doc_id -> doc_id, text, method), and keeps that text only if it tells the type.
    """
    d = documents.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items() if c not in documents.columns])
    clipped = F.coalesce(F.size("clipped_edges") > 0, F.lit(False)) & F.lit(not allow_clipped)
    d = d.withColumn("refused", F.when(clipped, CLIPPED)).withColumn("error", F.coalesce("error", F.when(~clipped & (F.coalesce(F.trim("text"), F.lit("")) == ""), "no text")))
    d = folders.checkpointed(d)
    going = d.filter(F.col("refused").isNull() & F.col("error").isNull())
    if shipment != "auto":
        found = going.select("doc_id", F.lit(shipment).alias("shipment_type"), F.lit(None).cast("int").alias("export_score"), F.lit(None).cast("int").alias("import_score"), F.lit(None).cast("string").alias("signal"))
    else:
        found = _detected(going)
        if again is not None:
            found = folders.checkpointed(found)
            lost = going.join(found.filter("shipment_type = 'unknown'").select("doc_id"), "doc_id", "left_semi").filter(folders.document_kind("method") == "selectable")
            new = folders.checkpointed(again(lost.select("doc_id")).select("doc_id", F.col("text").alias("__text"), F.col("method").alias("__method")))
            better = folders.checkpointed(_detected(new.select("doc_id", F.col("__text").alias("text"))).filter("shipment_type <> 'unknown'"))
            found = found.join(better, "doc_id", "left_anti").unionByName(better)
            taken = new.join(better.select("doc_id"), "doc_id", "left_semi")
            d = d.join(taken, "doc_id", "left").withColumns({"text": F.coalesce("__text", "text"), "method": F.coalesce("__method", "method")}).drop("__text", "__method")
    d = d.join(found, "doc_id", "left")
    return d.withColumn("refused", F.coalesce("refused", F.when(F.col("shipment_type") == "unknown", UNKNOWN)))


def _detected(texts: DataFrame) -> DataFrame:
    return classify.detect(texts.select("doc_id", "text")).select("doc_id", "shipment_type", "export_score", "import_score", "signal")


def results(documents: DataFrame, extract: retry.Extract, shipment: str = "auto", allow_clipped: bool = False, again=None, max_retries: int = retry.MAX_RETRIES, spent: Callable[[], DataFrame | None] = lambda: None) -> DataFrame:
    """(doc_id, status, shipment_type, method, document_type, seconds, item_rows, warnings, valid, extraction_status, attempts, validation_errors, total_tokens, cost_inr, result).

    One row a document, refused and failed ones too; `result` is the whole result as
    JSON. `spent` gives what documents cost once the extraction is done (doc_id, calls, tokens, costs).
    """
    d = folders.checkpointed(with_types(documents, shipment, allow_clipped, again))
    parts = []
    for kind in ("export", "import"):
        own = d.filter((F.col("shipment_type") == kind) & F.col("refused").isNull() & F.col("error").isNull()).select("doc_id", "text")
        if not own.isEmpty():
            parts.append(_extracted(own, extract, kind, max_retries))
    out = d.select("doc_id", "refused", "error", "shipment_type", "export_score", "import_score", "signal", "method", "seconds", "reasons")
    if parts:
        done = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = out.join(done, "doc_id", "left")
    else:
        out = out.select("*", *[F.lit(None).cast(x).alias(c) for c, x in _EXTRACTED.items()])
    costs = spent()
    if costs is None:
        out = out.withColumns({"tokens": F.lit(None).cast("string"), "total_tokens": F.lit(0).cast("long"), "cost_inr": F.lit(0.0)})
    else:
        counts = F.to_json(F.struct("calls", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens", "cost_usd", "cost_inr"))
        out = out.join(costs.select("doc_id", counts.alias("tokens"), "total_tokens", "cost_inr"), "doc_id", "left").fillna(0, ["total_tokens", "cost_inr"])
    scan = F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda x: F.concat(F.lit("scan quality: "), x))
    out = out.withColumn("notes", F.concat(scan, F.coalesce("notes", F.array().cast("array<string>"))))
    status = folders.status_of("error", "refused")
    whole = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("source_file"), "shipment_type", F.struct("export_score", "import_score", "signal").alias("detection"), F.col("method").alias("extraction_method"), folders.document_kind("method").alias("document_type"),
            F.round("seconds", 2).alias("read_seconds"), F.try_parse_json("tokens").alias("token_usage"), F.try_parse_json("header").alias("header"), F.try_parse_json("items").alias("items"), F.col("notes").alias("warnings"), F.try_parse_json("validation").alias("validation"), "attempts", "extraction_status", "error",
        )
    )
    return out.select(
        "doc_id", status.alias("status"), "shipment_type", "method", folders.document_kind("method").alias("document_type"), "seconds", F.coalesce("item_rows", F.lit(0)).cast("long").alias("item_rows"), F.size("notes").cast("long").alias("warnings"), F.coalesce("valid", F.lit(False)).alias("valid"),
        "extraction_status", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.coalesce("validation_errors", F.lit(0)).cast("long").alias("validation_errors"), "total_tokens", "cost_inr", whole.alias("result"),
    )


_EXTRACTED = {"header": "string", "items": "string", "item_rows": "long", "validation": "string", "valid": "boolean", "validation_errors": "long", "attempts": "long", "extraction_status": "string", "notes": "array<string>"}


def _extracted(texts: DataFrame, extract: retry.Extract, shipment: str, max_retries: int) -> DataFrame:
    """(doc_id, ...): header, items, validation and notes as JSON, with their counts."""
    heads, wide, history = retry.extract_and_validate(texts, extract, shipment, max_retries)
    last = history.withColumn("__last", F.max("attempt").over(_by_document())).filter("attempt = __last").drop("__last")
    found = rules.result_documents(last)
    found = found.select("doc_id", "valid", F.size("errors").cast("long").alias("validation_errors"), F.to_json(F.struct("valid", "status", "errors", "warnings", "checks", "passed_rules")).alias("validation"))
    header = heads.select("doc_id", F.to_json(F.struct(*t.HEADER_FIELDS)).alias("header"), F.transform(F.concat("warnings", F.coalesce("header_notes", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("header: "), x)).alias("notes"))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide.columns if c not in ("doc_id", "pos")]))
    rows = wide.groupBy("doc_id").agg(F.count("*").alias("item_rows"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("items"))
    d = texts.select("doc_id").join(header, "doc_id", "left").join(rows, "doc_id", "left").join(found, "doc_id", "left").join(retry.attempts(history, max_retries), "doc_id", "left")
    state = F.when(F.coalesce("valid", F.lit(False)), "validated").otherwise("validation_failed")
    return d.withColumn("extraction_status", state).select("doc_id", *_EXTRACTED)


def _by_document():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def summary_rows(done: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The rows of a batch's summary, in the order of its columns; only documents that are ok have counts."""
    d = done if names is None else done.join(names.select("doc_id", "file"), "doc_id")
    file = F.col("file") if names is not None else F.col("doc_id").cast("string")
    ok = lambda c, none: F.when(F.col("status") == "ok", F.col(c)).otherwise(none).alias(c)
    refused = F.when(F.col("status") == "ok", F.col("shipment_type")).when(F.col("status").contains(UNKNOWN), "unknown").otherwise("")
    return d.select(
        file.alias("file"), "status", refused.alias("shipment_type"), ok("method", ""), ok("seconds", 0.0), ok("item_rows", 0), ok("total_tokens", 0), ok("cost_inr", 0.0), ok("warnings", 0), ok("extraction_status", ""), ok("attempts", 0), ok("validation_errors", 0),
    )


def batch(spark: SparkSession, folder: str, out: str, read: Callable[[DataFrame], DataFrame], extract: retry.Extract, pattern: str = "*.pdf", scan: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """All documents below `folder`: results under `out`, one JSON a document, and out/_summary; gives the summary's rows.

    `read` turns (doc_id, content) into texts (`readers.routed_texts`), `scan` into clipped_edges and reasons of the first page (`raster.scan_checks`).
    """
    files = folders.documents(spark, folder, pattern)
    named = folders.checkpointed(folders.output_names(files.select("doc_id", F.col("doc_id").alias("path"))))
    texts = folders.checkpointed(read(files.select("doc_id", "content")))
    if scan is not None:
        texts = texts.join(scan(files.select("doc_id", "content")).select("doc_id", "clipped_edges", "reasons"), "doc_id", "left")
    done = folders.checkpointed(results(texts, extract, **options))
    folders.write_documents(done.filter("status = 'ok'").join(named, "doc_id").select("doc_id", F.concat("out_name", F.lit(".json")).alias("name"), "valid", "result"), out)
    rows = folders.checkpointed(summary_rows(done).sort("file"))
    folders.write_summary(rows, f"{out.rstrip('/')}/_summary")
    return rows


def scan_gate(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, clipped_edges, reasons) of first pages, for with_types()."""
    return layout.scan_quality(pages.filter("page_no = 1"), segments).select("doc_id", "clipped_edges", "reasons")


def warnings(documents: DataFrame, extract: retry.Extract, shipment: str) -> DataFrame:
    """`clean.cleaning_warnings` of a first extraction."""
    pending = documents.select("doc_id", "text").withColumns({"header_feedback": F.lit(None).cast("string"), "items_feedback": F.lit(None).cast("string"), "fine": F.lit(False)})
    return clean.cleaning_warnings(extract("header", 1, pending), extract("items", 1, pending), shipment)
