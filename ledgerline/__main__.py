"""Command lines: run one document, a folder of documents, compare readers, or serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tables as t
from .operators import retry
from .plans import runs
from .sources import extractors, folders, ocr, raster, readers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerline", description="Trade documents to validated tables.")
    kinds = out.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--type", choices=("auto", "export", "import"), default="auto", help="shipment type")
    shared.add_argument("--max-retries", type=int, default=retry.MAX_RETRIES)
    shared.add_argument("--allow-clipped", action="store_true", help="go on where the table runs off the page")
    shared.add_argument("--force-ocr", action=argparse.BooleanOptionalAction, default=None)
    shared.add_argument("--answers", help="recorded answers: Parquet or JSON lines of doc_id, pass, attempt, payload")
    shared.add_argument("--endpoint", help="url of a chat service; its key is read from LEDGERLINE_KEY")
    shared.add_argument("--model", default=t.PRICES[-1][0])
    shared.add_argument("--container", help="image of an OCR container")
    shared.add_argument("--plain", action="store_true", help="documents are plain texts with form feeds between pages")
    one = kinds.add_parser("run", parents=[shared], help="one document")
    one.add_argument("file")
    one.add_argument("--out", help="folder for the result")
    many = kinds.add_parser("batch", parents=[shared], help="a folder of documents")
    many.add_argument("folder")
    many.add_argument("--out", required=True)
    many.add_argument("--workers", type=int, default=5, help="requests at a time")
    some = kinds.add_parser("compare", parents=[shared], help="every reader on a document, side by side")
    some.add_argument("file")
    serve = kinds.add_parser("serve", parents=[shared], help="the web service")
    serve.add_argument("--out", required=True)
    serve.add_argument("--port", type=int, default=8000)
    return out


def _digital(plain: bool):
    reader = readers.layout_reader()
    return readers.plain_text if plain or reader is None else reader[1]


def reading(args):
    """A function from (doc_id, content) to texts, by what is installed and asked for."""
    container = (lambda content, force: ocr.in_container(content, ocr.container_command(args.container, force=force))) if args.container else None

    def read(docs: DataFrame) -> DataFrame:
        return readers.routed_texts(docs, _digital(args.plain), container, None, False if args.plain else args.force_ocr)

    return read


def scanning(args):
    render = None if args.plain else raster.pdf_renderer()
    return None if render is None else lambda docs: raster.scan_checks(docs, render)


def extracting(spark: SparkSession, args):
    if args.answers:
        rows = spark.read.json(args.answers) if args.answers.endswith((".json", ".jsonl")) else spark.read.parquet(args.answers)
        return extractors.Replay(rows, t.HEADER_FIELDS)
    if args.endpoint:
        return extractors.Service(extractors.http_call(args.endpoint, os.environ.get("LEDGERLINE_KEY")), model=args.model, tasks=getattr(args, "workers", 4))
    raise SystemExit("--answers or --endpoint has to say where raw headers and items come from")


def shown(result: dict) -> str:
    """A result's summary for people."""
    head = result.get("header") or {}
    of = lambda k: head.get(k) or "N/A"
    lines = [f"{result['source_file']}: {result.get('shipment_type')} by {result.get('extraction_method')}, {result.get('extraction_status')} after {result.get('attempts')} attempt(s)"]
    lines.append(f"invoice {of('invoice_number')} of {of('invoice_date')}: {of('supplier_name')} to {of('buyer_name')}, {of('invoice_total')} {head.get('currency') or ''}")
    concepts = t.CONCEPTS[result["shipment_type"]]
    for row in result.get("items") or ():
        lines.append("  " + " | ".join(str(row.get(concepts[c]) or "") for c in ("ser_no", "description", "quantity", "unit", "unit_price", "line_amount")))
    lines += [f"  [{e['rule']}] {e.get('message', '')}" for e in (result.get("validation") or {}).get("errors", ())]
    lines += [f"  warning: {w}" for w in result.get("warnings") or ()]
    return "\n".join(lines)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if hasattr(sys.stdout, "reconfigure"):
        sys.stdout.reconfigure(encoding="utf-8", errors="replace")
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    if args.command == "compare":
        docs = _one(spark, args.file)
        known = [("text", _digital(args.plain))]
        for row in readers.compared(docs, known).collect():  # a line a reader
            print(json.dumps(row.asDict()))
        return 0
    extract = extracting(spark, args)
    options = {"shipment": args.type, "allow_clipped": args.allow_clipped, "max_retries": args.max_retries, "spent": getattr(extract, "spent", lambda: None)}
    if args.command == "batch":
        rows = runs.batch(spark, args.folder, args.out, reading(args), extract, "*.txt" if args.plain else "*.pdf", scanning(args), **options)
        total = folders.summary(rows).first()
        print(f"{total['ok']} succeeded, {total['failed']} failed, {total['skipped']} skipped, cost {total['total_cost_inr'] or 0} INR")
        return 0
    if args.command == "serve":
        from wsgiref.simple_server import make_server

        from .service import Service

        with make_server("127.0.0.1", args.port, Service(spark, reading(args), extract, args.out, args.model)) as server:
            server.serve_forever()
        return 0
    docs = _one(spark, args.file)
    texts = reading(args)(docs)
    scan = scanning(args)
    if scan is not None:
        texts = texts.join(scan(docs).select("doc_id", "clipped_edges", "reasons"), "doc_id", "left")
    done = folders.checkpointed(runs.results(texts, extract, **options))
    row = done.first()
    if row["status"] != "ok":
        print(row["status"])
        return 1
    print(shown(json.loads(row["result"])))
    if args.out:
        folders.write_documents(done.select("doc_id", F.col("doc_id").alias("name"), "valid", "result"), args.out)
    return 0


def _one(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.format("binaryFile").load(file).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_id"), "content")


if __name__ == "__main__":
    raise SystemExit(main())
