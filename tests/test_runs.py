"""Whole runs with recorded or made-up answers: statuses, chunks, costs, files, the service, the command lines; rasters and OCR choices."""

import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import __main__ as cli
from ledgerline import service
from ledgerline.functions import sheets
from ledgerline.functions import tables as t
from ledgerline.operators import clean, repair, retry
from ledgerline.plans import runs
from ledgerline.sources import extractors, folders, ocr, raster, readers

HEADER = {"invoice_number": "I-1", "invoice_total": "100.00", "currency": "USD", "invoice_date": "2026-08-08"}
GOOD = {"line_items": [{"product_description": "WIDGET", "quantity": 10, "unit_price": 10, "line_total": 100}]}


def recorded(spark, **items):
    rows = []
    for doc, answers in items.items():
        for attempt, answer in enumerate(answers, 1):
            rows += [(doc, "header", attempt, json.dumps(HEADER)), (doc, "items", attempt, json.dumps(answer))]
    return spark.createDataFrame(rows, "doc_id string, pass string, attempt int, payload string")


def test_runs_give_every_document_a_status(spark):
    short = {"line_items": [GOOD["line_items"][0] | {"line_total": 90}]}
    replay = extractors.Replay(recorded(spark, a=[GOOD], b=[short, GOOD]), t.HEADER_FIELDS)
    rows = [("a", "SHIPPING BILL WIDGET", "2d_layout_canvas", None, None), ("b", "Bill of Entry WIDGET", "ocr_x", None, None), ("c", "nothing known", "2d_layout_canvas", None, None), ("d", "", None, None, None), ("e", "SHIPPING BILL", None, None, ["left"]), ("f", None, None, "broken", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, method string, error string, clipped_edges array<string>")
    done = folders.checkpointed(runs.results(docs, replay))
    got = {r["doc_id"]: r for r in done.collect()}
    assert (got["a"]["status"], got["a"]["shipment_type"], got["a"]["attempts"], got["a"]["valid"], got["a"]["document_type"]) == ("ok", "export", 1, True, "selectable")
    assert (got["b"]["status"], got["b"]["shipment_type"], got["b"]["attempts"], got["b"]["extraction_status"], got["b"]["document_type"]) == ("ok", "import", 2, "validated", "scanned")
    assert got["c"]["status"] == f"skipped: {runs.UNKNOWN}" and got["d"]["status"] == "FAILED: no text" and got["e"]["status"] == f"skipped: {runs.CLIPPED}" and got["f"]["status"] == "FAILED: broken"
    whole = json.loads(got["a"]["result"])
    assert whole["items"][0]["Item_Desc"] == "WIDGET" and whole["header"]["invoice_number"] == "I-1" and whole["validation"]["valid"] is True
    counts = folders.summary(runs.summary_rows(done)).first()
    assert (counts["ok"], counts["skipped"], counts["failed"]) == (2, 2, 2)
    allowed = runs.with_types(docs, allow_clipped=True).filter("doc_id = 'e'").first()
    assert allowed["refused"] is None and allowed["shipment_type"] == "export"


def test_unknown_types_are_read_again_once(spark):
    docs = spark.createDataFrame([("a", "nothing", "2d_layout_canvas"), ("b", "nothing", "2d_layout_canvas"), ("c", "nothing", "ocr_x")], "doc_id string, text string, method string")
    texts = {"a": "SHIPPING BILL", "b": "still nothing", "c": "SHIPPING BILL"}
    again = lambda d: d.join(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), "doc_id").withColumn("method", F.lit("ocr_y"))
    got = {r["doc_id"]: (r["shipment_type"], r["method"], r["refused"] is None) for r in runs.with_types(docs, again=again).collect()}
    assert got == {"a": ("export", "ocr_y", True), "b": ("unknown", "2d_layout_canvas", False), "c": ("unknown", "ocr_x", False)}


def paged(n, extra=""):
    return "".join(f"=== PAGE {i} OF {n} (x) ===\n{'Item No │ Description │ Qty' if i == 1 else ''}\nrow of page {i}\n{extra}" for i in range(1, n + 1))


def test_items_are_asked_for_in_chunks(spark):
    waybill = "=== PAGE 6 OF 6 (x) ===\nAir Waybill\nShipper's name and address\nNotify party\n"
    rows = [("one", "no pages", False, "f"), ("three", paged(3), False, "f"), ("five", paged(5) + waybill, False, "f"), ("fine", paged(2), True, "f"), ("single", "no pages", True, "f")]
    d = spark.createDataFrame(rows, "doc_id string, text string, fine boolean, items_feedback string").withColumn("previous_items", F.lit("p"))
    got = {}
    for r in extractors.item_chunks(d).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {k: len(x) for k, x in got.items()} == {"one": 1, "three": 1, "five": 3, "fine": 2, "single": 1}
    assert got["three"][0]["text"] == paged(3) and got["one"][0]["previous_items"] == "p"
    assert [x["text"].count("=== PAGE") for x in got["five"]] == [2, 2, 1] and "Waybill" not in "".join(x["text"] for x in got["five"])
    assert got["five"][0]["items_feedback"] == "f" and got["five"][0]["previous_items"] is None
    assert got["fine"][1]["text"].startswith("HEADING OF THE ITEM TABLE") and "Item No │" in got["fine"][1]["text"] and got["fine"][0]["items_feedback"] is None and got["single"][0]["items_feedback"] == "f"


def test_requests_usage_and_backoff(spark):
    d = spark.createDataFrame([("a", "text", None, None), ("b", "text", "wrong", '{"x": 1}')], "doc_id string, text string, header_feedback string, previous_header string")
    bodies = {r["doc_id"]: json.loads(r["b"]) for r in d.select("doc_id", extractors.requests(d, "header", "gpt-4.1-nano").alias("b")).collect()}
    assert bodies["a"]["response_format"] == {"type": "json_object"} and bodies["a"]["messages"][1]["content"] == "DOCUMENT\ntext"
    assert bodies["b"]["messages"][1]["content"] == 'DOCUMENT\ntext\n\nLAST ANSWER\n{"x": 1}\n\nFINDINGS\nwrong' and "invoice_number" in bodies["a"]["messages"][0]["content"]
    d = d.withColumn("fine", F.col("doc_id") == "b")
    bodies = {r["doc_id"]: json.loads(r["b"]) for r in d.select("doc_id", extractors.requests(d, "items", "gpt-5-nano").alias("b")).collect()}
    assert bodies["a"]["reasoning_effort"] == "minimal" and bodies["b"]["reasoning_effort"] == "medium" and "response_format" not in bodies["a"]
    told = spark.createDataFrame([('{"usage": {"prompt_tokens": 10, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 4}}}',), ("{}",), (None,)], "r string")
    assert [tuple(x["u"]) for x in told.select(extractors.usage("r").alias("u")).collect()] == [(10, 4, 3), (0, 0, 0), (0, 0, 0)]
    waits, calls = [], []

    def flaky(body):
        calls.append(body)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert extractors.with_backoff(flaky, sleep=waits.append)("x") == "done" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        extractors.with_backoff(lambda b: (_ for _ in ()).throw(OSError("no")), tries=2, sleep=waits.append)("x")


def answering(body):
    asked = json.loads(body)
    text = asked["messages"][1]["content"]
    if "refuse" in text:
        raise OSError("down")
    if asked["messages"][0]["content"].startswith(extractors._ASKS["header"]):
        answer = HEADER | {"invoice_total": "200.00"} if "PAGE 2" in text else HEADER
    else:
        answer = {"line_items": GOOD["line_items"] * (2 if "page 3" in text else 1)} if "PAGE 5" not in text else {"line_items": []}
    return json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps(answer) + "\n```"}}], "usage": {"prompt_tokens": 1000, "completion_tokens": 100}})


def test_a_service_extracts_counts_and_costs(spark):
    model = extractors.Service(answering, model="gpt-5-nano", tasks=2, tries=1)
    texts = spark.createDataFrame([("a", "SHIPPING BILL"), ("b", paged(4, "SHIPPING BILL\n")), ("c", "SHIPPING BILL refuse")], "doc_id string, text string")
    done = {r["doc_id"]: r for r in runs.results(texts, model, max_retries=0, spent=model.spent).collect()}
    assert done["a"]["valid"] and done["a"]["total_tokens"] == 2200 and done["a"]["item_rows"] == 1
    assert done["b"]["total_tokens"] == 3300 and done["b"]["item_rows"] == 2
    assert not done["c"]["valid"] and done["c"]["item_rows"] == 0
    spent = {r["doc_id"]: r for r in model.spent().collect()}
    assert spent["b"]["calls"] == 3 and spent["c"]["errors"] == ["OSError: down"] and spent["a"]["cost_usd"] > 0


def test_incomplete_items_are_looked_at_page_by_page_once(spark):
    seen = []

    def extract(kind, attempt, pending):
        rows = pending.select("doc_id", "fine", "items_feedback", *[c for c in ("previous_items",) if c in pending.columns]).collect()
        seen.extend((kind, attempt, r["fine"], r["items_feedback"] is not None) for r in rows)
        payload = HEADER | {"invoice_total": "300.00"} if kind == "header" else GOOD
        answers = pending.select("doc_id", F.lit(json.dumps(payload)).alias("json"))
        return extractors.header_of(answers, t.HEADER_FIELDS) if kind == "header" else extractors.items_of(answers)

    texts = spark.createDataFrame([("a", "WIDGET")], "doc_id string, text string")
    _, _, history = retry.extract_and_validate(texts, extract, max_retries=3)
    assert seen == [("header", 1, False, False), ("items", 1, False, False), ("items", 2, True, True)]
    assert retry.attempts(history, 3).first()["attempts"] == 2 or retry.attempts(history, 3).first()["attempts"] == 3


def test_files_of_a_batch(spark, tmp_path):
    (tmp_path / "in" / "s").mkdir(parents=True)
    for name in ("a.txt", "s/A.txt", "s/b.txt"):
        (tmp_path / "in" / name).write_text("SHIPPING BILL and forty characters of text at least" if "b" not in name else "x")
    answers = recorded(spark, **{"a.txt": [GOOD], "s/A.txt": [GOOD]})
    answers.write.json(str(tmp_path / "answers.json"))
    code = cli.main(["batch", f"file:{tmp_path}/in", "--out", str(tmp_path / "out"), "--plain", "--answers", str(tmp_path / "answers.json")], spark)
    assert code == 0
    assert sorted(os.listdir(tmp_path / "out" / "valid")) == ["a.json", "s__A.json"]
    rows = {r["file"]: r for r in folders.read_summary(spark, str(tmp_path / "out" / "_summary")).collect()}
    assert rows["a.txt"]["status"] == "ok" and rows["s/b.txt"]["status"].startswith("FAILED")
    code = cli.main(["run", f"{tmp_path}/in/a.txt", "--plain", "--answers", str(tmp_path / "answers.json"), "--type", "export", "--out", str(tmp_path / "one")], spark)
    assert code == 0 and os.listdir(tmp_path / "one" / "valid") == ["a.json"]
    assert cli.main(["compare", f"{tmp_path}/in/a.txt", "--plain"], spark) == 0


def test_equal_names_get_numbers(spark, tmp_path):
    d = spark.createDataFrame([(1, "x/R.pdf", True, "{}"), (2, "r.pdf", True, "{}"), (3, "r.pdf", False, None), (4, None, False, "{}")], "doc_id long, name string, valid boolean, result string")
    got = {r["doc_id"]: (r["saved_path"] or "").removeprefix(f"{tmp_path}/") for r in folders.write_documents(d, str(tmp_path)).collect()}
    assert got == {1: "valid/R.json", 2: "valid/r_2.json", 3: "validation_failed/r.json", 4: "validation_failed/unnamed.json"}
    blocked = tmp_path / "blocked"
    blocked.write_text("a file")
    assert all(r["error"] for r in folders.write_documents(d, str(blocked)).collect())


def test_the_service_answers(spark, tmp_path):
    sent = []
    post = lambda url, headers, body: sent.append((url, headers, json.loads(body))) or (200, "")
    settings = {service.CALLBACK_URL: "http://receiver.test/", service.CALLBACK_KEY: "k"}
    read = lambda docs: readers.routed_texts(docs, readers.plain_text, force=False)
    app = service.Service(spark, read, extractors.Service(answering, model="gpt-5-nano", tries=1), str(tmp_path), ending=".txt", environment=settings, post=post)
    good = b"SHIPPING BILL with a text of forty characters or more"

    def ask(method, path, files=(), query=""):
        kind, body = service.form(list(files))
        status = []
        out = app({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_TYPE": kind, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda s, h: status.append(s))
        return status[0], json.loads(b"".join(out))

    assert ask("GET", "/health")[1]["templates"]["export"][0] == "ITEM" and ask("GET", "/x")[0].startswith("404")
    status, answer = ask("POST", "/extract", [("a.txt", good)])
    assert status == "200 OK" and answer["source_file"] == "a.txt" and answer["header"]["invoice_number"] == "I-1" and answer["token_usage"]["total_tokens"] >= 2200
    assert ask("POST", "/extract", [("a.exe", good)])[0].startswith("422") and ask("POST", "/extract", [("a.txt", good)], "type=both")[0].startswith("422")
    results = ask("POST", "/extract-batch", [("a.txt", good), ("b.bin", b""), ("A.txt", good), ("c.txt", b"neither this nor that, but with text enough to read")])[1]["results"]
    assert [("error" in r and bool(r["error"])) for r in results] == [False, True, False, True] and "unknown" in results[3]["error"]
    assert {"a.json", "A_2.json"} <= set(os.listdir(tmp_path / "valid"))
    status, answer = ask("POST", "/save-pdf", [("a.txt", good), ("a.txt", good), ("b.bin", b"")], "job_id=7&type=export")
    assert [e["extraction_status"] for e in answer["results"]] == ["success", "success", "failed"] and answer["callback"] == {"sent": True, "status_code": 200}
    assert sorted(os.listdir(tmp_path / "jobs" / "7")) == ["a.txt", "a_2.txt"] and sent[0][1]["X-API-KEY"] == "k" and [bool(r.get("error")) for r in sent[0][2]["results"]] == [False, False, True]
    assert service.send_results(1, [], {})["sent"] is False
    assert service.send_results(1, [], settings, lambda *a: (500, "no"))["response"] == "no" and "error" in service.send_results(1, [], settings, lambda *a: 1 / 0)


def test_lines_of_page_images(spark):
    page = np.full((800, 600), 250, np.uint8)
    for y in (100, 200, 300, 400):
        for x in range(0, 560):
            page[y + round(x * np.tan(np.radians(1.0))), x] = 20
    page[50:700, 300] = 20
    assert 2600 < raster.ink(page).sum() < 3200
    docs = spark.createDataFrame([("p", bytearray(page.tobytes())), ("blank", bytearray(np.full((800, 600), 250, np.uint8).tobytes())), ("bad", bytearray(b"x"))], "doc_id string, content binary")

    def render(content, number):
        return np.frombuffer(content, np.uint8).reshape(800, 600)

    got = {r["doc_id"]: r for r in raster.scan_checks(docs, render).collect()}
    assert got["p"]["skew_deg"] == 1.0 and got["p"]["clipped_edges"] == ["left"] and got["blank"]["reasons"] == ["no_grid"]
    assert got["bad"]["skew_deg"] is None and got["bad"]["error"].startswith("ValueError")
    assert {r["doc_id"]: r["skew_deg"] for r in raster.page_skew(docs, render).collect()} == {"p": 1.0, "blank": None, "bad": None}


def test_engines_lines_and_choices():
    assert ocr.lines_of("rapidocr", ([[0, "a", 0.9], [0, "b", 0.8]], 1.0)) == ["a", "b"] and ocr.lines_of("rapidocr", (None, None)) == []
    assert ocr.lines_of("paddleocr", [[[0, ("a", 0.9)], [0, "b"]], {"rec_texts": ["c"]}, None]) == ["a", "b", "c"]
    assert ocr.lines_of("paddleocr_vl", [{"markdown": "m"}, {"json": {"layout_elements": [{"text": "e"}, {}]}}]) == ["m", "e"]
    broken = ("x", "json", lambda: 1 / 0)
    assert ocr.engine((("no", "no_such_module_here", None), broken, ("y", "json", lambda: "made"))) == ("y", "made") and ocr.engine((broken,)) is None
    fails = lambda image: 1 / 0
    assert ocr.read_images([b"1", b"2", b"3"], lambda i: ["l"] if i != b"2" else []) == "--- Page 1 (OCR) ---\nl\n\n--- Page 3 (OCR) ---\nl"
    assert ocr.read_images([b"1"], fails, lambda i: ["f"]).endswith("f")
    command = ocr.container_command("img", force=True, rotate=False)
    assert command[-3:] == ["--force-ocr", "-", "-"] and "--rotate-pages" not in command and "--rotate-pages" in ocr.container_command("img")
    assert ocr.in_container(b"abc", ["cat"]) == b"abc" and ocr.in_container(b"", ["no-such-runtime"]) is None and ocr.in_container(b"", ["sleep", "5"], 0.2) is None and ocr.in_container(b"", ["false"]) is None
    reads = {(b"1", 0): "a b", (b"1", 90): "good words", (b"1", 180): "fine words", (b"1", 270): "", (b"2", 90): "more"}
    assert ocr.best_rotation([b"1", b"2"], lambda image, turn: reads[image, turn]) == ("good words\n\nmore", 90)


def test_ranked_readers(spark, tmp_path):
    rich, garbled = " ".join(["word"] * 60), "a b c d e " * 10

    def digital(content):
        if content == b"broken":
            raise ValueError("no such form")
        return {b"rich": [rich], b"made": [rich], b"made garbled": [garbled], b"partial": ["few words"], b"thin": ["forty characters and a few more of them, so"]}.get(content, [])

    def asked(route, force, again=None, images=lambda content: ("read from pixels" if content != b"thin" else "", "engine")):
        """(document: method and start of its text) and (document, flag) of the container's calls."""
        told = tmp_path / route
        told.mkdir()

        def container(content, anew):
            (told / f"{content.decode()}-{anew}").touch()
            return None if content in (b"empty", b"broken", b"thin") else b"made garbled" if content == b"doubled" else b"made" if anew else None

        names = ("rich", "partial", "empty", "broken", "thin", "doubled")
        docs = spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "doc_id string, content binary")
        got = {x["doc_id"]: x for x in readers.routed_texts(docs, digital, container, images, force, again=again).collect()}
        return {k: (x["method"], (x["text"] or x["error"])[-14:]) for k, x in got.items()}, {f.name for f in told.iterdir()}

    got, calls = asked("auto", None, lambda content: "clean words here" if content == b"doubled" else "")
    assert got == {"rich": ("2d_layout_canvas", rich[-14:]), "partial": ("ocrmypdf_docker", rich[-14:]), "empty": ("ocr_engine", "ad from pixels"), "broken": ("ocr_engine", "ad from pixels"), "thin": ("2d_layout_canvas", "re of them, so"), "doubled": ("ocrmypdf_docker+rotation_recovered", "ean words here")}
    assert calls == {"partial-True", "empty-False", "empty-True", "broken-False", "broken-True", "thin-True", "doubled-False"}
    got, calls = asked("anew", True)
    assert got["rich"] == ("ocrmypdf_docker", rich[-14:]) and got["thin"] == (None, "no text") and got["doubled"][0] == "ocrmypdf_docker" and not [c for c in calls if c.endswith("False")]
    got, calls = asked("skip", False, images=None)
    assert got["thin"][0] == got["rich"][0] == "2d_layout_canvas" and got["empty"] == (None, "no text") and got["broken"] == (None, "r: no such form"[-14:]) and calls == {"partial-False", "empty-False", "broken-False", "doubled-False"}
    docs = spark.createDataFrame([("e", bytearray(b"empty"))], "doc_id string, content binary")
    assert [tuple(x)[:3] for x in readers.routed_texts(docs, digital).collect()] == [("e", None, None)]


def workbook(sheets_):
    """A minimal workbook: names of sheets and rows of cells, shared and inline strings mixed."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = [c for rows in sheets_.values() for row in rows for c in row if c]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets_)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets_))) + "</Relationships>")
        for i, rows in enumerate(sheets_.values()):
            cells = lambda row: "".join(f'<c t="s"><v>{shared.index(c)}</v></c>' if c and k % 2 == 0 else f'<c t="inlineStr"><is><t>{c}</t></is></c>' if c else "<c/>" for k, c in enumerate(row))
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{cells(row)}</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_templates_from_workbooks_and_typed_rows(spark):
    got = sheets.read_workbook(workbook({"ITEM": [["", ""], ["Item_Ser_No", "Item_Qty", "", "Item Desc"]], "EMPTY": []}))
    assert got == {"ITEM": ("Item_Ser_No", "Item_Qty", "Item Desc"), "EMPTY": ()}
    columns = sheets.template_columns(spark, got)
    schema = sheets.sheet_schema(columns, "ITEM")
    assert [f.dataType.simpleString() for f in schema] == ["string", "decimal(18,6)", "string"] and schema["Item_Qty"].metadata["comment"] == "Item Quantity"
    rows = spark.createDataFrame([("d", 1, "1", "2.5", "x", ""), ("d", 2, "2", "many", "", "y")], ["doc_id", "pos", "Item_Ser_No", "Item_Qty", "Item Desc", "Other"])
    a, b = sheets.typed(rows, schema).orderBy("pos").collect()
    assert float(a["Item_Qty"]) == 2.5 and (a["misfits"], a["unknown"]) == ([], []) and (b["Item_Qty"], b["misfits"], b["unknown"]) == (None, ["Item_Qty"], ["Other"])
    assert len(sheets.sheet_schema(sheets.template_columns(spark), "BOE")) == len(t.BOE_COLUMNS)


def test_warnings_and_notes(spark):
    heads = spark.createDataFrame([("d", "27ABC", "10")], "doc_id string, supplier_tax_id string, invoice_total string")
    item = {"product_description": "STEEL VALVE BODY", "quantity": "5", "unit_price": "2", "line_total": "10"}
    fields = [item, item, {"product_description": "TOTAL", "line_total": "20"}, {"product_description": "STEEL VALVE BODY", "quantity": "5", "colour": "red"}]
    raw = spark.createDataFrame([("d", i, x) for i, x in enumerate(fields, 1)], "doc_id string, pos int, fields map<string,string>")
    got = {(r["pos"], r["code"]) for r in clean.cleaning_warnings(heads, raw).collect()}
    assert got == {(None, "supplier_tax_id_shape"), (2, "bundle_repeat"), (3, "sum_or_empty_row"), (4, "packing_list_repeat"), (4, "unknown_field:colour")}
    rows = spark.createDataFrame([("d", 1.0, 5.0)], "doc_id string, quantity double, line_total double")
    d = clean._missing(spark.createDataFrame([("d", "12", "7", "Mumbai India", "US", "US", "no such thing")], "doc_id string, net_realisable_amount string, invoice_total string, supplier_address string, country_of_origin string, country_of_destination string, invoice_text string"), t.HEADER_FIELDS)
    assert repair.header_values(d, rows).first()["header_notes"] == ["net_amount_not_printed", "origin_is_home"]


def test_two_readings_side_by_side(spark):
    a = spark.createDataFrame([("d", "1", None), ("e", "2", "x")], "doc_id string, invoice_number string, currency string")
    b = spark.createDataFrame([("d", "1", None), ("f", "2", "x")], "doc_id string, invoice_number string, currency string")
    got = {(r["doc_id"], r["field"]): r["same"] for r in extractors.compared(a, b, ["invoice_number", "currency"]).collect()}
    assert got == {("d", "invoice_number"): True, ("d", "currency"): True, ("e", "invoice_number"): False, ("e", "currency"): False, ("f", "invoice_number"): False, ("f", "currency"): False}
    body = json.loads(extractors.image_request("items", [b"ab"], "gpt-5-nano"))
    assert body["messages"][1]["content"][1]["image_url"]["url"] == "data:image/png;base64,YWI=" and "response_format" not in body
