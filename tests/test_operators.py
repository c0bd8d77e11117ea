"""Cleaning, repairs, texts, classification, layout, extraction: each with a case that is left alone."""

from pyspark.sql import functions as F

from ledgerline.functions import tables as t
from ledgerline.operators import classify, clean, layout, repair, retry
from ledgerline.operators import text as tx
from ledgerline.sources import extractors, folders, readers


def raw(spark, *rows):
    return spark.createDataFrame([("d", i, r) for i, r in enumerate(rows, 1)], "doc_id string, pos int, fields map<string,string>")


def test_items_drop_sums_and_empty_rows(spark):
    rows = [dict(product_description="WIDGET A", quantity="10", unit_price="$10.0", line_total="1,00.0"), dict(product_description="SUBTOTAL", line_total="300"), dict(product_description="STRAY"), dict(product_description="STAINLESS ROD", unit_price="4", line_total="8"), dict(product_description="TOTAL KIT", quantity="", line_total="5")]
    got = clean.items(raw(spark, *rows)).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [1, 5]
    assert [r["item_ser_no"] for r in got] == ["1", "2"]
    assert float(got[0]["line_total"]) == 100


def test_codes_move_where_they_belong(spark):
    rows = [dict(quantity="1", fta_code="GNX200"), dict(quantity="1", fta_code="1234567-7654321"), dict(quantity="1", fta_code="F1", end_use_code="E"), dict(quantity="2", product_description="SHUNT RESISTOR", type="resistor", ohms="47")]
    got = clean.items(raw(spark, *rows)).orderBy("pos").collect()
    assert [(r["end_use_code"], r["fta_code"]) for r in got[:3]] == [("GNX200", None), (None, None), ("E", "F1")]
    assert got[3]["model_or_type"] == "47 OHMS"


def test_headers(spark):
    d = spark.createDataFrame([("a", "27abcde1234f1z59", "7", "Euro", "India", "any"), ("b", None, "Goa (30)", "XYZ", "Peru", "no")], "doc_id string, supplier_tax_id string, state_code string, currency string, country_of_origin string, reward_scheme_claim string")
    a, b = clean.headers(d).orderBy("doc_id").collect()
    assert (a["supplier_tax_id"], a["state_code"], a["currency"], a["country_of_origin"], a["reward_scheme_claim"]) == ("27ABCDE1234F1Z5", "27", "EUR", "IN", "Y")
    assert a["warnings"] == ["state_code_from_tax_id"]
    assert (b["state_code"], b["country_of_origin"], b["reward_scheme_claim"]) == ("30", "Peru", "N")


def test_repeats_of_priced_rows_go(spark):
    d = spark.createDataFrame([("d", 1, "P1", "WIDGET ALPHA", 5, 2.0), ("d", 2, "P1", "x", 5, None), ("d", 3, "", "WIDGET ALPHA.", 5, None), ("d", 4, "P2", "WIDGET ALPHA", 5, None), ("d", 5, "P1", "x", 6, None)], "doc_id string, pos int, part_number string, product_description string, quantity int, unit_price double")
    assert sorted(r["pos"] for r in clean.without_packing_list_repeats(d).collect()) == [1, 4, 5]


def test_twins_go_only_if_the_total_needs_it(spark):
    rows = [(doc, i, "STEEL VALVE BODY", 5.0, 2.0, 10.0) for doc in ("a", "b") for i in (1, 2, 3)]
    d = spark.createDataFrame(rows, "doc_id string, pos int, product_description string, quantity double, unit_price double, line_total double")
    totals = spark.createDataFrame([("a", 20.0), ("b", 25.0)], "doc_id string, total double")
    got = clean.without_bundle_repeats(d, totals).collect()
    assert sorted((r["doc_id"], r["pos"]) for r in got) == [("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]


def test_fewest_amounts_against_all_subsets():
    import random
    from itertools import combinations

    r = random.Random(3)
    for _ in range(300):
        amounts = [r.randint(1, 6) for _ in range(r.randint(1, 9))]
        least = r.randint(1, 20)
        most = least + r.randint(0, 2)
        want = next((list(some) for n in range(1, len(amounts) + 1) for some in combinations(range(len(amounts)), n) if least <= sum(amounts[i] for i in some) <= most), None)
        assert clean.fewest(amounts, least, most) == want
    assert clean.fewest([7] * 400, 7 * 250, 7 * 250) == list(range(250))


def test_many_twins_and_unlike_ones(spark):
    rows = [("a", i, "STEEL VALVE BODY", 5.0, 2.0, 10.0) for i in range(30)] + [("b", 1, "STEEL VALVE BODY", 5.0, 2.0, 10.0), ("b", 2, "QUARTZ LAMP", 5.0, 2.0, 10.0), ("c", 1, "STEEL VALVE BODY", 5.0, 2.0, None), ("c", 2, "STEEL VALVE BODY", 5.0, 2.0, 10.0)]
    d = spark.createDataFrame(rows, "doc_id string, pos int, product_description string, quantity double, unit_price double, line_total double")
    totals = spark.createDataFrame([("a", 150.0), ("b", 10.0), ("c", 10.0)], "doc_id string, total double")
    got = sorted((x["doc_id"], x["pos"]) for x in clean.without_bundle_repeats(d, totals).collect())
    assert got == [("a", 0), *(("a", i) for i in range(16, 30)), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]


def test_serial_numbers_that_fall_are_made_anew(spark):
    d = spark.createDataFrame([("a", 1, "1"), ("a", 2, None), ("a", 3, "1"), ("b", 1, "2"), ("b", 2, "x"), ("b", 3, "5")], "doc_id string, pos int, item_ser_no string")
    got = [r["item_ser_no"] for r in clean.renumbered(d).orderBy("doc_id", "pos").collect()]
    assert got == ["1", "2", "3", "2", "x", "5"]


def test_sheets_have_all_columns_in_order(spark):
    heads = spark.createDataFrame([("d", "RODTEP", "State (7)")], "doc_id string, reward_scheme_claim string, state_code string")
    rows = clean.items(raw(spark, dict(product_description="VALVE 84818090A OTHER", quantity="0", unit_price="1", line_total="0")))
    wide = clean.sheet(rows, heads, "export")
    assert wide.columns == ["doc_id", "pos", *t.ITEM_COLUMNS, *t.EXTRA_COLUMNS]
    row = wide.first()
    assert (row["Item_Desc"], row["Item_Reward"], row["State Code"], row["PER"]) == ("VALVE", "Y", "7", "")
    assert float(row["Item_Qty"]) == 0
    assert clean.sheet(rows, heads, "import").columns == ["doc_id", "pos", *t.BOE_COLUMNS, *t.EXTRA_COLUMNS]


TABLE = """=== PAGE 1 OF 2 (a) ===
Item No │ HSN Code │ Description │ Qty │ Total
   1 │ 160 │ 8481 80 90 │ P-0001 SAMPLE VALVE │ 2 │ 1,750.00 │ 3,500.00 │ 3,500.00
   2 │ 170 │ 84314980 │ P-0002 SAMPLE CUTTER │ 10 │ 4.870 │ CN
   22,65 226,50 │ 226,50
FREIGHT CHARGES  │ 100.00
TOTAL 3726.50
"""


def test_repairs_come_from_the_items_own_row(spark):
    texts = spark.createDataFrame([("d", TABLE)], "doc_id string, text string")
    items = spark.createDataFrame(
        [("d", 1, "SAMPLE VALVE", "P-0001", "160", "2", "3500", "7000"), ("d", 2, "SAMPLE CUTTER", "P-0002", "84314980", "10", "4.87", "48.70"), ("d", 3, "Freight Charges", "", "", "1", "100", "100"), ("d", 4, "UNKNOWN PART", "P-0009", "12", "1", "5", "5")],
        "doc_id string, pos int, product_description string, part_number string, hsn_code string, quantity string, unit_price string, line_total string",
    )
    got = {r["pos"]: r for r in repair.line_items(items, texts).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1]["hsn_code"], got[1]["hsn_note"]) == ("8481 80 90", "row")
    assert (got[1]["unit_price"], got[1]["line_total"], got[1]["price_note"]) == ("1750.00", "3500.00", "shifted")
    assert (got[2]["unit_price"], got[2]["line_total"], got[2]["hsn_note"]) == ("22.65", "226.50", None)
    assert (got[4]["hsn_code"], got[4]["price_note"], got[4]["amount_note"]) == ("12", None, None)


def test_many_items_meet_their_lines_by_grams(spark, monkeypatch):
    rows = [("d", i, f"PN-{i % 40}", f"Steel  valve number {i}" if i % 3 else None) for i in range(120)] + [("e", 1, "x", "short"), ("e", 2, None, "abcdefgh")]
    items = spark.createDataFrame(rows, "doc_id string, pos int, part_number string, product_description string")
    text = "\n".join(f"{i} │ xPN-{i % 50} │ STEEL valve  number {i}" for i in range(90)) + "\n\nab\n"
    texts = spark.createDataFrame([("d", text), ("e", "the ABCDEFGH\nx")], "doc_id string, text string")
    plain = sorted(map(tuple, tx.source_lines(items, texts).collect()))
    blocks = sorted(map(tuple, tx.source_blocks(items, texts).collect()))
    monkeypatch.setattr(tx, "MANY_ITEMS", 1)
    assert plain and sorted(map(tuple, tx.source_lines(items, texts).collect())) == plain
    assert sorted(map(tuple, tx.source_blocks(items, texts).collect())) == blocks


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_items_and_texts_meet_once_by_document(spark, monkeypatch):
    rows = [(i % 7, i, f"PN-{i}", f"Steel  valve number {i}", "12", "2", "5", "10") for i in range(60)] + [(99, 1, "PN-1", "", "160 84818090", "1", "1", "1")]
    items = spark.createDataFrame(rows, "doc_id int, pos int, part_number string, product_description string, hsn_code string, quantity string, unit_price string, line_total string")
    texts = spark.createDataFrame([(d, "\n".join(f"{i} │ PN-{i} │ 84818090 │ 5.00\n   10.00" for i in range(60) if i % 7 == d)) for d in range(7)] + [(98, None)], "doc_id int, text string")
    monkeypatch.setattr(tx, "MANY_ITEMS", 200)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        repaired, blocks = repair.line_items(items, texts), tx.item_blocks(items, texts)
        assert shuffles(repaired) == 2 and shuffles(blocks) == 2
        few = sorted(map(tuple, repaired.collect())), sorted(map(tuple, blocks.collect()))
        assert len(few[0]) == len(rows) and few[1] == sorted(map(tuple, tx.joined_blocks(tx.source_blocks(items, texts)).collect()))
        monkeypatch.setattr(tx, "MANY_ITEMS", 8)  # some documents are crowded, some are not
        assert (sorted(map(tuple, repair.line_items(items, texts).collect())), sorted(map(tuple, tx.item_blocks(items, texts).collect()))) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_items_are_numbered_without_their_maps(spark):
    raw = spark.createDataFrame([("d", 2, {"quantity": "2", "unit_price": '{"value": "5"}', "line_total": "$10", "part_no": "P"}), ("d", 1, {"product_description": "TOTAL", "line_total": "10"}), ("d", 3, {"quantity": "1", "item_ser_no": "9"}), ("d", 4, None)], "doc_id string, pos int, fields map<string,string>").repartition(2)
    cleaned = clean.items(raw)
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = next(plan[i + 1] for i, x in enumerate(plan) if "Window [row_number" in x)
    assert "fields" not in below  # what is sorted for the numbers
    assert [(r["pos"], r["item_ser_no"], r["part_number"], r["unit_price"]) for r in cleaned.orderBy("pos").collect()] == [(2, "1", "P", 5), (3, "9", "", None)]


def test_pages_chunks_headings_and_waybills(spark):
    text = TABLE + "=== PAGE 2 OF 2 (a) ===\nAir Waybill\nShipper's name and address\nNotify party\n"
    d = spark.createDataFrame([("d", text), ("e", "no page at all")], "doc_id string, text string")
    pages = tx.pages(d)
    assert {(r["doc_id"], r["page_no"]) for r in pages.collect()} == {("d", 1), ("d", 2), ("e", 1)}
    assert tx.page_chunks(pages).count() == 2
    assert d.select(tx.without_transport_pages("text").alias("x")).orderBy("x").collect()[0]["x"] == TABLE
    assert d.filter("doc_id = 'd'").select(tx.table_heading("text").alias("x")).first()["x"].startswith("Item No │ HSN")


def test_references_collapse_only_if_they_agree(spark):
    rows = [("a", "IO-5 / 10-5", "d1 / d1", "7 / 7.0"), ("b", "IO-5 / 10-5", "d1 / d2", ""), ("c", "A-1 / B-2", "", "")]
    d = spark.createDataFrame([(*r, "") for r in rows], "doc_id string, invoice_number string, invoice_date string, invoice_total string, invoice_text string")
    got = {r["doc_id"]: r for r in repair.collapsed_references(d).collect()}
    assert (got["a"]["invoice_number"], got["a"]["invoice_date"], got["a"]["invoice_total"]) == ("IO-5", "d1", "7")
    assert got["b"]["invoice_number"] == "IO-5 / 10-5" and got["c"]["invoice_number"] == "A-1 / B-2"


def test_supplier_formats(spark):
    formats = spark.createDataFrame([(r"(?i)\bACME\b", r"^SI\d{10}$", r"(?i)^[S5B8][I1l!|]1?(\d{10})$", "SI")], "supplier string, valid string, misread string, prefix string")
    heads = spark.createDataFrame([("a", "Acme Ltd", "511234567890", "no 1234567890"), ("b", "Other", "511234567890", "1234567890"), ("c", "Acme", "511234567890", "")], "doc_id string, supplier_name string, invoice_number string, invoice_text string")
    got = {r["doc_id"]: r["invoice_number"] for r in repair.supplier_numbers(heads, formats).collect()}
    assert got == {"a": "SI1234567890", "b": "511234567890", "c": "511234567890"}


def test_shipment_types(spark):
    texts = {"k": "SHIPPING  BILL for goods", "w": "egm igm", "r": "Country of origin: India │ Final destination: Germany", "b": "Buyer: ACME │ Bank: X\nPune India │ Berlin", "o": "Buyer's order no: India", "t": "shipped to India by Exporter: X"}
    d = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: (r["shipment_type"], r["signal"]) for r in classify.detect(d).collect()}
    assert got == {"k": ("export", "keyword"), "w": ("unknown", "keyword"), "r": ("export", "structural"), "b": ("import", "structural"), "o": ("unknown", "none"), "t": ("unknown", "none")}


def test_layout_from_glyphs_to_text(spark):
    glyphs = [("d", 1, i, c, 0.0, 8.0, 4.0 * i, 4.0 * i + 4) for i, c in enumerate("ab")] + [("d", 1, 9, "a", 0.2, 8.2, 0.3, 4.3), ("d", 1, 10, " ", 0.0, 8.0, 4.5, 7.5)]
    d = spark.createDataFrame(glyphs, "doc_id string, page_no int, seq int, text string, top double, bottom double, x0 double, x1 double")
    assert sorted(r["text"] for r in layout.without_overlaid_glyphs(d).collect()) == ["a", "b"]
    words = [("d", 1, f"L{i}", 0.0, 8.0, 10.0 * i, 10.0 * i + 8) for i in range(4)] + [("d", 1, f"R{i}", 80.0, 88.0, 10.0 * i, 10.0 * i + 8) for i in range(4)]
    w = layout.text_lines(spark.createDataFrame(words, "doc_id string, page_no int, text string, x0 double, x1 double, top double, bottom double"))
    edges = layout.column_boundaries(w)
    assert edges.first()["boundaries"] == [44.0, 76.0]
    text = layout.canvas(w, edges).first()["text"].split("\n")
    assert len(text) == 4 and all("│" in x and x.index("R") == 20 for x in text)


def plain_doubles(glyphs):
    """The rule read plainly, for one page."""
    stay = []
    for g in sorted(glyphs, key=lambda g: (g[4], g[6], g[2])):
        on = [k for k in stay[-12:] if k[3].isspace() == g[3].isspace() and abs(k[6] - g[6]) <= 1 and abs(k[4] - g[4]) <= max(1, 0.35 * (min(k[5] - k[4], g[5] - g[4]) or 1))]
        if not on:
            stay.append(g)
    return [(g[3], g[4], g[6]) for g in stay]


def test_doubled_glyphs_over_many_pages(spark):
    import random

    r = random.Random(4)
    glyphs = []
    for doc in "abcdefgh":
        for page in (1, 2):
            for seq in range(r.choice((1, 5, 80))):
                top, x0 = r.choice((0.0, 0.3, 1.2, 12.0)), round(r.random() * r.choice((3, 40)), 1)
                glyphs.append((doc, page, seq, r.choice("ab "), top, top + r.choice((0.0, 8.0)), x0, x0 + 4))
    glyphs += [("z", 1, i, "x", 0.0, 8.0, 0.01 * i, 4.0) for i in range(60)]
    d = spark.createDataFrame(glyphs, "doc_id string, page_no int, seq int, text string, top double, bottom double, x0 double, x1 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = layout.without_doubled_glyphs(d).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for doc, page in {(g[0], g[1]) for g in glyphs}:
        mine = [(g["text"], g["top"], g["x0"]) for g in sorted((g for g in got if (g["doc_id"], g["page_no"]) == (doc, page)), key=lambda g: g["seq"])]
        assert mine == plain_doubles([g for g in glyphs if g[:2] == (doc, page)])


def test_pages_from_glyphs(spark):
    def put(text, x, y, page=1):
        return [("d", page, i, c, y, y + 8.0, x + 5 * i, x + 5 * i + 5) for i, c in enumerate(text)]

    rows = [g for k in range(4) for g in put(f"item {k}", 10.0, 10.0 * k) + put(f"{k}7.50", 150.0, 10.0 * k)] + put("only", 0.0, 0.0, 2)
    glyphs = spark.createDataFrame([(*g[:2], i, *g[3:]) for i, g in enumerate(rows)], "doc_id string, page_no int, seq int, text string, top double, bottom double, x0 double, x1 double")
    assert sorted(r["text"] for r in layout.glyph_words(glyphs).collect()) == sorted(["item", "0", "07.50", "item", "1", "17.50", "item", "2", "27.50", "item", "3", "37.50", "only"])
    assert {r["char_width"] for r in layout.char_widths(glyphs).collect()} == {5.0}
    pages = spark.createDataFrame([("d", 1, 100.0, 50.0, None), ("d", 2, 100.0, 50.0, 1.0)], "doc_id string, page_no int, page_width double, page_height double, skew_deg double")
    got = {r["page_no"]: r["text"] for r in layout.page_canvas(glyphs, pages).collect()}
    assert got[1].split("\n")[0] == "  item 0" + " " * 11 + "│" + " " * 10 + "07.50" and len(got[1].split("\n")) == 4
    narrow = pages.withColumn("page_width", F.lit(55.0))
    assert layout.page_canvas(glyphs, narrow).filter("page_no = 1").first()["text"].split("\n")[0].endswith(" 0")


def test_deskew_keeps_boxes_and_small_tilts(spark):
    d = spark.createDataFrame([(1, 10.0, 20.0, 5.0, 9.0, s, 100.0, 100.0) for s in (0.1, 10.0)], "k int, x0 double, x1 double, top double, bottom double, skew_deg double, page_width double, page_height double")
    a, b = layout.deskewed(d).orderBy("skew_deg").collect()
    assert (a["x0"], a["top"]) == (10.0, 5.0)
    assert abs(b["x1"] - b["x0"] - 10) < 1e-9 and abs(b["x0"] - 10.0) > 1


def test_clipped_pages(spark):
    hit = [("c", 1, 0, y, 400, y, 600, 800) for y in (100, 200, 300)]
    near = [("n", 1, 0, y, 400, y, 600, 800) for y in (100, 120, 140)]
    d = spark.createDataFrame(hit + near, "doc_id string, page_no int, x1 int, y1 int, x2 int, y2 int, width int, height int")
    pages = spark.createDataFrame([("c", 1), ("n", 1), ("x", 1)], "doc_id string, page_no int")
    got = {r["doc_id"]: r for r in layout.scan_quality(pages, d).collect()}
    assert (got["c"]["clipped_edges"], got["c"]["valid"], got["c"]["skew_deg"]) == (["left"], False, 0.0)
    assert got["n"]["valid"] and got["x"]["reasons"] == ["no_grid"] and not got["x"]["valid"]


def test_answers_are_mended(spark):
    texts = ['{"a": 1}', '```json\n{"a": N/A, "b": 2,}\n```', "{'a': True, 'b': None}", 'so: {"a": [1, 2', "nothing"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id int, answer string")
    got = [r["json"] for r in extractors.parsed(d).orderBy("doc_id").collect()]
    assert got[0] == '{"a": 1}' and got[2] == '{"a": true, "b": null}' and got[3] == '{"a": [1, 2]}' and got[4] is None
    assert '"b": 2' in got[1]


def test_retry_loop_with_recorded_answers(spark):
    first = '{"line_items": [{"product_description": "WIDGET", "quantity": 10, "unit_price": 10, "line_total": 90}]}'
    second = first.replace("90", "100")
    header = '{"invoice_number": "I-1", "invoice_total": "100.00", "currency": "USD", "invoice_date": "2026-08-08"}'
    rows = [("d", "header", 1, header), ("d", "items", 1, first), ("d", "header", 2, header), ("d", "items", 2, second)]
    replay = extractors.Replay(spark.createDataFrame(rows, "doc_id string, pass string, attempt int, payload string"), t.HEADER_FIELDS)
    texts = spark.createDataFrame([("d", "WIDGET 10")], "doc_id string, text string")
    heads, wide, checks = retry.extract_and_validate(texts, replay)
    bad = {(r["attempt"], r["rule"]) for r in checks.collect() if r["status"] == "ERROR"}
    assert (1, "QTY_X_UNIT_PRICE") in bad and not any(a == 2 for a, _ in bad)
    assert float(wide.first()["ItmTaxableVal"]) == 100 and heads.first()["invoice_number"] == "I-1"


def test_files_names_and_summaries(spark, tmp_path):
    paths = spark.createDataFrame([("a/x.pdf",), ("b/X.pdf",), ("b/y.pdf",)], "path string")
    assert {r["out_name"] for r in folders.output_names(paths).collect()} == {"a__x", "b__X", "y"}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "p.txt").write_bytes(("page one has more than forty characters of text\fpage two").encode())
    (tmp_path / "in" / "q.txt").write_bytes(b" ")
    docs = folders.documents(spark, f"file:{tmp_path}/in", "*.txt")
    pages = readers.page_texts(docs, [("plain", readers.plain_text)]).collect()
    assert sorted((r["doc_id"].rsplit("/", 1)[-1], r["page_no"]) for r in pages) == [("p.txt", 1), ("p.txt", 2), ("q.txt", 1)]
    done = spark.createDataFrame([("ok", 1.5, 2, 10), ("skipped: x", 9.0, 0, 0), ("FAILED: y", 9.0, 0, 0)], "status string, cost_inr double, item_rows int, total_tokens int")
    assert folders.summary(done).first()[:4] == (1, 1, 1, 1.5)
    folders.write_summary(done, f"{tmp_path}/s")
    assert folders.read_summary(spark, f"{tmp_path}/s").columns[0] == "status"
    assert F is not None


def test_intake_stream_takes_each_file_once(spark, tmp_path):
    from ledgerline.streaming import intake

    job = tmp_path / "land" / "7"
    job.mkdir(parents=True)
    for name in ("a", "b"):
        (job / f"{name}.txt").write_text("SHIPPING BILL")
        entries = intake.landing(spark, str(tmp_path / "land"))
        intake.run(entries, lambda d: d.select("job_id", "file_name"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["job_id"], r["file_name"]) for r in got) == [("7", "a.txt"), ("7", "b.txt")]
