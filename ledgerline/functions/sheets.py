"""The wide sheets' templates: columns with types, aliases and links, as a table, as schemas, and from a workbook."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables as t
from . import values as v

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def template_columns(spark: SparkSession, sheets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(sheet, pos, name, type, alias, is_link) of every column, pos from 0; the built-in item sheets unless others are given."""
    sheets = sheets or {t.EXPORT_SHEET: t.ITEM_COLUMNS, t.IMPORT_SHEET: t.BOE_COLUMNS}
    rows = [(sheet, i, name) for sheet, names in sheets.items() for i, name in enumerate(names)]
    return described(spark.createDataFrame(rows, "sheet string, pos int, name string"))


def described(names: DataFrame) -> DataFrame:
    """Column names (sheet, pos, name) with what they say: a type, an alias, and whether they link sheets."""
    link = F.lower(F.replace("name", F.lit(" "), F.lit("_"))).isin(*t.LINK_COLUMNS)
    return names.select("sheet", "pos", "name", v.column_type("name").alias("type"), v.column_alias("name").alias("alias"), link.alias("is_link"))


def sheet_schema(columns: DataFrame, sheet: str) -> T.StructType:
    """The row type of a sheet of template_columns(): numbers are decimals, all else texts, all may be missing; aliases are comments."""
    rows = columns.filter(F.col("sheet") == sheet).orderBy("pos").collect()  # a template's columns
    kinds = {"number": T.DecimalType(18, 6)}
    return T.StructType([T.StructField(r["name"], kinds.get(r["type"], T.StringType()), True, {"comment": r["alias"]}) for r in rows])


def typed(rows: DataFrame, schema: T.StructType, keep=("doc_id", "pos")) -> DataFrame:
    """Rows of texts as the schema's types, in its order. `misfits` names the columns whose text is no such value, `unknown` the columns that the sheet does not have."""
    have = set(rows.columns)
    cell = lambda f: v.filled(f"`{f.name}`") if f.name in have else F.lit(None).cast("string")
    cast = lambda f: cell(f).try_cast(f.dataType)
    misfits = [F.when(cell(f).isNotNull() & cast(f).isNull(), f.name) for f in schema.fields if f.name in have and not isinstance(f.dataType, T.StringType)]
    unknown = [F.when(v.filled(f"`{c}`").isNotNull(), c) for c in rows.columns if c not in schema.names and c not in (*keep, *t.EXTRA_COLUMNS)]
    listed = lambda names: F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return rows.select(*keep, *[cast(f).alias(f.name, metadata=f.metadata) for f in schema.fields], listed(misfits).alias("misfits"), listed(unknown).alias("unknown"))


def read_workbook(content: bytes) -> dict[str, tuple[str, ...]]:
    """The column names of every sheet of an .xlsx workbook: the first row that has any, blank cells left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(x.text or "" for x in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_LINK)]
            page = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            rows = ([_cell(c, shared) for c in row.iter(f"{_MAIN}c")] for row in page.iter(f"{_MAIN}row"))
            out[sheet.get("name", "")] = next((tuple(x for x in row if x) for row in rows if any(row)), ())
    return out


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        text = "".join(x.text or "" for x in cell.iter(f"{_MAIN}t"))
    else:
        value = cell.find(f"{_MAIN}v")
        text = "" if value is None or value.text is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
    return re.sub(r"\s+", " ", text).strip()
