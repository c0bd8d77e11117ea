"""Invoice frames made from the star tables, in SQL that Spark and DuckDB both run.

Every frame is a text with table names in braces. Rows that break rules come from
remainders of keys, so each status of each rule occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

ORDERED = """
SELECT l_orderkey AS doc_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax, l_quantity) AS INT) AS pos,
       CAST(l_quantity AS DECIMAL(18,6)) AS q, CAST(CAST(CAST(floor(round(l_extendedprice * 100) / l_quantity + 0.5) AS BIGINT) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS p, CAST(l_tax * 100 AS DECIMAL(18,2)) AS rate
FROM {lineitem}
"""

ITEMS = f"""
SELECT doc_id, pos, part, supp, line, rate,
       CASE WHEN part % 17 = 0 THEN NULL ELSE q END AS quantity,
       CASE WHEN part % 11 = 0 THEN NULL WHEN part % 7 = 0 THEN CAST(p + 1 AS DECIMAL(18,2)) ELSE p END AS unit_price,
       CASE WHEN part % 13 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(q * p AS DECIMAL(18,2)) END AS line_amount,
       CASE WHEN part % 19 = 0 THEN CAST(q + 1 AS DECIMAL(18,6)) WHEN part % 23 = 0 THEN NULL ELSE q END AS tariff_qty,
       CASE WHEN part % 3 = 0 THEN 'NOS' WHEN part % 3 = 1 THEN 'k g' ELSE '' END AS unit,
       CASE WHEN part % 29 = 0 THEN 'PCS' WHEN part % 3 = 0 THEN 'nos' WHEN part % 3 = 1 THEN 'KG' ELSE 'X' END AS tariff_unit,
       CASE WHEN part % 5 = 0 THEN NULL WHEN part % 5 = 1 THEN 'de' ELSE 'IN' END AS country_of_origin,
       CASE WHEN part % 4 = 0 THEN '' WHEN part % 4 = 1 THEN '7' ELSE '07' END AS state_code,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(part % 4 AS DECIMAL(18,6)) END AS total_packages,
       CASE WHEN part % 31 = 0 THEN NULL ELSE CAST(CAST(q * p AS DECIMAL(18,2)) * CAST(rate AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) + CASE WHEN part % 6 = 0 THEN 1 ELSE 0 END END AS igst_amount,
       CASE WHEN part % 10 = 0 THEN '' WHEN part % 10 = 1 THEN '123' WHEN part % 10 = 2 THEN '12345' WHEN part % 10 = 3 THEN '8481 80' WHEN part % 10 = 4 THEN '8481' ELSE '84818090' END AS hsn,
       CASE WHEN part % 37 = 0 THEN NULL ELSE CAST(line AS VARCHAR(10)) END AS ser_no,
       CASE WHEN part % 8 = 0 THEN 'VALVE' ELSE concat('VALVE P/N: P-', CAST(part AS VARCHAR(20)), CASE WHEN part % 2 = 0 THEN ' Type: T7' ELSE '' END) END AS description,
       CASE WHEN part % 9 = 0 THEN '' WHEN part % 9 = 1 THEN 'P-0' ELSE concat('p-', CAST(part AS VARCHAR(20))) END AS part_number,
       CASE WHEN part % 12 = 0 THEN '' WHEN part % 12 = 6 THEN 'T8' ELSE 't7' END AS model_or_type,
       CASE WHEN part % 14 = 0 THEN '' WHEN part % 14 < 5 THEN concat('PO', CAST(doc_id AS VARCHAR(20))) ELSE 'PO999X' END AS order_number
FROM ({ORDERED}) o
"""

HEADERS = f"""
SELECT o_orderkey AS doc_id,
       CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'A-1 / A-2' ELSE concat('INV-', CAST(o_orderkey AS VARCHAR(20))) END AS invoice_number,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(s.total AS VARCHAR(40)) WHEN o_orderkey % 5 = 1 THEN CAST(CAST(s.total + 100 AS DECIMAL(28,2)) AS VARCHAR(40)) WHEN o_orderkey % 5 = 2 THEN CAST(CAST(s.total + 50 AS DECIMAL(28,2)) AS VARCHAR(40)) WHEN o_orderkey % 5 = 3 THEN CAST(CAST(s.total - 1 AS DECIMAL(28,2)) AS VARCHAR(40)) ELSE NULL END AS invoice_total,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'soon' ELSE '2026-8-9' END AS invoice_date,
       CASE WHEN o_orderkey % 4 = 0 THEN 'EURO' WHEN o_orderkey % 4 = 1 THEN 'XYZ' WHEN o_orderkey % 4 = 2 THEN '' ELSE 'usd' END AS currency,
       CASE WHEN o_orderkey % 3 = 0 THEN '27ABCDE1234F1Z5' WHEN o_orderkey % 3 = 1 THEN '27ABCDE1234F1Z' ELSE NULL END AS supplier_tax_id,
       CASE WHEN o_orderkey % 7 = 0 THEN '1234567-8901234' WHEN o_orderkey % 7 = 1 THEN '12345' ELSE '' END AS ad_code,
       CASE WHEN o_orderkey % 8 = 0 THEN 'abcde12345' WHEN o_orderkey % 8 = 1 THEN 'AB' ELSE NULL END AS iec_number,
       CASE WHEN o_orderkey % 2 = 0 THEN 'I N' WHEN o_orderkey % 9 = 0 THEN '' ELSE 'DE' END AS country_of_origin,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '7' END AS state_code,
       CASE WHEN o_orderkey % 7 = 3 THEN '' WHEN o_orderkey % 7 = 4 THEN '2' ELSE CAST(s.packs AS VARCHAR(40)) END AS total_packages,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('P/O: PO', CAST(o_orderkey AS VARCHAR(20)), chr(10), 'ADD AIR FREIGHT:-  100.00', chr(10), 'LESS TRADE DISCOUNT 0.25%:-  2.00', chr(10), 'Rate 9.00%', chr(10), 'ADD PACKING 3.00', chr(10), 'ADD PACKING 3.00') END AS invoice_text
FROM {{orders}} LEFT JOIN (
  SELECT doc_id, CAST(sum(CASE WHEN part % 13 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(q * p AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS total, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE part % 4 END) AS BIGINT) AS packs
  FROM ({ORDERED}) o GROUP BY doc_id) s ON o_orderkey = s.doc_id
"""


#: ORDERED for Spark, with the same rows: numbered by the key under its new name, or Spark would not know that a document's rows lie together already.
_LYING = ORDERED.replace("SELECT l_orderkey AS doc_id,", "SELECT doc_id,").replace("PARTITION BY l_orderkey", "PARTITION BY doc_id").replace("FROM {lineitem}", "FROM (SELECT l_orderkey AS doc_id, * FROM {lineitem}) AS named")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A frame in Spark, from the Parquet tables of `sf_dir` that it names."""
    sql = sql.replace(ORDERED, _LYING)
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **named)


def duck(sql: str) -> str:
    """The frame's text for DuckDB, where the tables are views."""
    return sql.format(**{t: t for t in TABLES})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, ITEMS)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, HEADERS)
