"""Queries of sources, readings and display strings over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..shared import scratch
from ..sources import tables
from ..views import Audits
from .audit_queries import steps

SETUP = "reader 1\n"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents: the first half is read and kept, then all are looked up by their content."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("content"))
    store = scratch(spark, "readings")
    tables.keep_readings(pages.filter("page_id % 2 = 0").withColumn("reading", F.length("content").cast("string")), SETUP, store)
    known, unknown = tables.find_readings(pages, SETUP, spark.read.parquet(store))
    return known.select("page_id", "key", "reading").unionByName(unknown.select("page_id", "key", F.lit(None).cast("string").alias("reading")))


def saved_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices written by case, some cases written again with other totals, and all read back."""
    v, folder = Audits(spark, sf_dir), scratch(spark, "cases")
    tables.save_cases({"invoices": v.invoices.select("case_id", "invoice_id", "net_total")}, folder)
    tables.save_cases({"invoices": v.invoices.filter("case_id in ('case.1', 'case.2')").select("case_id", "invoice_id", (F.col("net_total") + 1).alias("net_total"))}, folder)
    return tables.load_cases(spark, folder, ["invoices"])["invoices"].groupBy("case_id").agg(F.count("*").alias("n"), F.sum("net_total").alias("net"))


def display_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Audits(spark, sf_dir)
    rows = v.lines.select("line_net", "quantity", "vat", "date").distinct()
    return rows.select("line_net", "quantity", "vat", "date", formats.cents(F.col("line_net")).alias("net_text"), formats.milli(F.col("quantity")).alias("quantity_text"), formats.basis_points(F.col("vat")).alias("vat_text"), formats.date(F.col("date")).alias("date_text"))


QUERIES = {"readings": readings, "saved_cases": saved_cases, "display_strings": display_strings}
_GROUP = "regexp_replace(regexp_replace(regexp_replace({0}, '^([0-9]+)([0-9]{{3}})$', '\\1.\\2'), '^([0-9]+)([0-9]{{3}})[.]', '\\1.\\2.'), '^([0-9]+)([0-9]{{3}})[.]', '\\1.\\2.')"
ORACLES = {k: steps(s) for k, s in {
    "readings": """WITH k AS (SELECT page_id, sha256('reader 1' || chr(10) || html) AS key, CAST(length(html) AS STRING) AS reading FROM pages)
        SELECT k.page_id, k.key, e.reading FROM k LEFT JOIN (SELECT key, min(reading) AS reading FROM k WHERE page_id % 2 = 0 GROUP BY key) e ON e.key = k.key""",
    "saved_cases": "SELECT case_id, count(*) AS n, CAST(sum(net_total) + CASE WHEN case_id IN ('case.1', 'case.2') THEN count(*) ELSE 0 END AS BIGINT) AS net FROM invoices GROUP BY case_id",
    "display_strings": f"""SELECT DISTINCT line_net, quantity, vat, date, CASE WHEN line_net < 0 THEN '-' ELSE '' END || {_GROUP.format("CAST(abs(line_net) // 100 AS STRING)")} || ',' || lpad(CAST(abs(line_net) % 100 AS STRING), 2, '0') || ' €' AS net_text,
        {_GROUP.format("CAST(quantity // 1000 AS STRING)")} AS quantity_text, CAST(vat // 100 AS STRING) || ' %' AS vat_text, strftime(date, '%d.%m.%Y') AS date_text FROM lines""",
}.items()}
