"""Audits seen in the driver's tables: SELECT statements that Spark and DuckDB both read, and the DataFrames they give.

Each nation is an audit. An invoice is an order's lines of one supplier, and belongs to the customer's nation. A part is an
article; its brand and type are the ware that it is booked on, its size decides what its description prints.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .shared import stored

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_BRAND = "CAST(substr(p_brand, 7) AS BIGINT)"
_NAME = "p_name || CASE p_size % 6 WHEN 0 THEN ' 24 x 0,33 l' WHEN 1 THEN ' 0,7 l 38% vol' WHEN 2 THEN ' Karton 5 kg' WHEN 3 THEN ' 20 Stk' WHEN 4 THEN ' 6 x 0,7' ELSE '' END"
_ON = "CAST(NULL AS DATE)"

#: One SELECT per view; a view may name the driver's tables and views above it.
VIEWS: dict[str, str] = {
    "wares": f"""
        SELECT DISTINCT 'prod.' || p_brand || '.' || p_type AS product_id, p_brand || ' ' || p_type AS name,
               CASE p_type WHEN 'ECONOMY' THEN 'MLT' WHEN 'SMALL' THEN 'LTR' WHEN 'LARGE' THEN 'GRM' WHEN 'STANDARD' THEN 'KGM' ELSE 'H87' END AS unit,
               CAST(1 AS BIGINT) AS batch, 'cat.' || p_type AS category_id,
               CASE WHEN p_type IN ('PROMO', 'MEDIUM') THEN CAST(400 AS BIGINT) WHEN p_type = 'LARGE' THEN CAST(150 AS BIGINT) END AS piece_amount,
               CASE WHEN p_type IN ('PROMO', 'MEDIUM', 'LARGE') THEN 'g' END AS piece_unit,
               {_BRAND} AS brand, p_type AS kind,
               {_ON} AS valid_from, CASE WHEN {_BRAND} = 25 THEN DATE '1996-01-01' END AS valid_to
        FROM part""",
    "products": f"""
        SELECT product_id, name, unit, batch, category_id, piece_amount, piece_unit, valid_from, valid_to FROM wares
        UNION ALL
        SELECT 'sold.a.' || CAST(brand AS STRING), 'Teller ' || CAST(brand AS STRING), 'H87', CAST(2 AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), {_ON}, {_ON}
        FROM (SELECT DISTINCT brand FROM wares) a
        UNION ALL
        SELECT 'sold.b.' || CAST(brand AS STRING), 'Menü ' || CAST(brand AS STRING), 'H87', CAST(1 AS BIGINT), 'cat.PROMO', CAST(NULL AS BIGINT), CAST(NULL AS STRING), {_ON}, {_ON}
        FROM (SELECT DISTINCT brand FROM wares) b
        UNION ALL
        SELECT 'prod.pfand', 'Pfand', 'H87', CAST(1 AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), {_ON}, {_ON}""",
    "recipes": """
        SELECT 'sold.a.' || CAST(brand AS STRING) AS product_id, CAST(1 AS BIGINT) AS ord, product_id AS part_id, CAST(300 AS BIGINT) AS amount, 'MLT' AS unit FROM wares WHERE kind = 'ECONOMY'
        UNION ALL
        SELECT 'sold.a.' || CAST(brand - 1 AS STRING), CAST(2 AS BIGINT), product_id, CAST(175 AS BIGINT), 'GRM' FROM wares WHERE kind = 'LARGE' AND brand > 1
        UNION ALL
        SELECT 'sold.b.' || CAST(brand AS STRING), CAST(1 AS BIGINT), 'sold.a.' || CAST(brand AS STRING), CAST(1 AS BIGINT), 'stk' FROM wares WHERE kind = 'ECONOMY'
        UNION ALL
        SELECT 'sold.b.' || CAST(brand AS STRING), CAST(2 AS BIGINT), product_id, CAST(25 AS BIGINT), 'cl' FROM wares WHERE kind = 'SMALL'
        UNION ALL
        SELECT 'sold.b.' || CAST(brand AS STRING), CAST(3 AS BIGINT), product_id, CAST(90 AS BIGINT), 'ml' FROM wares WHERE kind = 'ECONOMY'""",
    "categories": """
        SELECT DISTINCT category_id, kind AS name,
               CASE kind WHEN 'ECONOMY' THEN 'getraenke' WHEN 'SMALL' THEN 'getraenke' WHEN 'LARGE' THEN 'speisen' WHEN 'STANDARD' THEN 'speisen' WHEN 'PROMO' THEN 'handelsware' ELSE 'unbestimmt' END AS division
        FROM wares""",
    "cases": """
        SELECT 'case.' || CAST(n_nationkey AS STRING) AS case_id, n_name AS label, DATE '1995-01-01' AS period_from, DATE '2001-12-31' AS period_to,
               CASE n_nationkey % 5 WHEN 0 THEN '56101' WHEN 1 THEN '5610' WHEN 2 THEN '47110' WHEN 3 THEN '' ELSE '10710' END AS gewerbe, CAST(n_nationkey AS BIGINT) AS case_no
        FROM nation""",
    "lines": f"""
        SELECT 'case.' || CAST(c_nationkey AS STRING) AS case_id, 'inv.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS invoice_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS BIGINT) AS ord,
               CAST(l_linenumber AS BIGINT) AS no, s_name AS supplier_name, CAST(l_orderkey AS STRING) AS number, CAST(o_orderdate AS DATE) AS date,
               {_NAME} AS name, CAST(l_partkey AS STRING) AS seller_article_id,
               CASE WHEN l_partkey % 7 = 0 THEN '40' || lpad(CAST(l_partkey AS STRING), 11, '0') END AS gtin,
               CAST(round(l_quantity * 1000) AS BIGINT) * CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE 1 END AS quantity,
               CASE p_size % 5 WHEN 0 THEN 'XKG' WHEN 1 THEN 'XCS' WHEN 2 THEN 'KGM' WHEN 3 THEN 'l.' ELSE CASE WHEN p_size % 3 = 0 THEN '' ELSE 'H87' END END AS unit_code,
               CAST(round(l_extendedprice / l_quantity * 1000000) AS BIGINT) AS unit_price, CAST(1000 AS BIGINT) AS price_base_qty,
               CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN -1 ELSE 1 END AS line_net,
               CAST(CASE WHEN l_tax < 0.03 THEN 0 WHEN l_tax < 0.06 THEN 700 ELSE 1900 END AS BIGINT) AS vat,
               CASE WHEN l_partkey % 41 = 0 THEN 'map.g.' || CAST(l_partkey AS STRING) END AS mapping_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "invoices": """
        SELECT case_id, invoice_id, supplier_name, number, date, sum(line_net) AS net_total, sum(line_net) + CAST(count(*) AS BIGINT) AS gross_total,
               CASE WHEN CAST(number AS BIGINT) % 3 = 0 THEN sum(line_net) WHEN CAST(number AS BIGINT) % 3 = 1 THEN sum(line_net) + 1 END AS stated_net,
               CASE WHEN CAST(number AS BIGINT) % 2 = 0 THEN sum(line_net) END AS stated_gross,
               CASE WHEN CAST(number AS BIGINT) % 4 = 0 THEN 'ubl' ELSE 'scan' END AS source
        FROM lines GROUP BY case_id, invoice_id, supplier_name, number, date""",
    "mappings": f"""
        SELECT 'map.a.' || CAST(l_suppkey AS STRING) || '.' || CAST(l_partkey AS STRING) AS mapping_id, s_name AS supplier_name, CAST(l_partkey AS STRING) AS seller_article_id,
               CAST(NULL AS STRING) AS gtin, CAST(NULL AS STRING) AS name, CASE WHEN l_partkey % 11 = 0 THEN 'xcs' END AS unit_code,
               CASE WHEN l_partkey % 50 = 0 THEN 'prod.pfand' ELSE 'prod.' || p_brand || '.' || p_type END AS product_id,
               CASE WHEN l_partkey % 4 = 0 THEN 500 * (1 + l_partkey % 9) END AS factor, true AS confirmed,
               {_ON} AS valid_from, CASE WHEN l_suppkey % 10 = 0 THEN DATE '1998-01-01' END AS valid_to
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE (l_suppkey + l_partkey) % 3 = 0) pairs JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        UNION ALL
        SELECT 'map.g.' || CAST(p_partkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '40' || lpad(CAST(p_partkey AS STRING), 11, '0'), CAST(NULL AS STRING), CAST(NULL AS STRING),
               'prod.' || p_brand || '.' || p_type, CAST(NULL AS BIGINT), p_partkey % 2 = 0, DATE '1996-07-01', {_ON}
        FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 41 = 0
        UNION ALL
        SELECT 'map.n.' || CAST(p_partkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), upper({_NAME}) || ' !', CAST(NULL AS STRING),
               'prod.' || p_brand || '.' || p_type, CASE WHEN p_partkey % 4 = 0 THEN 330 * p_size END, false, {_ON}, {_ON}
        FROM part WHERE p_partkey % 20 = 3""",
    "case_products": """
        SELECT case_id, product_id, CAST(ord AS BIGINT) AS ord, gross_price, vat FROM (
            SELECT case_id, product_id, row_number() OVER (PARTITION BY case_id ORDER BY product_id) AS ord, gross_price, vat FROM (
                SELECT case_id, 'sold.a.' || CAST(brand AS STRING) AS product_id, CASE WHEN brand % 7 = 0 THEN 0 ELSE 900 + 10 * brand END AS gross_price, CAST(1900 AS BIGINT) AS vat
                FROM cases CROSS JOIN (SELECT DISTINCT brand FROM wares) a WHERE (brand + case_no) % 3 = 0
                UNION ALL
                SELECT case_id, 'sold.b.' || CAST(brand AS STRING), 1900 + 10 * brand, CAST(700 AS BIGINT) FROM cases CROSS JOIN (SELECT DISTINCT brand FROM wares) b WHERE (brand + case_no) % 5 = 0
                UNION ALL
                SELECT case_id, product_id, 300 + brand, CAST(1900 AS BIGINT) FROM cases CROSS JOIN wares WHERE kind = 'PROMO' AND (brand + case_no) % 4 <> 1
            ) p
        ) q""",
    "demand": """
        SELECT case_id, case_products.product_id, 0 AS route, part_id, amount FROM case_products JOIN recipes ON recipes.product_id = case_products.product_id""",
    "taken": """
        SELECT case_id, product_id, 0 AS route, (ord * 7) % 50 AS portions FROM case_products""",
    "printed": """
        SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS ord, p_name AS name,
               CAST(l_quantity AS BIGINT) + 1 AS quantity, l_partkey * 37 % 4990 + 10 AS price, (CAST(l_quantity AS BIGINT) + 1) * (l_partkey * 37 % 4990 + 10) AS net,
               CASE l_partkey % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'Stk' ELSE 'Ltr' END AS unit, CAST(o_orderdate AS DATE) AS date
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "category_codes": """
        SELECT category_id, CASE name WHEN 'ECONOMY' THEN '56' WHEN 'SMALL' THEN '5610' ELSE '471' END AS code FROM categories WHERE name IN ('ECONOMY', 'SMALL', 'LARGE')""",
    "no_revenue": """
        SELECT case_id, product_id FROM cases CROSS JOIN wares WHERE (kind = 'PROMO' OR kind = 'ECONOMY') AND (brand + case_no) % 8 = 0""",
    "inventory": """
        SELECT case_id, product_id, CAST(1 AS BIGINT) AS ord, 1000 * brand AS opening, 400 * brand AS closing, CASE WHEN kind = 'ECONOMY' THEN 'cl' WHEN kind = 'SMALL' THEN 'KGM' ELSE unit END AS unit
        FROM cases CROSS JOIN wares WHERE (brand + case_no) % 4 = 1
        UNION ALL
        SELECT case_id, product_id, CAST(2 AS BIGINT), 500 * brand, 90000000 * brand, unit FROM cases CROSS JOIN wares WHERE kind = 'LARGE' AND (brand + case_no) % 12 = 1""",
    "yield_rules": """
        SELECT 'yield.' || category_id AS rule_id, category_id, CAST(NULL AS STRING) AS product_id, CAST(CASE name WHEN 'ECONOMY' THEN 500 WHEN 'LARGE' THEN 1250 ELSE 300 END AS BIGINT) AS deduction, name <> 'PROMO' AS is_default FROM categories
        UNION ALL
        SELECT 'yield.' || product_id, CAST(NULL AS STRING), product_id, 20 * brand, brand % 2 = 0 FROM wares WHERE kind = 'LARGE'""",
    "yield_choices": """
        SELECT case_id, CAST(1 AS BIGINT) AS ord, product_id, CAST(NULL AS STRING) AS category_id, CASE WHEN brand % 3 = 0 THEN 'yield.cat.ECONOMY' WHEN brand % 3 = 1 THEN 'yield.gone' END AS rule_id
        FROM cases CROSS JOIN wares WHERE kind IN ('ECONOMY', 'LARGE') AND (brand + case_no) % 6 = 0
        UNION ALL
        SELECT case_id, CAST(2 AS BIGINT), CAST(NULL AS STRING), category_id, CASE WHEN case_no % 2 = 0 THEN 'yield.cat.LARGE' END FROM cases CROSS JOIN categories WHERE name = 'ECONOMY' AND case_no % 3 = 0""",
    "declared": """
        SELECT 'case.' || CAST(c_nationkey AS STRING) AS case_id, CAST(CASE o_custkey % 4 WHEN 0 THEN 700 WHEN 1 THEN 0 WHEN 2 THEN 1600 ELSE 1900 END AS BIGINT) AS vat, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS net
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "segments": """
        SELECT c_mktsegment AS segment, CAST(row_number() OVER (ORDER BY c_mktsegment) AS BIGINT) AS class_ord FROM (SELECT DISTINCT c_mktsegment FROM customer) s""",
    "segment_years": """
        SELECT CAST(year(o_orderdate) AS BIGINT) AS year, c_mktsegment AS segment, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "guideline": """
        SELECT year, class_ord, 'Klasse ' || segment AS class_name, CASE class_ord WHEN 1 THEN '561' WHEN 2 THEN '4711' WHEN 3 THEN '10710' WHEN 4 THEN '1071' ELSE '5610' END AS code, CAST(band AS BIGINT) AS band,
               CASE WHEN band > 0 THEN CAST(band * floor(total / 20) AS BIGINT) END AS above, CASE WHEN band < 2 THEN CAST((band + 1) * floor(total / 20) AS BIGINT) END AS upto,
               CASE WHEN band <> 1 OR class_ord <> 2 THEN CAST(10000 + n % 100 + 1000 * band AS BIGINT) END AS rate_from, CAST(30000 + n % 100 + 1000 * band AS BIGINT) AS rate_to, CAST(20000 + n % 100 AS BIGINT) AS rate_mean
        FROM segment_years JOIN segments USING (segment) CROSS JOIN (SELECT 0 AS band UNION ALL SELECT 1 UNION ALL SELECT 2) b WHERE year % 2 = 0""",
}


def needs(sql: str) -> list[str]:
    """Views that a statement names, in the order they have to stand in."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for v in VIEWS:
            if v not in found and re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text):
                found.add(v)
                todo.append(VIEWS[v])
    return [v for v in VIEWS if v in found]


def oracle(sql: str, recursive: bool = False) -> str:
    """A DuckDB statement with the views that it names put in front."""
    body = sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needs(body))
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own and ctes:
        recursive = recursive or bool(own[1])
        body = body[own.end() :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{body}"
    return f"WITH {ctes}\n{body}" if ctes else body


class Audits:
    """The views as DataFrames over one folder of the driver's tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            sql = VIEWS[name]
            uses = {}
            for t in (*BASE, *VIEWS):
                if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql):
                    sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}} AS {t}", sql)
                    uses[t] = getattr(self, t) if t in VIEWS else self.table(t)
            self._made[name] = self.spark.sql(sql, **uses)
        return self._made[name]

    def write(self, name: str, *columns: str) -> DataFrame:
        """A view with these columns, written; views that are made of it from now on read it there."""
        self._made[name] = stored(getattr(self, name).select(*columns), name)
        return self._made[name]
