"""Queries over the driver's tables: checks, guideline, groups, ranking, revenue; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import checks, groups, guideline, ranking, revenue
from ..shared import stored
from ..views import Audits
from .audit_queries import _CANON, Audit, _q, steps
from .calculate import REPORTED, Cases, Rules, calculate


def whole(spark: SparkSession, sf_dir: str):
    """The calculation over all audits of the driver's tables."""
    v = Audits(spark, sf_dir)
    pinned = v.case_products.filter("product_id like 'sold.a.%' and ord % 5 = 0").selectExpr("case_id", "product_id", "ord * 10 as portions")
    return calculate(Cases(v.cases, v.lines, v.case_products, v.inventory, v.no_revenue, v.yield_choices, pinned, v.declared), Rules(v.products, v.categories, v.recipes, v.mappings, v.yield_rules), kept=REPORTED)


def _flags(a: Audit) -> DataFrame:
    return checks.check_invoices(a.v.invoices, a.v.lines)


def _verified(a: Audit, automatic: bool = True) -> DataFrame:
    """Invoices verified, from lines written once with the columns that the checks read."""
    lines = a.v.write("lines", "case_id", "invoice_id", "supplier_name", "number", "date", "no", "quantity", "unit_code", "unit_price", "price_base_qty", "line_net", "vat")
    return checks.verify(a.v.invoices, lines, _flags(a), automatic)


def _state(a: Audit) -> DataFrame:
    m = a.v.mappings.select(F.col("mapping_id").alias("match_id"), "confirmed")
    return a.matched().select("case_id", "invoice_id", "ord", "match_id").join(m, "match_id", "left").select("case_id", "invoice_id", "ord", "confirmed")


def _revenue(a: Audit) -> DataFrame:
    """Revenue per case as the driver's orders have it, for the guideline."""
    d = a.v.declared.groupBy("case_id").agg(F.sum("net").alias("revenue"))
    cost = a.v.lines.groupBy("case_id").agg(F.sum(F.abs("line_net")).alias("cost"))
    return d.join(cost, "case_id").select("case_id", "revenue", numbers.markup(F.col("revenue"), F.col("cost")).alias("markup"))


def _by_rate(a: Audit) -> DataFrame:
    return a.v.lines.groupBy("case_id", "vat").agg(F.sum("line_net").alias("net"))


def _vectors(spark: SparkSession, sf_dir: str):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    none = F.array().cast("array<string>")
    pack = lambda k: F.when(F.col("vec_id") % k == 0, F.array(F.lit("XKG"))).when(F.col("vec_id") % k == 1, F.array(F.lit("XCS"), F.lit("XBO"))).otherwise(none)
    date, none_on = F.lit("2020-06-01").cast("date").alias("date"), F.lit(None).cast("date")
    truth = F.concat(F.lit("ware."), F.col("label").cast("string"))
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), date, pack(40).alias("held"), truth.alias("truth"))
    wordings = e.select(truth.alias("ware_id"), F.col("embedding").alias("vec"), none_on.alias("valid_from"), none_on.alias("valid_to"), pack(3).alias("packages"))
    return queries, wordings


def rank_wares(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, wordings = _vectors(spark, sf_dir)
    return ranking.rank_wares(queries, wordings).select("query_id", "ware_id", "rank")


def top_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, wordings = _vectors(spark, sf_dir)
    ranked = ranking.rank_wares(queries, wordings, n=6)
    exact = queries.filter("query_id % 300 = 0").select("query_id", F.col("truth").alias("ware_id"))
    return ranking.top_suggestions(ranked, exact, 4.0, -2.0).select("query_id", "ware_id", "source")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple guess of each labelled document's quality against its label."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    label = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return label.join(d, "doc_id").select("doc_id", "lang", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("truth"), F.when(F.col("n_chars") > 1500, "q1").otherwise("q0").alias("pred"))


def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.class_f1(_labelled(spark, sf_dir)).select("class", "hit", "predicted", "support", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.macro_f1(ranking.class_f1(_labelled(spark, sf_dir))).select("classes", F.round("macro_f1", 9).alias("macro_f1"))


def automatic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select((F.pmod("doc_id", F.lit(99)) + 1).cast("int").alias("confidence"), (F.col("truth") == F.col("pred")).alias("hit"))
    return ranking.automatic_share(rows).select("n", "automatic", F.round("share", 9).alias("share"), F.round("precision", 9).alias("precision"))


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("lang").alias("grp"), (F.col("doc_id") % 7 != 0).alias("expected"), (F.col("truth") == F.col("pred")).alias("hit1"), ((F.col("truth") == F.col("pred")) | (F.col("doc_id") % 3 == 0)).alias("hit5"))
    return ranking.match_report(rows)


def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), (F.pmod("doc_id", F.lit(99)) + 1).cast("int").alias("confidence"), (F.col("truth") == F.col("pred")).alias("hit"))
    return ranking.coverage_curve(rows).select("share", "n", F.round(F.col("precision") * F.col("n")).cast("bigint").alias("hits"))


def latest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as a change log of rules: the user is the entity, the event its revision, an error its deletion."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("product").alias("kind"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("rev"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("deleted_at"), F.col("props").alias("content"))
    return groups.latest_rules(log).select("kind", "id", "rev", "content")


def diff_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns the rules of now back into those of half way through the log."""
    deleted = F.when(F.col("event_type") == "error", F.col("event_id")).alias("deleted_at")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("product").alias("kind"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("rev"), deleted, F.col("props").alias("content"))
    half = e.agg(F.floor(F.max("rev") / 2).alias("half"))  # one row
    return groups.diff_rules(groups.latest_rules(e), groups.latest_rules(e.crossJoin(F.broadcast(half)).filter("rev <= half").drop("half")))


def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.concat("pred", F.lit("."), "lang").alias("pred"), F.concat("truth", F.lit("."), "lang").alias("truth"))
    return ranking.confusions(rows)


def unify_suppliers(a: Audit) -> DataFrame:
    fresh = a.v.invoices.withColumn("fresh", F.pmod(F.col("number").cast("bigint"), F.lit(3)) == 0).select("case_id", "invoice_id", "supplier_name", "source", "fresh")
    return groups.unify_suppliers(fresh, a.v.lines).select("case_id", "invoice_id", "unified")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("s")
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.col("s_name"), F.lit(" GmbH & Co. Öl-Groß")).alias("s")).unionByName(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper("p_name").alias("s")).distinct())
    return names.select("s", text.canonical_name(c).alias("canonical"), text.supplier_key(c).alias("key"), text.heading_norm(c).alias("heading"), text.fold_german(c).alias("folded"), text.title_if_upper(c).alias("title"), text.split_of(c, 0.2).alias("split"))


def integer_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("l_quantity").cast("bigint") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) * F.col("l_partkey")).alias("n")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(n, (F.col("l_suppkey") + 1).alias("d")).distinct()
    return rows.select("n", "d", numbers.trunc_div(F.col("n"), F.col("d")).cast("bigint").alias("cut"), numbers.round_div(F.col("n"), F.col("d")).alias("rounded"), numbers.gcd(F.abs("n"), F.col("d")).alias("gcd"), numbers.markup(F.col("n"), F.col("d")).alias("markup"))


def parse_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("t")).distinct()
    c = F.col("t")
    return t.select("t", numbers.parse_scaled(c, 2).alias("cents"), numbers.parse_scaled(c, 3).alias("milli"), numbers.parse_scaled(c, 0, rounding=True).alias("whole"), numbers.parse_scaled(F.concat(c, F.lit("x")), 2).alias("bad"), numbers.parse_scaled(F.concat(c, F.lit("5")), 2).alias("surplus"))


QUERIES = {
    "check_invoices": _q(_flags),
    "verify_invoices": _q(lambda a: _verified(a).select("case_id", "invoice_id", "n_flags", "n_blocking", "accepted")),
    "confirm_invoices": _q(lambda a: _verified(a, automatic=False).groupBy("case_id", "accepted").agg(F.count("*").alias("n"))),
    "validate_rules": _q(lambda a: checks.validate_rules(a.v.products, a.v.categories, a.v.recipes, a.v.mappings, a.v.yield_rules)),
    "validate_cases": _q(lambda a: checks.validate_cases(a.v.cases, a.v.case_products, a.v.inventory, a.v.yield_choices, a.v.declared)),
    "guideline_asof": _q(lambda a: guideline.guideline_asof(a.v.cases, a.v.guideline)),
    "class_of": _q(lambda a: guideline.class_of(a.v.cases, a.v.guideline)),
    "compare_guideline": _q(lambda a: guideline.compare_guideline(a.v.cases, a.v.guideline, _revenue(a))),
    "gewerbe_names": _q(lambda a: guideline.gewerbe_names(a.v.guideline)),
    "line_groups": _q(lambda a: groups.line_groups(a.v.lines, _state(a))),
    "shared_articles": _q(lambda a: groups.shared_articles(a.v.lines)),
    "supplier_pairs": _q(lambda a: groups.supplier_pairs(a.v.lines)),
    "vat_rows": _q(lambda a: revenue.vat_rows(a.v.declared, _by_rate(a))),
    "merge_assortment": _q(lambda a: groups.merge_assortment(a.v.case_products.filter("ord % 3 <> 0"), a.v.case_products.filter("ord % 4 <> 1").withColumn("vat", F.when(F.col("ord") % 5 == 0, 0).otherwise(F.col("vat"))))),
    "import_assortment": _q(lambda a: groups.import_assortment(
        a.v.case_products.join(a.v.products.select("product_id", "name"), "product_id").select("case_id", "ord", F.when(F.col("ord") % 3 == 0, F.col("product_id")).alias("given_id"), F.when(F.col("ord") % 7 == 0, F.lit("gibt es nicht")).otherwise(F.concat(F.lit(" "), F.upper("name"))).alias("name"), "gross_price", "vat", F.col("ord").alias("row")), a.v.products
    ).select("case_id", "product_id", "gross_price", "resolved")),
    "rank_wares": rank_wares,
    "top_suggestions": top_suggestions,
    "class_f1": class_f1,
    "macro_f1": macro_f1,
    "automatic_share": automatic_share,
    "match_report": match_report,
    "coverage_curve": coverage_curve,
    "latest_rules": latest_rules,
    "diff_rules": diff_rules,
    "confusions": confusions,
    "unify_suppliers": _q(unify_suppliers),
    "text_keys": text_keys,
    "integer_math": integer_math,
    "parse_scaled": parse_scaled,
    "allocation": lambda spark, sf_dir: whole(spark, sf_dir).allocation,
    "product_rows": lambda spark, sf_dir: whole(spark, sf_dir).products,
    "calculated_totals": lambda spark, sf_dir: whole(spark, sf_dir).totals,
    "revenue_by_rate": lambda spark, sf_dir: whole(spark, sf_dir).vat,
}

_NET = "coalesce(i.stated_net, i.net_total)"
_RD = "(sign({0}) * ((abs({0}) + {1} // 2) // {1}))"
_TAX = "CAST(sign({0}) * ((abs({0}) * {1} + 5000) // 10000) AS BIGINT)"
_CHECKS = f"""
    r AS (SELECT case_id, invoice_id, vat, CAST(sum(line_net) AS BIGINT) AS base, CAST(sum({_TAX.format("line_net", "vat")}) AS BIGINT) AS line_tax FROM lines GROUP BY ALL),
    s AS (SELECT case_id, invoice_id, CAST(sum(base) AS BIGINT) AS total, CAST(sum(line_tax) AS BIGINT) AS line_tax, count(*) AS rates, max(vat) AS rate, CAST(sum({_TAX.format("base", "vat")}) AS BIGINT) AS rate_tax FROM r GROUP BY ALL),
    h AS (SELECT i.case_id, i.invoice_id, {_NET} AS net, coalesce(i.stated_gross, i.gross_total) AS gross, s.total, {_NET} + CASE WHEN rates = 1 THEN {_TAX.format(_NET, "rate")} ELSE rate_tax END AS expected, {_NET} + line_tax AS other FROM invoices i JOIN s ON s.case_id = i.case_id AND s.invoice_id = i.invoice_id),
    l AS (SELECT l.*, CAST(sign(CAST(quantity AS HUGEINT) * unit_price) * ((abs(CAST(quantity AS HUGEINT) * unit_price) + price_base_qty * 5000) // (price_base_qty * 10000)) AS BIGINT) AS want FROM lines l),
    flags AS (
        SELECT case_id, invoice_id, 'zero' AS code, no AS line_no, 'quantity' AS field FROM l WHERE quantity = 0
        UNION ALL SELECT case_id, invoice_id, 'no_unit', no, 'unit' FROM l WHERE unit_code = ''
        UNION ALL SELECT case_id, invoice_id, 'line_total', no, f FROM l CROSS JOIN (SELECT unnest(['quantity', 'unit_price', 'line_net']) AS f) t WHERE want <> line_net
        UNION ALL SELECT case_id, invoice_id, 'nonpositive', 0, 'net_total' FROM h WHERE net <= 0
        UNION ALL SELECT case_id, invoice_id, 'nonpositive', 0, 'gross_total' FROM h WHERE gross <= 0
        UNION ALL SELECT case_id, invoice_id, 'sum_net', 0, 'net_total' FROM h WHERE total <> net
        UNION ALL SELECT l.case_id, l.invoice_id, 'sum_net', l.no, 'line_net' FROM h JOIN l ON l.case_id = h.case_id AND l.invoice_id = h.invoice_id WHERE total <> net
        UNION ALL SELECT case_id, invoice_id, 'gross_check', 0, f FROM h CROSS JOIN (SELECT unnest(['gross_total', 'net_total']) AS f) t WHERE expected <> gross AND other <> gross
        UNION ALL SELECT l.case_id, l.invoice_id, 'gross_check', l.no, 'vat' FROM h JOIN l ON l.case_id = h.case_id AND l.invoice_id = h.invoice_id WHERE expected <> gross AND other <> gross),
    verified AS (SELECT i.case_id, i.invoice_id, i.supplier_name, i.number, i.date, i.stated_net, i.stated_gross, coalesce(n_flags, 0) AS n_flags, coalesce(n_blocking, 0) AS n_blocking FROM invoices i LEFT JOIN (
        SELECT f.case_id, f.invoice_id, count(*) AS n_flags, count(*) FILTER (code = 'line_total' OR (code = 'sum_net' AND i.stated_net IS NULL)) AS n_blocking FROM flags f JOIN invoices i ON i.case_id = f.case_id AND i.invoice_id = f.invoice_id GROUP BY ALL
    ) g ON g.case_id = i.case_id AND g.invoice_id = i.invoice_id)"""
_BASE = "CASE WHEN u.container THEN NULL ELSE u.base END"
_ASOF = "latest AS (SELECT case_id, max(g.year) AS year FROM cases JOIN (SELECT DISTINCT year FROM guideline) g ON g.year <= year(period_to) GROUP BY case_id)"
_CLASS = f"""{_ASOF}, cls AS (SELECT c.case_id, a.year, min(class_ord) AS class_ord, min(class_name) AS class_name FROM cases c JOIN latest a ON a.case_id = c.case_id JOIN guideline g ON g.year = a.year AND starts_with(g.code, c.gewerbe)
    WHERE c.gewerbe <> '' GROUP BY c.case_id, a.year HAVING count(DISTINCT class_ord) = 1)"""
_REV = "rev AS (SELECT d.case_id, revenue, CAST((CAST(revenue AS HUGEINT) - cost) * 10000 // cost AS BIGINT) AS markup FROM (SELECT case_id, CAST(sum(net) AS BIGINT) AS revenue FROM declared GROUP BY case_id) d JOIN (SELECT case_id, CAST(sum(abs(line_net)) AS BIGINT) AS cost FROM lines GROUP BY case_id) x ON x.case_id = d.case_id)"
_KEY = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"
_ART = f"""art AS (SELECT DISTINCT {_KEY.format("supplier_name")} AS k, {_CANON.format('name')} AS article FROM lines),
    sh AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM art a JOIN art b ON a.article = b.article AND a.k < b.k AND a.article <> '' GROUP BY ALL)"""
_PAIRS = f"""item AS (SELECT DISTINCT case_id, {_KEY.format("supplier_name")} AS k, unnest(['a:' || nullif(seller_article_id, ''), 'g:' || nullif(gtin, ''), 'n:' || nullif({_CANON.format('name')}, '')]) AS item FROM lines),
    met AS (SELECT a.case_id, a.k AS a, b.k AS b, count(*) AS shared FROM item a JOIN item b ON a.case_id = b.case_id AND a.item = b.item AND a.k <> b.k GROUP BY ALL),
    pairs AS (SELECT *, row_number() OVER (PARTITION BY case_id, a ORDER BY shared DESC, b) AS rank FROM met
        WHERE (length(a) >= 4 AND length(b) > length(a) AND contains(b, a)) OR (least(length(a), length(b)) >= 6 AND levenshtein(a, b) <= least(length(a), length(b)) // 6))"""
_FRESH = "CAST(number AS BIGINT) % 3 = 0"
_UNIFIED = f"""{_PAIRS}, inv AS (SELECT case_id, invoice_id, supplier_name, source <> 'scan' AS stated, {_FRESH} AS fresh, {_KEY.format("supplier_name")} AS k FROM invoices),
    grp AS (SELECT case_id, k, bool_or(fresh) AS fresh, bool_or(NOT fresh) AS kept, bool_or(stated) AS stated, count(*) AS n FROM inv GROUP BY case_id, k),
    link AS (SELECT p.case_id, a, b FROM pairs p JOIN grp g ON g.case_id = p.case_id AND g.k = p.a AND g.fresh WHERE rank = 1),
    edge AS (SELECT case_id, a, b FROM link UNION SELECT case_id, b, a FROM link),
    far AS (SELECT case_id, k, k AS u FROM grp UNION SELECT far.case_id, far.k, edge.b FROM far JOIN edge ON edge.case_id = far.case_id AND edge.a = far.u),
    mem AS (SELECT grp.*, root, max(kept) OVER (PARTITION BY grp.case_id, root) AS held FROM grp JOIN (SELECT case_id, k, min(u) AS root FROM far GROUP BY case_id, k) r ON r.case_id = grp.case_id AND r.k = grp.k),
    cand AS (SELECT * FROM mem WHERE kept OR NOT held),
    pick AS (SELECT *, row_number() OVER (PARTITION BY case_id, root ORDER BY stated DESC, n DESC, length(k) DESC, k) AS rn FROM cand c
        WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.case_id = c.case_id AND o.root = c.root AND length(o.k) > length(c.k) AND contains(o.k, c.k))),
    spelled AS (SELECT p.case_id, p.root, i.supplier_name, row_number() OVER (PARTITION BY p.case_id, p.root ORDER BY bool_or(i.stated) DESC, count(*) DESC, regexp_matches(i.supplier_name, '\\p{{Ll}}') DESC, i.supplier_name) AS rn
        FROM pick p JOIN inv i ON i.case_id = p.case_id AND i.k = p.k WHERE p.rn = 1 AND (NOT p.held OR NOT i.fresh) GROUP BY p.case_id, p.root, i.supplier_name)"""
_VEC = """q AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 100 = 0),
    w AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, 'ware.' || CAST(any_value(label) AS STRING) AS ware_id, sum(CAST(q.x * w.x AS DOUBLE))
            - CASE WHEN (w.vec_id % 3 < 2) AND (q.vec_id % 40 < 2) AND NOT (w.vec_id % 3 = q.vec_id % 40) THEN 0.1 ELSE 0 END AS score FROM q JOIN w USING (i) GROUP BY q.vec_id, w.vec_id),
    b AS (SELECT query_id, ware_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, ware_id) AS rank FROM d GROUP BY query_id, ware_id)"""
_LAB = "lab AS (SELECT doc_id, lang, 'q' || CAST(quality AS STRING) AS truth, CASE WHEN n_chars > 1500 THEN 'q1' ELSE 'q0' END AS pred FROM labels JOIN documents USING (doc_id))"
_F1 = """n AS (SELECT c AS class, CAST(sum(h) AS BIGINT) AS hit, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS support FROM (SELECT truth AS c, 0 AS p, 1 AS t, CASE WHEN truth = pred THEN 1 ELSE 0 END AS h FROM lab UNION ALL SELECT pred, 1, 0, 0 FROM lab) x GROUP BY c),
    r AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM n), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)"""
_LATEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"

ORACLES = {k: steps(s) for k, s in {
    "check_invoices": f"WITH {_CHECKS} SELECT case_id, invoice_id, code, CAST(line_no AS BIGINT) AS line_no, field FROM flags",
    "verify_invoices": f"WITH {_CHECKS} SELECT case_id, invoice_id, n_flags, n_blocking, n_flags = 0 AND supplier_name <> '' AND number <> '' AND date IS NOT NULL AND coalesce(stated_net, 0) > 0 AND coalesce(stated_gross, 0) > 0 AS accepted FROM verified",
    "confirm_invoices": f"WITH {_CHECKS} SELECT case_id, n_blocking = 0 AS accepted, count(*) AS n FROM verified GROUP BY ALL",
    "validate_rules": """SELECT 'validity' AS code, product_id AS key FROM products WHERE valid_from >= valid_to
        UNION ALL SELECT 'recipe_unit', r.product_id FROM recipes r JOIN o_product p ON p.product_id = r.part_id LEFT JOIN o_lookup u ON u.key = lower(r.unit) WHERE u.base IS DISTINCT FROM p.counted
        UNION ALL SELECT 'mapping_key', mapping_id FROM mappings WHERE coalesce(gtin, '') = '' AND coalesce(name, '') = '' AND (coalesce(supplier_name, '') = '' OR coalesce(seller_article_id, '') = '')
        UNION ALL SELECT 'mapping_factor', mapping_id FROM mappings WHERE factor <= 0
        UNION ALL SELECT 'mapping_product', mapping_id FROM mappings WHERE product_id NOT IN (SELECT product_id FROM products)
        UNION ALL SELECT 'mapping_confirmed', mapping_id FROM mappings WHERE NOT confirmed
        UNION ALL SELECT 'yield_deduction', rule_id FROM yield_rules WHERE deduction NOT BETWEEN 0 AND 10000
        UNION ALL SELECT 'category', product_id FROM products WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT category_id FROM categories)""",
    "validate_cases": """SELECT 'declared_vat' AS code, case_id AS key FROM declared WHERE vat NOT IN (0, 700, 1900) UNION ALL SELECT 'declared_negative', case_id FROM declared WHERE net < 0
        UNION ALL SELECT 'stock_twice', case_id FROM (SELECT case_id, product_id FROM inventory GROUP BY ALL HAVING count(*) > 1) t
        UNION ALL SELECT 'product_twice', case_id FROM (SELECT case_id, product_id FROM case_products GROUP BY ALL HAVING count(*) > 1) t
        UNION ALL SELECT 'product_vat', case_id FROM case_products WHERE vat NOT IN (0, 700, 1900)""",
    "guideline_asof": f"WITH {_ASOF} SELECT case_id, year FROM latest",
    "class_of": f"WITH {_CLASS} SELECT * FROM cls",
    "compare_guideline": f"""WITH {_CLASS}, {_REV}, b AS (SELECT c.case_id, c.year, c.class_name, g.band, coalesce(rate_from, rate_mean) AS low, coalesce(rate_to, rate_mean) AS high, row_number() OVER (PARTITION BY c.case_id ORDER BY g.band) AS rn, r.markup
            FROM cls c JOIN rev r ON r.case_id = c.case_id JOIN guideline g ON g.year = c.year AND g.class_ord = c.class_ord WHERE (above IS NULL OR above < revenue) AND (upto IS NULL OR revenue <= upto))
        SELECT case_id, year, class_name, band, low, high, markup, CASE WHEN markup < low THEN 'below' WHEN markup > high THEN 'above' ELSE 'within' END AS verdict FROM b WHERE rn = 1""",
    "gewerbe_names": "SELECT code, string_agg(class_name, ' / ' ORDER BY class_ord) AS names FROM (SELECT DISTINCT code, class_ord, class_name FROM guideline g WHERE year = (SELECT max(year) FROM guideline x WHERE x.code = g.code)) t GROUP BY code",
    "line_groups": """SELECT l.case_id, l.supplier_name, 'a:' || l.seller_article_id AS identity, upper(trim(l.unit_code)) AS unit, count(*) AS n, CAST(sum(l.quantity) AS BIGINT) AS quantity, CAST(sum(l.line_net) AS BIGINT) AS net,
            CASE min(CASE WHEN m.confirmed IS NULL THEN 0 WHEN m.confirmed THEN 2 ELSE 1 END) WHEN 0 THEN 'pending' WHEN 1 THEN 'automatic' ELSE 'manual' END AS state
        FROM o_matched l LEFT JOIN mappings m ON m.mapping_id = l.match_id GROUP BY l.case_id, l.supplier_name, l.seller_article_id, upper(trim(l.unit_code))""",
    "shared_articles": f"WITH {_ART} SELECT * FROM sh",
    "supplier_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "unify_suppliers": f"""WITH RECURSIVE {_UNIFIED} SELECT i.case_id, i.invoice_id, CASE WHEN i.fresh THEN coalesce(s.supplier_name, i.supplier_name) ELSE i.supplier_name END AS unified
        FROM inv i LEFT JOIN mem m ON m.case_id = i.case_id AND m.k = i.k LEFT JOIN spelled s ON s.case_id = m.case_id AND s.root = m.root AND s.rn = 1""",
    "vat_rows": """WITH d AS (SELECT case_id, vat, sum(net) AS n FROM declared GROUP BY ALL), k AS (SELECT case_id, vat, sum(line_net) AS n FROM lines GROUP BY ALL),
        f AS (SELECT coalesce(d.case_id, k.case_id) AS case_id, coalesce(d.vat, k.vat) AS vat, CAST(coalesce(d.n, 0) AS BIGINT) AS declared, CAST(coalesce(k.n, 0) AS BIGINT) AS calculated FROM d FULL JOIN k ON k.case_id = d.case_id AND k.vat = d.vat),
        r AS (SELECT case_id, vat, declared, calculated, false AS total FROM f WHERE declared <> 0 OR calculated <> 0 UNION ALL SELECT case_id, 0, CAST(sum(declared) AS BIGINT), CAST(sum(calculated) AS BIGINT), true FROM f GROUP BY case_id)
        SELECT case_id, vat, declared, calculated, calculated - declared AS difference, total, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN total THEN 9 WHEN vat = 1900 THEN 1 WHEN vat = 700 THEN 2 WHEN vat = 0 THEN 3 ELSE 4 END, vat) AS place FROM r""",
    "merge_assortment": """SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.product_id, b.product_id) AS product_id, CASE WHEN a.case_id IS NULL THEN 'new' WHEN b.case_id IS NULL THEN 'kept' WHEN a.gross_price = b.gross_price AND a.vat = b.vat THEN 'equal' ELSE 'conflict' END AS outcome
        FROM (SELECT * FROM case_products WHERE ord % 3 <> 0) a FULL JOIN (SELECT case_id, product_id, gross_price, CASE WHEN ord % 5 = 0 THEN 0 ELSE vat END AS vat FROM case_products WHERE ord % 4 <> 1) b ON a.case_id = b.case_id AND a.product_id = b.product_id""",
    "import_assortment": """WITH p AS (SELECT case_id, ord, CASE WHEN ord % 3 = 0 OR ord % 7 <> 0 THEN product_id END AS product_id, gross_price FROM case_products)
        SELECT case_id, product_id, gross_price, product_id IS NOT NULL AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY case_id, coalesce(product_id, '?') ORDER BY ord DESC) AS rn FROM p) t WHERE rn = 1""",
    "rank_wares": f"WITH {_VEC} SELECT query_id, ware_id, rank FROM b WHERE rank <= 5",
    "class_f1": f"WITH {_LAB}, {_F1} SELECT class, hit, predicted, support, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM f",
    "macro_f1": f"WITH {_LAB}, {_F1} SELECT count(*) AS classes, round(avg(f1), 9) AS macro_f1 FROM f",
    "automatic_share": f"WITH {_LAB} SELECT count(*) AS n, count(*) FILTER (doc_id % 99 >= 79) AS automatic, round(count(*) FILTER (doc_id % 99 >= 79) / count(*), 9) AS share, round(count(*) FILTER (doc_id % 99 >= 79 AND truth = pred) / nullif(count(*) FILTER (doc_id % 99 >= 79), 0), 9) AS precision FROM lab",
    "match_report": f"WITH {_LAB} SELECT lang AS grp, count(*) AS n, count(*) FILTER (doc_id % 7 <> 0) AS with_expectation, count(*) FILTER (doc_id % 7 <> 0 AND truth = pred) AS top1, count(*) FILTER (doc_id % 7 <> 0 AND (truth = pred OR doc_id % 3 = 0)) AS top5 FROM lab GROUP BY GROUPING SETS ((lang), ())",
    "coverage_curve": f"WITH {_LAB}, r AS (SELECT truth = pred AS hit, row_number() OVER (ORDER BY doc_id % 99 DESC, CAST(doc_id AS STRING)) AS place, count(*) OVER () AS total FROM lab) SELECT CAST(s AS INTEGER) AS share, count(*) AS n, count(*) FILTER (hit) AS hits FROM r CROSS JOIN (SELECT unnest([25, 50, 75, 100]) AS s) c WHERE place <= total * s // 100 GROUP BY s",
    "top_suggestions": f"""WITH {_VEC}, ex AS (SELECT vec_id AS query_id, 'ware.' || CAST(label AS STRING) AS ware_id FROM embeddings WHERE vec_id % 300 = 0),
        o AS (SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY rank) AS rn FROM b LEFT JOIN ex ON ex.query_id = b.query_id AND ex.ware_id = b.ware_id WHERE ex.query_id IS NULL AND rank <= 6)
        SELECT query_id, ware_id, 'exact' AS source FROM ex UNION ALL SELECT query_id, ware_id, 'encoder' FROM o WHERE rn <= 5 AND greatest(1, least(99, round_even(100 / (1 + exp(-(score * 4.0 - 2.0))), 0))) >= 20""",
    "confusions": f"""WITH {_LAB} SELECT pred || '.' || lang AS pred, truth || '.' || lang AS truth, count(*) AS n FROM lab WHERE pred <> truth GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 40""",
    "diff_rules": """WITH e AS (SELECT CAST(user_id AS STRING) AS id, event_id AS rev, event_type <> 'error' AS live, props AS content FROM events),
        now AS (SELECT id, arg_max(content, rev) AS content, arg_max(live, rev) AS live FROM e GROUP BY id),
        past AS (SELECT id, arg_max(content, rev) AS content, arg_max(live, rev) AS live FROM e WHERE rev <= (SELECT max(rev) // 2 FROM e) GROUP BY id)
        SELECT 'product' AS kind, coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'delete' ELSE 'put' END AS step
        FROM (SELECT * FROM now WHERE live) a FULL JOIN (SELECT * FROM past WHERE live) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.content <> b.content""",
    "text_keys": f"""SELECT s, {_CANON.format("s")} AS canonical, {_KEY.format("s")} AS key, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) AS heading,
        regexp_replace(replace(replace(replace(replace(lower(s), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '', 'g') AS folded,
        CASE WHEN regexp_matches(s, '\\p{{Ll}}') THEN s ELSE array_to_string([r[1] || lower(r[2:]) FOR r IN regexp_extract_all(s, '\\p{{L}}+|[^\\p{{L}}]+')], '') END AS title,
        CASE WHEN CAST('0x' || substr(sha256(s), 1, 12) AS BIGINT) % 1000 < 200 THEN 'val' ELSE 'train' END AS split
        FROM (SELECT s_name || ' GmbH & Co. Öl-Groß' AS s FROM supplier UNION ALL SELECT DISTINCT upper(p_name) FROM part) t""",
    "latest_rules": f"SELECT 'product' AS kind, CAST(user_id AS STRING) AS id, event_id AS rev, props AS content FROM ({_LATEST}) t WHERE rn = 1 AND event_type <> 'error'",
    "integer_math": """SELECT n, d, n // d AS cut, CAST(sign(n) * ((abs(n) + d // 2) // d) AS BIGINT) AS rounded, CAST(gcd(abs(n), d) AS BIGINT) AS gcd, (n - d) * 10000 // d AS markup
        FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * l_partkey AS n, l_suppkey + 1 AS d FROM lineitem) t""",
    "parse_scaled": "SELECT t, CAST(round(CAST(t AS DECIMAL(12,2)) * 100) AS BIGINT) AS cents, CAST(round(CAST(t AS DECIMAL(12,2)) * 1000) AS BIGINT) AS milli, CAST(round(CAST(t AS DECIMAL(12,2))) AS BIGINT) AS whole, CAST(NULL AS BIGINT) AS bad, CAST(NULL AS BIGINT) AS surplus FROM (SELECT DISTINCT CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS t FROM orders) x",
}.items()}
