"""Queries over the driver's tables: wordings and own mappings, sources and sinks, and the labelled corpus; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation, groups, mapping, pages, repair
from ..shared import scratch, stored
from ..sources import documents
from .audit_queries import Audit, _q, steps
from .reading_queries import _EXACT, _TOKEN, _damaged, _tokens, _with_cells

DOC = ["case_id", "invoice_id"]


def _aliases(a: Audit) -> DataFrame:
    return a.v.wares.select("product_id", F.concat(F.lit("Ware "), F.col("brand").cast("string")).alias("alias")).unionByName(a.v.wares.filter("brand < 5").select("product_id", F.col("name").alias("alias")))


def _wordings(a: Audit) -> DataFrame:
    seen = a.v.mappings.withColumn("observed", F.when(F.col("factor").isNotNull(), F.col("seller_article_id"))).withColumn("name", F.coalesce("name", "gtin"))
    return mapping.build_wordings(a.v.products, _aliases(a), seen).groupBy("ware_id").agg(F.count("*").alias("n"), F.count("rule_id").alias("from_rules"), F.max("text").alias("last"))


def _vectors(a: Audit) -> DataFrame:
    """Vectors by label, some in an own store, some shipped, some of another model or width, the rest made from the label."""
    c = F.col
    e = a.v.table("embeddings").select(F.lit("m").alias("model"), c("vec_id").cast("string").alias("text"), c("embedding").alias("vec"), "vec_id")
    own = e.filter("vec_id % 3 = 0").withColumn("model", F.when(c("vec_id") % 2 == 0, "m").otherwise("old")).drop("vec_id")
    shipped = e.filter("vec_id % 3 = 1").withColumn("vec", F.when(c("vec_id") % 4 == 1, F.slice("vec", 1, 3)).otherwise(c("vec"))).drop("vec_id")
    encode = lambda texts: texts.filter("length(text) > 2").select("text", F.array(F.length("text").cast("float")).alias("vec"))
    got = mapping.read_vectors(e, own, shipped, "m", 64, encode)
    return got.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"))


def _auto(a: Audit) -> DataFrame:
    c = F.col
    lines = a.v.write("lines", "case_id", "invoice_id", "ord", "supplier_name", "date", "name", "seller_article_id", "gtin", "unit_code", "mapping_id")
    best = lines.join(a.v.table("part").select(c("p_partkey").cast("string").alias("seller_article_id"), F.concat_ws(".", F.lit("prod"), "p_brand", "p_type").alias("ware")), "seller_article_id")
    suggested = best.select("case_id", "invoice_id", "ord", c("ware").alias("product_id"), (F.lit(60) + c("seller_article_id").cast("int") % 40).alias("confidence"))
    own, matched = mapping.auto_map(lines, a.v.mappings, suggested)
    counts = matched.groupBy("case_id").agg(F.count("*").alias("n_lines"), F.count("match_id").alias("n_mapped"))
    return counts.join(own.groupBy("case_id").agg(F.count("*").alias("n_own")), "case_id", "left")


def ubl_files(a: Audit, per_file: int = 20_000, codec: str = "none") -> str:
    """Lines written as electronic invoices, files of some per_file lines each, with one root, packed by codec; the folder they are in."""
    c = F.col
    tag = lambda name, value, extra="": F.concat(F.lit(f"<cbc:{name}{extra}>"), value, F.lit(f"</cbc:{name}>"))
    milli = lambda x, d: (x / F.lit(10**d)).cast(f"decimal(30,{d})").cast("string")
    line = F.concat(
        F.lit("<cac:InvoiceLine>"), tag("ID", c("no").cast("string")), F.lit('<cbc:InvoicedQuantity unitCode="XKG">'), milli(c("quantity").cast("decimal(30,0)"), 3), F.lit("</cbc:InvoicedQuantity>"),
        tag("LineExtensionAmount", milli(c("line_net").cast("decimal(30,0)"), 2)), F.lit("<cac:Item>"), tag("Name", c("name")), F.lit("<cac:SellersItemIdentification>"), tag("ID", c("seller_article_id")),
        F.lit("</cac:SellersItemIdentification><cac:ClassifiedTaxCategory>"), tag("Percent", milli(c("vat").cast("decimal(30,0)"), 2)), F.lit("</cac:ClassifiedTaxCategory></cac:Item><cac:Price>"), tag("PriceAmount", milli(c("unit_price").cast("decimal(30,0)"), 6)), F.lit("</cac:Price></cac:InvoiceLine>"),
    )
    files = 1 + a.v.table("lineitem").count() // per_file
    roots = a.v.spark.range(files).select(c("id").alias("file"), F.explode(F.array(F.lit(""), F.lit("~"))).alias("invoice_id"))
    rows = a.v.lines.withColumn("file", F.pmod(F.xxhash64("invoice_id"), F.lit(files))).unionByName(roots, allowMissingColumns=True).repartition("file")
    # rows are put in order before they become text
    order = Window.partitionBy("file", "invoice_id").orderBy("ord")
    rows = rows.withColumn("last", F.lead("ord").over(order).isNull())
    opened = F.concat(F.lit('<Invoice xmlns:cac="urn:a" xmlns:cbc="urn:b">'), tag("ID", c("invoice_id")))
    root = F.array(F.when(c("invoice_id") == "", "<All>").otherwise("</All>"))
    own = F.array_compact(F.array(F.when(c("ord") == 1, opened), line, F.when(c("last"), "</Invoice>")))
    path = scratch(a.v.spark, "ubl")
    lines = rows.select("file", F.explode(F.when(c("ord").isNull(), root).otherwise(own)).alias("value"))
    lines.write.partitionBy("file").option("compression", codec).text(path)
    return path


def _ubl(a: Audit) -> DataFrame:
    c = F.col
    _, lines = documents.read_ubl(a.v.spark, ubl_files(a, codec="gzip"))
    return lines.select(c("number").alias("invoice_id"), (c("ord") + 1).alias("ord"), "no", "name", "seller_article_id", "quantity", "unit_price", "line_net", "vat")


def _kinds(a: Audit) -> DataFrame:
    """Pages as files of several kinds."""
    c = F.col
    p = a.v.table("pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    head = F.element_at(F.array(*[F.lit(x) for x in ("%PDF-1.7 ", "<?xml version='1.0'?><x:Invoice a='1'>", "<rsm:CrossIndustryInvoice>", "<other>", "plain ")]), (c("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", documents.kind_of(F.concat(head, "html").cast("binary")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def _page_json(a: Audit) -> DataFrame:
    """Words of conversations written as pages in JSON lines and read again."""
    c = F.col
    word = F.struct(c("text").alias("t"), F.array("x", "y", "w", "h").alias("box"), F.lit("name").alias("field"), F.when(c("i") % 2 == 0, "quantity").alias("pred"), F.lit(0.5).alias("conf"), c("turn").cast("bigint").alias("row"), "role")
    page = _tokens(a).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", word.alias("x")))).alias("w"))
    path = scratch(a.v.spark, "page-rows")
    page.select(c("conv_id").cast("string").alias("invoice"), F.lit(0).alias("page"), F.transform("w", lambda y: y.x).alias("words")).write.json(path)
    return documents.read_page_rows(a.v.spark, path).groupBy("invoice", "field").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


def _structure(a: Audit) -> DataFrame:
    c = F.col
    w = _with_cells(a)
    return evaluation.structure_score(w.withColumns({"role_guess": F.when(c("i") % 5 == 0, "other").otherwise(c("role")), "col_guess": c("col") + 10, "start_guess": c("i") % 2 == 0}), ["conv_id"])


def _units_cut(a: Audit) -> DataFrame:
    text = F.when(F.col("ord") == 1, "F").when(F.col("ord") == 2, "Flasche").otherwise("Stk")
    return repair.complete_units(a.v.lines.select(*DOC, "ord", text.alias("unit_text")), DOC).filter("ord = 1").groupBy("unit_text").agg(F.count("*").alias("n"))


def _vat(a: Audit) -> DataFrame:
    rates = a.v.lines.filter("ord <= 2").select(*DOC, F.col("vat").alias("rate"), (F.col("ord") == 1).alias("labelled"))
    return repair.infer_vat(a.v.lines.select(*DOC, "ord", F.when(F.col("ord") > 2, 0).otherwise(F.col("vat")).alias("vat")), rates, DOC)


def _source(a: Audit) -> DataFrame:
    rows = a.v.lines.select(*DOC, (F.col("ord") + F.col("ord") % 2).alias("row"), "name")
    return repair.source_row(a.v.lines.select(*DOC, "ord", "name"), rows.groupBy(*DOC, "row").agg(F.min("name").alias("name")), DOC).select(*DOC, "ord", "row")


def _charges(a: Audit) -> DataFrame:
    c = F.col
    discounted = repair.apply_discounts(a.v.lines.withColumn("discount", c("no") * 150))
    totals = discounted.groupBy("case_id", "vat").agg(F.sum("line_net").alias("net"))
    charges = a.v.cases.select("case_id", F.lit(1900).cast("bigint").alias("vat"), (c("case_no") * 1000).alias("amount"))
    return repair.add_charges(totals, charges, ["case_id"])


def _corpus(a: Audit) -> DataFrame:
    c = F.col
    inv = a.v.invoices.select(c("invoice_id").alias("doc_id"), "number", c("supplier_name").alias("supplier"), F.when(F.length("number") == 1, c("supplier_name")).otherwise("x").alias("buyer"), (c("net_total") + F.when(c("number").cast("bigint") % 10 == 0, 1).otherwise(0)).alias("net_total"), F.lit(400).alias("width"), F.lit(300).alias("height"))
    lines = a.v.lines.select(c("invoice_id").alias("doc_id"), c("ord").alias("no"), "name", "gtin", "line_net")
    words = a.v.lines.select(c("invoice_id").alias("doc_id"), (c("ord") * 90).alias("x"), F.lit(5).alias("y"), F.lit(100).alias("w"), F.lit(9).alias("h"))
    return evaluation.validate_corpus(inv, lines, words, inv.select("doc_id", F.lit(0).cast("bigint").alias("amount")).limit(0)).groupBy("code").agg(F.count("*").alias("n"))


def _roles(a: Audit) -> DataFrame:
    c = F.col
    rows = a.v.table("conversations").select("conv_id", c("turn").alias("row"), (c("turn") * 20).cast("bigint").alias("y"), F.lit(10).cast("bigint").alias("h")).distinct()
    regions = rows.filter("row % 3 > 0").select("conv_id", c("row").alias("region"), F.concat(F.lit("r"), c("row").cast("string")).alias("role"), (c("y") + c("row") % 9).alias("y"), "h")
    return pages.row_roles(rows, regions, ["conv_id"]).select("conv_id", "row", "role")


def _shares(a: Audit) -> DataFrame:
    d = a.v.table("documents").select(F.col("source").alias("page_id"), F.col("lang").alias("class"))
    return evaluation.page_shares(d, d.select("class").distinct().withColumn("target", F.lit(0.9)))


def _floors(a: Audit) -> DataFrame:
    rows = a.v.table("part").select("p_type", "p_size")
    floors = rows.select(F.lit("p_type").alias("axis"), F.col("p_type").alias("value")).unionByName(rows.select(F.lit("p_size").alias("axis"), F.col("p_size").cast("string").alias("value"))).distinct().withColumn("floor", F.lit(0.05))
    return evaluation.axis_floors(rows, ["p_type", "p_size"], floors).select("axis", "value", "n", "met")


def _swaps(a: Audit) -> DataFrame:
    c = F.col
    w = _tokens(a).select("conv_id", c("turn").alias("row"), F.when(c("i") == 0, "2019").when(c("i") == 1, "AB12345").otherwise(c("text")).alias("text"), F.when(c("i") > 1, "name").otherwise("x").alias("field"), F.when(c("i") == 1, c("turn") % 2).otherwise(0).alias("col"))
    return evaluation.column_swap_probe(w.filter(~c("text").rlike(r"^(?:(?:19|20)\d{2}|[A-Z]*\d{4,})$") | (c("field") == "x")), ["conv_id"])


def _exempt(a: Audit) -> DataFrame:
    lines = a.v.lines.withColumn("vat_printed", (F.col("number").cast("bigint") % 2 == 0) & (F.col("ord") == 1))
    return evaluation.vat_exempt(lines, a.v.lines, DOC)


def _expected(a: Audit) -> DataFrame:
    labels = a.v.table("part").select(F.concat(F.upper(F.concat_ws(" ", "p_brand", "p_type")), F.lit(" !")).alias("label")).distinct()
    return evaluation.expectations(labels, a.v.products, _aliases(a))


def _search_order(a: Audit) -> DataFrame:
    g = a.v.lines.select("supplier_name", F.concat(F.lit("a:"), "seller_article_id").alias("identity"), F.when(F.col("no") == 1, "pending").when(F.col("no") == 2, "manual").otherwise("automatic").alias("state"), "seller_article_id").distinct()
    parts = a.v.table("part").select(F.col("p_partkey").cast("string").alias("seller_article_id"), F.concat_ws(".", F.lit("prod"), "p_brand", "p_type").alias("product_id"))
    met = mapping.group_search_text(g.join(parts, "seller_article_id"), a.v.products, a.v.categories)
    return met.select("supplier_name", "identity", "state", "search", mapping.group_order(F.col("state")).alias("place"))


QUERIES = {k: _q(f) for k, f in {
    "build_wordings": _wordings,
    "read_vectors": _vectors,
    "auto_map": _auto,
    "piece_weight_flags": lambda a: mapping.piece_weight_flags(_bought(a), a.v.products),
    "group_search_text": _search_order,
    "read_ubl": _ubl,
    "classify_files": _kinds,
    "read_page_rows": _page_json,
    "structure_score": _structure,
    "column_swap_probe": _swaps,
    "page_shares": _shares,
    "axis_floors": _floors,
    "vat_exempt": _exempt,
    "expectations": _expected,
    "prefer_expected": lambda a: evaluation.prefer_expected(a.v.invoices.select(F.col("number").alias("document"), F.when(F.length("invoice_id") % 2 == 0, "pdf").otherwise("xml").alias("kind"), F.col("invoice_id").alias("path"))),
    "validate_corpus": _corpus,
    "complete_units": _units_cut,
    "infer_vat": _vat,
    "source_row": _source,
    "add_charges": _charges,
    "cluster_1d": lambda a: repair.cluster_1d(a.v.table("events").select("event_type", F.col("value").alias("at")).distinct(), ["event_type"], 0.5).groupBy("event_type").agg((F.max("cluster") + 1).alias("n")),
    "stitch": lambda a: pages.stitch(_tokens(a).select("conv_id", F.col("turn").alias("window"), F.col("i").alias("at"), "role", F.length("text").alias("score")).withColumnRenamed("role", "label"), ["conv_id"]),
    "row_roles": _roles,
    "vote_row_item": lambda a: pages.vote_row_item(_tokens(a).select("conv_id", F.col("turn").alias("row"), F.when(F.length("text") > 3, F.length("text").cast("bigint")).alias("item")), ["conv_id"]),
    "list_cases": lambda a: groups.list_cases(a.v.cases.select(F.regexp_replace("case_id", "[0-9]$", "").alias("case_id"), F.col("period_from").alias("updated_at"))).groupBy("case_id", "duplicate").agg(F.count("*").alias("n")),
    "accept_rereads": lambda a: repair.accept_rereads(_damaged(a).withColumn("quantity", F.col("quantity") + 1000), _damaged(a).select(*DOC, "ord", F.when(F.col("ord") % 2 == 0, F.col("quantity")).alias("quantity"), F.lit(None).cast("bigint").alias("unit_price"), F.lit(None).cast("bigint").alias("line_net")), [*DOC, "ord"]).select(*DOC, "ord", "quantity", "reread"),
}.items()}


def _bought(a: Audit) -> DataFrame:
    from ..operators import stock

    return stored(stock.stock_purchases(a.routed(once=True)), "bought")


_WARE = "'prod.' || p_brand || '.' || p_type"
ORACLES = {k: steps(s) for k, s in {
    "build_wordings": """WITH al AS (SELECT product_id, 'Ware ' || CAST(brand AS STRING) AS t FROM wares UNION ALL SELECT product_id, name FROM wares WHERE brand < 5),
        nm AS (SELECT product_id, name AS t FROM products UNION SELECT product_id, t FROM al),
        mp AS (SELECT mapping_id, product_id, CASE WHEN factor IS NOT NULL AND seller_article_id IS NOT NULL THEN seller_article_id ELSE coalesce(name, gtin) END AS raw FROM mappings WHERE confirmed),
        sn AS (SELECT mapping_id, product_id, CASE WHEN regexp_matches(raw, '\\p{Ll}') THEN raw ELSE array_to_string([r[1] || lower(r[2:]) FOR r IN regexp_extract_all(raw, '\\p{L}+|[^\\p{L}]+')], '') END AS t FROM mp WHERE raw IS NOT NULL AND trim(raw) <> ''),
        al2 AS (SELECT product_id, CAST(NULL AS STRING) AS rule, t FROM nm UNION ALL SELECT product_id, mapping_id, t FROM sn WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.product_id = sn.product_id AND nm.t = sn.t))
        SELECT product_id AS ware_id, count(*) AS n, count(rule) AS from_rules, max(t) AS last FROM al2 GROUP BY product_id""",
    "read_vectors": """SELECT width, count(*) AS n FROM (SELECT CASE WHEN (vec_id % 3 = 0 AND vec_id % 2 = 0) OR (vec_id % 3 = 1 AND vec_id % 4 <> 1) THEN 64 WHEN vec_id > 99 THEN 1 END AS width FROM embeddings) t WHERE width IS NOT NULL GROUP BY width""",
    "auto_map": """WITH n AS (SELECT l.*, match_id IS NULL AND 60 + CAST(seller_article_id AS INTEGER) % 40 >= 80 AS sure FROM o_matched l),
        own AS (SELECT case_id, supplier_name, seller_article_id, arg_min(unit_code, invoice_id || ' ' || lpad(CAST(ord AS STRING), 4, '0')) AS u FROM n WHERE sure GROUP BY ALL)
        SELECT n.case_id, count(*) AS n_lines, count(CASE WHEN match_id IS NOT NULL OR (o.case_id IS NOT NULL AND (coalesce(o.u, '') = '' OR coalesce(n.unit_code, '') = '' OR lower(o.u) = lower(n.unit_code))) THEN 1 END) AS n_mapped, max(k.n_own) AS n_own
        FROM n LEFT JOIN own o ON o.case_id = n.case_id AND o.supplier_name = n.supplier_name AND o.seller_article_id = n.seller_article_id LEFT JOIN (SELECT case_id, count(*) AS n_own FROM own GROUP BY case_id) k ON k.case_id = n.case_id GROUP BY n.case_id""",
    "piece_weight_flags": "SELECT b.case_id, b.product_id, n_by_piece AS n, p.name || ': ' || CAST(n_by_piece AS STRING) || ' × 1 Stk ≈ ' || CAST(p.piece_amount AS STRING) || ' ' || p.piece_unit AS text FROM o_bought b JOIN products p ON p.product_id = b.product_id WHERE n_by_piece > 0",
    "group_search_text": f"""SELECT DISTINCT supplier_name, 'a:' || seller_article_id AS identity, state, lower(supplier_name || ' a:' || seller_article_id || ' ' || state || ' ' || p.name || ' ' || c.name) AS search, CASE state WHEN 'pending' THEN 0 WHEN 'automatic' THEN 1 ELSE 2 END AS place
        FROM (SELECT supplier_name, seller_article_id, CASE no WHEN 1 THEN 'pending' WHEN 2 THEN 'manual' ELSE 'automatic' END AS state FROM lines) l JOIN part ON CAST(p_partkey AS STRING) = seller_article_id JOIN products p ON p.product_id = {_WARE} JOIN categories c ON c.category_id = p.category_id""",
    "read_ubl": "SELECT invoice_id, ord, no, name, seller_article_id, quantity, unit_price, line_net, vat FROM lines",
    "classify_files": "SELECT CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ubl' WHEN 2 THEN 'cii' WHEN 3 THEN 'xml' END AS kind, count(*) AS n FROM pages GROUP BY 1",
    "read_page_rows": f"WITH {_TOKEN} SELECT CAST(conv_id AS STRING) AS invoice, CASE WHEN i % 2 = 0 THEN 'quantity' ELSE 'name' END AS field, count(*) AS n, CAST(sum(i * 10) AS BIGINT) AS x FROM tok GROUP BY ALL",
    "structure_score": f"""WITH {_TOKEN}, v AS (SELECT conv_id, turn, role, CASE WHEN i % 5 = 0 THEN 'other' ELSE role END AS g, count(*) AS n FROM tok GROUP BY ALL), r AS (SELECT conv_id, turn, role, arg_max(g, lpad(CAST(n AS STRING), 9, '0') || g) AS said FROM v GROUP BY ALL)
        SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM r WHERE role = said) AS role_right, count(*) AS n_words, count(*) AS column_right, count(*) FILTER (i % 4 = 0) AS start_hit, count(*) FILTER (i % 2 = 0) AS start_said, count(*) FILTER (i % 4 = 0) AS start_true FROM tok""",
    "page_shares": "SELECT d.lang AS class, count(*) AS n_words, count(DISTINCT source) AS n_pages, count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents) AS share, 0.9::DOUBLE AS target, count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents) >= 0.9 AS met FROM documents d GROUP BY d.lang",
    "axis_floors": """SELECT 'p_type' AS axis, p_type AS value, count(*) AS n, count(*) / (SELECT count(*) FROM part) >= 0.05 AS met FROM part GROUP BY p_type UNION ALL SELECT 'p_size', CAST(p_size AS STRING), count(*), count(*) / (SELECT count(*) FROM part) >= 0.05 FROM part GROUP BY p_size""",
    "vat_exempt": "SELECT case_id, invoice_id, CAST(any_value(number) AS BIGINT) % 2 <> 0 AND count(DISTINCT vat) FILTER (vat <> 0) > 1 AS exempt FROM lines GROUP BY ALL",
    "expectations": f"""WITH l AS (SELECT DISTINCT upper(p_brand || ' ' || p_type) || ' !' AS label, regexp_replace(lower(p_brand || p_type), '[^a-z0-9]+', '', 'g') AS key FROM part),
        n AS (SELECT product_id, regexp_replace(replace(lower(name), 'ü', 'ue'), '[^a-z0-9]+', '', 'g') AS key FROM products UNION ALL SELECT product_id, 'ware' || CAST(brand AS STRING) FROM wares) SELECT DISTINCT label, product_id FROM l JOIN n USING (key)""",
    "prefer_expected": """SELECT document, kind, path FROM (SELECT number AS document, CASE WHEN length(invoice_id) % 2 = 0 THEN 'pdf' ELSE 'xml' END AS kind, invoice_id AS path, row_number() OVER (PARTITION BY number ORDER BY CASE WHEN length(invoice_id) % 2 = 0 THEN 0 ELSE 1 END, invoice_id) AS rn FROM invoices) t WHERE rn = 1""",
    "validate_corpus": """SELECT code, n FROM (SELECT 'sum' AS code, count(*) AS n FROM invoices WHERE CAST(number AS BIGINT) % 10 = 0 UNION ALL SELECT 'parties', count(*) FROM invoices WHERE length(number) = 1 UNION ALL SELECT 'box', count(DISTINCT invoice_id) FROM lines WHERE ord * 90 + 100 > 400) t WHERE n > 0""",
    "complete_units": "SELECT CASE WHEN two THEN 'Flasche' ELSE 'F' END AS unit_text, count(*) AS n FROM (SELECT max(ord) >= 2 AS two FROM lines GROUP BY case_id, invoice_id) t GROUP BY 1",
    "infer_vat": """WITH r AS (SELECT case_id, invoice_id, list(DISTINCT vat) FILTER (vat <> 0 AND ord <= 2) AS a, list(DISTINCT vat) FILTER (vat <> 0 AND ord = 1) AS s FROM lines GROUP BY ALL)
        SELECT l.case_id, l.invoice_id, l.ord, CASE WHEN l.ord > 2 OR l.vat = 0 THEN coalesce(CASE WHEN len(a) = 1 THEN a[1] WHEN len(s) = 1 THEN s[1] END, 0) ELSE l.vat END AS vat FROM lines l JOIN r ON r.case_id = l.case_id AND r.invoice_id = l.invoice_id""",
    "source_row": """WITH r AS (SELECT case_id, invoice_id, ord + ord % 2 AS row, min(name) AS name FROM lines GROUP BY ALL)
        SELECT l.case_id, l.invoice_id, l.ord, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.case_id = l.case_id AND r.invoice_id = l.invoice_id AND r.row = l.ord AND r.name = l.name) THEN l.ord
            ELSE coalesce((SELECT min(row) FROM r WHERE r.case_id = l.case_id AND r.invoice_id = l.invoice_id AND r.name = l.name), l.ord) END AS row FROM lines l""",
    "add_charges": """WITH d AS (SELECT case_id, vat, line_net - CAST(sign(line_net) * ((abs(line_net) * no * 150 + 5000) // 10000) AS BIGINT) AS net FROM lines), t AS (SELECT case_id, vat, sum(net) AS net FROM d GROUP BY ALL),
        m AS (SELECT coalesce(t.case_id, c.case_id) AS case_id, coalesce(t.vat, 1900) AS vat, CAST(coalesce(t.net, 0) + coalesce(c.case_no * 1000, 0) AS BIGINT) AS net FROM t FULL JOIN cases c ON c.case_id = t.case_id AND t.vat = 1900)
        SELECT case_id, vat, net, CAST(sign(net) * ((abs(net) * vat + 5000) // 10000) AS BIGINT) AS tax FROM m""",
    "cluster_1d": "SELECT event_type, CAST(count(*) FILTER (gap > 0.5) + 1 AS BIGINT) AS n FROM (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY value) AS gap FROM (SELECT DISTINCT event_type, value FROM events) e) t GROUP BY event_type",
    "stitch": f"WITH {_TOKEN} SELECT conv_id, i AS at, role AS label, avg(length(text)) AS score FROM tok GROUP BY ALL",
    "row_roles": """WITH r AS (SELECT DISTINCT conv_id, turn AS row FROM conversations) SELECT conv_id, row, CASE WHEN row % 3 > 0 AND (10 - row % 9) / 10 >= 0.3 THEN 'r' || CAST(row AS STRING) ELSE 'header' END AS role FROM r""",
    "vote_row_item": f"WITH {_TOKEN}, v AS (SELECT conv_id, turn, length(text) AS l, count(*) AS n FROM tok WHERE length(text) > 3 GROUP BY ALL) SELECT conv_id, turn AS row, arg_max(l, n * 1000 - l) AS item FROM v GROUP BY conv_id, turn",
    "list_cases": "SELECT c AS case_id, count(*) > 1 AS duplicate, count(*) AS n FROM (SELECT regexp_replace(case_id, '[0-9]$', '') AS c FROM cases) t GROUP BY c",
    "accept_rereads": f"WITH {_EXACT} SELECT case_id, invoice_id, ord, CASE WHEN ord % 2 = 0 THEN k * 1000 ELSE k * 1000 + 1000 END AS quantity, ord % 2 = 0 AS reread FROM ex",
}.items()}
