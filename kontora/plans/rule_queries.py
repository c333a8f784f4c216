"""Queries over the driver's tables: report lists, assortment, maintenance of rules and cases; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assortment, maintenance, recipes, reports, stock
from ..shared import stored
from .audit_queries import ORACLE_LEAVES, STEPS, Audit, _q, steps
from .calculate import Cases, Rules, suggest_assortment


def _leftover(a: Audit, sellable: DataFrame) -> DataFrame:
    """What the portions of `taken` leave of each sellable stock, and whether less than one portion of anything fits."""
    c = F.col
    use = a.v.demand.join(a.v.taken, ["case_id", "product_id", "route"]).groupBy("case_id", "part_id").agg(F.sum(c("amount") * c("portions")).alias("used"), F.min("amount").alias("least"))
    have = sellable.select("case_id", c("product_id").alias("part_id"), "sellable")
    rest = F.greatest(c("sellable") - F.coalesce("used", F.lit(0)), F.lit(0))
    return have.join(use, ["case_id", "part_id"], "left").select("case_id", c("part_id").alias("product_id"), rest.cast("bigint").alias("qty"), F.coalesce(rest < c("least"), F.lit(False)).alias("binding"))


def _uses(a: Audit) -> DataFrame:
    return reports.used_by(a.v.demand, a.v.taken, a.v.products)


def _supply(a: Audit) -> DataFrame:
    balance = stored(a.sellable(), "supply")
    out = reports.supply_rows(balance, stored(_leftover(a, balance), "leftover"), _uses(a), a.v.products)
    return out.select("case_id", "product_id", "name", "unit", "bought", "used", "sellable", "n_uses", "qty_used", "leftover", "binding")


def _estimates(a: Audit) -> DataFrame:
    source = F.when(F.col("vat") == 0, "preis").when(F.col("vat") == 700, "rest").otherwise("rezeptur")
    return a.v.lines.filter("case_id <> 'case.3' or vat = 0").select("case_id", source.alias("source"), F.col("line_net").alias("cost"), (F.col("line_net") * 3).alias("revenue_net"))


def _sold(a: Audit) -> DataFrame:
    """Listed products with the portions of `taken`, as product rows."""
    division = a.v.products.select("product_id", "category_id").join(a.v.categories.select("category_id", "division"), "category_id", "left").select("product_id", F.coalesce("division", F.lit("unbestimmt")).alias("division"))
    rows = a.v.case_products.join(a.v.taken.drop("route"), ["case_id", "product_id"]).join(division, "product_id")
    return rows.withColumns({"price_missing": F.col("gross_price") <= 0, "cost_of_goods": F.col("portions") * 100, "revenue_net": F.col("portions") * F.col("gross_price")})


def _calculation(a: Audit) -> DataFrame:
    return reports.calculation_groups(_sold(a), a.v.cases.filter("gewerbe = '' or gewerbe like '56%'").select("case_id"))


def _warnings(a: Audit) -> DataFrame:
    v, reached = a.v, stored(a.reached(), "reached")
    routed = a.routed(reached, kept=(*stock.BALANCED, "invoice_id", "no"))
    balance = stock.stock_balance(stock.stock_purchases(routed), v.inventory, v.products, reached, v.no_revenue)
    flags = stock.stock_unit_flags(v.inventory, v.products, reached, v.no_revenue)
    return reports.warnings(balance, v.yield_choices, v.yield_rules, routed, flags, rows=_sold(a))


def _report_data(a: Audit) -> DataFrame:
    v, reached = a.v, stored(a.reached(), "reached")
    routed = a.routed(reached, kept=stock.BALANCED)
    balance = stock.stock_balance(stock.stock_purchases(routed), v.inventory, v.products, reached, v.no_revenue)
    yields = stock.resolve_yield(stored(balance, "balance"), v.products, v.yield_choices, v.yield_rules)
    included = routed.filter("bucket = 'purchase'")
    return reports.report_data(v.cases, v.invoices, stock.case_totals(routed), yields, included)


def _exclusions(a: Audit) -> DataFrame:
    return reports.group_exclusions(a.routed(once=True).filter("bucket not in ('purchase')"), F.concat(F.lit("a:"), "seller_article_id"))


def _trades(a: Audit) -> DataFrame:
    return a.v.cases.select("case_id", "gewerbe")


def _fits(a: Audit) -> DataFrame:
    return assortment.fits_trade(recipes.leaves(a.v.products, a.v.recipes), a.v.products, a.v.category_codes, _trades(a))


def _dismissed(a: Audit) -> DataFrame:
    return a.v.case_products.filter("ord % 2 = 0").select("case_id", F.regexp_replace("product_id", "sold.a", "sold.b").alias("product_id"))


def _candidates(a: Audit) -> DataFrame:
    sold = assortment.sellable_products(a.v.products, a.v.recipes, a.v.categories)
    return assortment.candidates(a.v.cases, a.v.case_products, sold, stored(_fits(a), "fits"), _dismissed(a))


def _suggest(a: Audit) -> DataFrame:
    """Suggestions by both calculations. Portions of a dish are given where a menu with it is listed as well."""
    v, key = a.v, ["case_id", "product_id"]
    for short in ("wares", "products", "recipes", "categories", "cases", "case_products"):  # every step reads them
        v.write(short, *getattr(v, short).columns)
    menus = v.case_products.filter("product_id like 'sold.b.%'").select("case_id", F.regexp_replace("product_id", "sold.b", "sold.a").alias("product_id"))
    pinned = v.taken.join(menus, key, "left_semi").select(*key, "portions")
    cases = Cases(v.cases, v.lines, v.case_products, v.inventory, v.no_revenue, v.yield_choices, pinned, v.declared)
    return suggest_assortment(cases, Rules(v.products, v.categories, v.recipes, v.mappings, v.yield_rules), v.category_codes, _dismissed(a))


def _log(a: Audit) -> DataFrame:
    """Events as a change log: the user is the entity, the event its revision."""
    e = a.v.table("events")
    gone = F.when(F.col("event_type") == "error", F.col("event_id"))
    return e.select(F.lit("product").alias("kind"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("rev"), F.col("props").alias("content"), F.lit(True).alias("confirmed"), F.lit("x").alias("changed_by"), gone.alias("deleted_at"))


def _change(a: Audit) -> DataFrame:
    e = a.v.table("events")
    put = e.filter("event_type = 'purchase'").select(F.lit("product").alias("kind"), (F.col("user_id") + 1000000).cast("string").alias("id"), F.col("event_id").cast("string").alias("content"), F.lit(True).alias("confirmed"))
    delete = e.filter("event_id % 50 = 0").select(F.lit("product").alias("kind"), F.col("user_id").cast("string").alias("id"))
    return maintenance.change_rules(_log(a), put, delete, 0, "me").select("kind", "id", "rev", "content", "deleted_at")


def _rescale(a: Audit) -> DataFrame:
    after = a.v.products.withColumn("unit", F.when(F.col("unit") == "MLT", "GRM").otherwise(F.col("unit")))
    written = after.filter("unit = 'GRM' or product_id like 'sold.a.%'").select(F.col("product_id").alias("id"))
    return maintenance.rescale_guard(a.v.products, after, a.v.mappings, a.v.recipes, written)


def _seed(a: Audit) -> DataFrame:
    """Products as a store of which some were edited, deleted or never delivered, after a delivery with new names."""
    c = F.col
    number = (F.length("product_id") * 3 + F.length("name")) % 7
    store = a.v.products.withColumn("n", number).filter("n <> 0").select("product_id", "name", F.when(c("n") > 2, c("piece_amount")).alias("piece_amount"), F.when(c("n") < 4, 0).otherwise(5).cast("bigint").alias("rev"), F.when(c("n") == 1, F.lit(9)).cast("bigint").alias("deleted_at"))
    seed = a.v.products.select("product_id", F.upper("name").alias("name"), "piece_amount")
    return maintenance.seed_rules(store, seed, "product_id", ["name"], ["piece_amount"])


def _diff(a: Audit) -> DataFrame:
    was = a.v.case_products.filter("ord % 5 <> 0")
    now = a.v.case_products.filter("ord % 4 <> 0").withColumn("vat", F.when(F.col("ord") % 3 == 0, 0).otherwise(F.col("vat")))
    diff = stored(maintenance.diff_parts(was, now, ["case_id", "product_id"]), "diff")
    return maintenance.apply_parts(was, diff, ["case_id", "product_id"]).select("case_id", "product_id", "ord", "gross_price", "vat")


def _amend(a: Audit) -> DataFrame:
    c = F.col
    cols = ["case_id", "invoice_id", "ord", "supplier_name", "date", "name", "mapping_id"]
    was = a.v.lines.select(*cols)
    now = was.withColumn("mapping_id", F.when(c("ord") % 2 == 0, F.concat(F.lit("own."), "name")).otherwise(c("mapping_id")))
    stored_ = was.withColumn("name", F.when(F.length("invoice_id") % 2 == 0, F.upper("name")).otherwise(c("name")))
    return maintenance.amend(stored_, was, now).filter("amended").groupBy("case_id").agg(F.count("*").alias("n"), F.count("mapping_id").alias("mapped"))


def _purge(a: Audit) -> DataFrame:
    invoices = a.v.invoices.filter("source = 'ubl'").select("case_id", "invoice_id")
    documents = a.v.invoices.select("case_id", "invoice_id", F.lit("doc").alias("name"))
    own = a.v.cases.select("case_id").crossJoin(a.v.mappings.filter("mapping_id like 'map.g.%'").select("mapping_id"))
    kept, named = maintenance.purge(invoices, a.v.lines, documents, own)
    return kept.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("document")).unionByName(named.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("mapping")))


def _stale(a: Audit) -> DataFrame:
    changed = a.v.recipes.withColumn("amount", F.when(F.col("amount") == 175, 176).otherwise(F.col("amount")))
    own = a.v.case_products.join(maintenance.recipe_basis(a.v.products, a.v.recipes), "product_id").select("case_id", "product_id", F.col("basis").alias("recipe_basis"))
    return maintenance.stale_recipes(own, maintenance.recipe_basis(a.v.products, changed))


def _upsert(a: Audit) -> DataFrame:
    stored_ = a.v.invoices.filter("source = 'ubl'").select("case_id", "invoice_id", "net_total", (F.col("number").cast("bigint") * 10).alias("ord"))
    incoming = a.v.invoices.filter("length(invoice_id) % 2 = 0").select("case_id", "invoice_id", F.col("gross_total").alias("net_total"), F.lit(0).cast("bigint").alias("ord"))
    return maintenance.upsert_invoices(stored_, incoming)


def _unseat(a: Audit) -> DataFrame:
    rows = a.v.yield_rules.withColumn("rev", F.length("rule_id").cast("bigint")).withColumn("target", F.when(F.col("product_id").isNotNull(), F.substring("product_id", 1, 12)).otherwise("c"))
    return maintenance.unseat_default(rows, ["target"]).select("rule_id", "target", "is_default")


def _promote(a: Audit) -> DataFrame:
    own = a.v.mappings.filter("not confirmed").withColumn("factor", F.coalesce("factor", F.lit(77))).withColumn("unit_code", F.lit("h87"))
    rules, products = maintenance.promote_mapping(own, a.v.mappings, a.v.products)
    mapped = rules.groupBy("confirmed").agg(F.count("*").alias("n"), F.sum("factor").alias("total")).select(F.concat(F.lit("mapping "), F.col("confirmed").cast("string")).alias("what"), "n", "total")
    return mapped.unionByName(products.groupBy("piece_unit").agg(F.count("*").alias("n"), F.sum("piece_amount").alias("total")).select(F.concat(F.lit("piece "), F.coalesce("piece_unit", F.lit("-"))).alias("what"), "n", "total"))


def _drop_promoted(a: Audit) -> DataFrame:
    own = a.v.case_products.select("case_id", "product_id").join(a.v.recipes, "product_id").withColumn("amount", F.when((F.col("ord") == 2) & (F.length("case_id") == 7), F.col("amount") + 1).otherwise(F.col("amount")))
    return maintenance.drop_promoted_recipes(own, a.v.recipes).select("case_id", "product_id", "ord")


def _touched(a: Audit) -> DataFrame:
    return stored(a.balance(), "balance").select("case_id", "product_id")


def _imports(a: Audit) -> DataFrame:
    c = F.col
    status = F.when(c("source") == "ubl", "stored").when(c("number").cast("bigint") % 7 == 0, "failed").otherwise("draft")
    return reports.import_summary(a.v.invoices.select("case_id", c("invoice_id").alias("name"), status.alias("status")), ["case_id"])


QUERIES = {k: _q(f) for k, f in {
    "used_by": lambda a: _uses(a).select("case_id", "part_id", "product_id", "per_portion", "portions", "qty", "place"),
    "supply_rows": _supply,
    "estimate_groups": lambda a: reports.estimate_groups(_estimates(a)),
    "calculation_groups": _calculation,
    "binding_names": lambda a: reports.binding_names(a.v.demand, _leftover(a, a.sellable()), a.v.products),
    "find_names": lambda a: reports.find_names(a.v.table("part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name")), "S"),
    "and_more": lambda a: a.v.lines.groupBy("invoice_id").agg(F.array_sort(F.collect_set("name")).alias("names")).select("invoice_id", reports.and_more(F.col("names")).alias("label")),
    "warnings": _warnings,
    "report_data": _report_data,
    "group_exclusions": _exclusions,
    "sellable_products": lambda a: assortment.sellable_products(a.v.products, a.v.recipes, a.v.categories).select("product_id"),
    "fits_trade": _fits,
    "ware_filter": lambda a: assortment.ware_filter(a.v.products, a.v.category_codes, a.v.mappings, _trades(a)),
    "loop_free_parts": lambda a: assortment.loop_free_parts(a.v.products, a.v.recipes),
    "used_in": lambda a: assortment.used_in(a.v.case_products, a.v.recipes, a.v.products),
    "suggestion_candidates": _candidates,
    "suggest_assortment": _suggest,
    "rules_date": lambda a: maintenance.rules_date(a.v.table("events").select(F.col("ts").alias("changed_at")), a.v.table("orders").select(F.col("o_orderdate").alias("changed_at"))),
    "change_rules": _change,
    "rescale_guard": _rescale,
    "seed_rules": _seed,
    "diff_case": _diff,
    "amend": _amend,
    "import_summary": _imports,
    "purge": _purge,
    "stale_recipes": _stale,
    "needs_mapping": lambda a: maintenance.needs_mapping(a.v.cases.select("case_id", F.when(F.col("case_no") % 3 > 0, "store").alias("mapped_store"), (F.col("case_no") % 2).alias("mapped_at")), "store", F.lit(1)),
    "upsert_invoices": _upsert,
    "unseat_default": _unseat,
    "yield_options": lambda a: maintenance.yield_options(_touched(a), a.v.products, a.v.yield_rules, a.v.yield_choices),
    "promote_mapping": _promote,
    "drop_promoted_recipes": _drop_promoted,
    "users_of": lambda a: maintenance.users_of(a.v.products, a.v.recipes, a.v.mappings, a.v.yield_rules),
    "period_filter": lambda a: maintenance.period_filter(a.v.lines, a.v.cases.withColumn("period_to", F.lit("1997-12-31").cast("date"))).groupBy("case_id").agg(F.count("*").alias("n")),
}.items()}

_LEFT = """use_ AS (SELECT d.case_id, d.part_id, sum(amount * portions) AS used, min(amount) AS least FROM demand d JOIN taken t ON t.case_id = d.case_id AND t.product_id = d.product_id GROUP BY d.case_id, d.part_id),
    have AS (SELECT y.case_id, y.product_id, bought, used, used_cost, CAST(CAST(used AS HUGEINT) * (10000 - coalesce(r.deduction, 0)) // 10000 AS BIGINT) AS sellable FROM o_yield y LEFT JOIN yield_rules r ON r.rule_id = y.rule_id),
    rest AS (SELECT h.case_id, h.product_id, CAST(greatest(sellable - coalesce(u.used, 0), 0) AS BIGINT) AS qty, coalesce(greatest(sellable - coalesce(u.used, 0), 0) < least, false) AS binding
        FROM have h LEFT JOIN use_ u ON u.case_id = h.case_id AND u.part_id = h.product_id)"""
_USED = """uses AS (SELECT d.case_id, d.part_id, d.product_id, d.amount AS per_portion, CAST(sum(portions) AS BIGINT) AS portions, CAST(sum(portions) * d.amount AS BIGINT) AS qty
        FROM demand d JOIN taken t ON t.case_id = d.case_id AND t.product_id = d.product_id WHERE portions <> 0 GROUP BY d.case_id, d.part_id, d.product_id, d.amount)"""
_SOLD = """sold AS (SELECT c.case_id, c.product_id, c.gross_price, t.portions, coalesce(g.division, 'unbestimmt') AS division FROM case_products c JOIN taken t ON t.case_id = c.case_id AND t.product_id = c.product_id
        JOIN products p ON p.product_id = c.product_id LEFT JOIN categories g ON g.category_id = p.category_id)"""
_REACHED = "pair AS (SELECT product_id AS src, part_id FROM recipes UNION SELECT r.src, e.part_id FROM pair r JOIN recipes e ON e.product_id = r.part_id)"
_FITS = """leaf AS (SELECT product_id AS src, product_id AS node FROM products UNION SELECT l.src, e.part_id FROM leaf l JOIN recipes e ON e.product_id = l.node),
    parts AS (SELECT src, node FROM leaf WHERE NOT EXISTS (SELECT 1 FROM recipes e WHERE e.product_id = leaf.node)),
    fits AS (SELECT c.case_id, p.product_id FROM cases c CROSS JOIN products p WHERE c.gewerbe = '' OR NOT EXISTS (
        SELECT 1 FROM parts x JOIN products q ON q.product_id = x.node WHERE x.src = p.product_id AND EXISTS (SELECT 1 FROM category_codes k WHERE k.category_id = q.category_id)
            AND NOT EXISTS (SELECT 1 FROM category_codes k WHERE k.category_id = q.category_id AND starts_with(c.gewerbe, k.code))))"""
_SELLABLE = """sells AS (SELECT p.* FROM o_product p WHERE counted = 'piece' AND (EXISTS (SELECT 1 FROM recipes r WHERE r.product_id = p.product_id)
        OR (NOT EXISTS (SELECT 1 FROM recipes r WHERE r.part_id = p.product_id) AND coalesce(category_id, '') <> '' AND goods)))"""

#: The first calculation: what each listed product sells alone, beside given portions; no two others share a part. Then what the second one leaves.
_SOLD_PORTIONS = f"""{ORACLE_LEAVES}, have AS MATERIALIZED (SELECT y.case_id, y.product_id, used, used_cost, greatest(CAST(CAST(used AS HUGEINT) * (10000 - coalesce(r.deduction, 0)) // 10000 AS BIGINT), 0) AS cap,
            CASE WHEN used > 0 THEN CAST(CAST(used_cost AS HUGEINT) * 1000000 // used AS BIGINT) ELSE 0 END AS micro,
            EXISTS (SELECT 1 FROM o_listed l WHERE l.case_id = y.case_id AND l.product_id = y.product_id) AS first FROM o_yield y LEFT JOIN yield_rules r ON r.rule_id = y.rule_id),
        uses AS MATERIALIZED (SELECT e.case_id, e.product_id, l.part_id, l.amount, coalesce(h.cap, 0) AS cap, coalesce(h.micro, 0) AS micro,
            (SELECT t.portions FROM taken t WHERE t.case_id = e.case_id AND t.product_id = e.product_id AND e.product_id LIKE 'sold.a.%' AND EXISTS (SELECT 1 FROM case_products m WHERE m.case_id = e.case_id AND m.product_id = replace(e.product_id, 'sold.a', 'sold.b'))) AS pinned
            FROM o_enabled e JOIN leafs l ON l.product_id = e.product_id LEFT JOIN have h ON h.case_id = e.case_id AND h.product_id = l.part_id AND h.first),
        given AS (SELECT case_id, part_id, sum(amount * pinned) AS used FROM uses WHERE pinned IS NOT NULL GROUP BY ALL),
        portion AS MATERIALIZED (SELECT u.case_id, u.product_id, coalesce(any_value(pinned), min(greatest(cap - coalesce(g.used, 0), 0) // amount)) AS portions, any_value(pinned) IS NOT NULL AS pinned, sum(CAST(amount AS HUGEINT) * micro) AS per,
            arg_min(coalesce(c.division, 'unbestimmt'), (-greatest(CAST(amount AS HUGEINT) * micro, 0), u.part_id)) AS dear, max(CAST(amount AS HUGEINT) * micro) AS top
            FROM uses u LEFT JOIN given g ON g.case_id = u.case_id AND g.part_id = u.part_id LEFT JOIN products p ON p.product_id = u.part_id LEFT JOIN categories c ON c.category_id = p.category_id GROUP BY u.case_id, u.product_id),
        row_ AS (SELECT o.case_id, portions, l.gross_price > 0 AS priced, portions * per // 1000000 AS cost, CASE WHEN l.gross_price > 0 THEN portions * ((2 * l.gross_price * 10000 + 10000 + l.vat) // (2 * (10000 + l.vat))) ELSE 0 END AS revenue,
            CASE WHEN p.category_id IS NOT NULL THEN coalesce(c.division, 'unbestimmt') WHEN top > 0 THEN dear ELSE 'unbestimmt' END AS division
            FROM portion o JOIN case_products l ON l.case_id = o.case_id AND l.product_id = o.product_id JOIN products p ON p.product_id = o.product_id LEFT JOIN categories c ON c.category_id = p.category_id WHERE portions > 0 OR pinned),
        rate AS (SELECT r.case_id, division, CAST((sum(revenue) - sum(cost)) * 10000 // sum(cost) AS BIGINT) AS own FROM row_ r JOIN cases k ON k.case_id = r.case_id AND (gewerbe = '' OR gewerbe LIKE '55%' OR gewerbe LIKE '56%')
            WHERE priced AND portions <> 0 GROUP BY ALL HAVING sum(cost) > 0 AND sum(revenue) > 0),
        overall AS (SELECT case_id, CASE WHEN sum(revenue) > 0 AND sum(cost) FILTER (priced) > 0 THEN CAST((sum(revenue) - sum(cost) FILTER (priced)) * 10000 // sum(cost) FILTER (priced) AS BIGINT) ELSE 0 END AS whole FROM row_ GROUP BY case_id),
        rest AS (SELECT h.*, greatest(cap - coalesce(u.used, 0), 0) AS left_ FROM have h LEFT JOIN (SELECT u.case_id, u.part_id, sum(amount * portions) AS used FROM uses u JOIN portion o ON o.case_id = u.case_id AND o.product_id = u.product_id GROUP BY ALL) u ON u.case_id = h.case_id AND u.part_id = h.product_id)"""


def _rounds(most: int = 5) -> str:
    """The rounds of suggestions as SQL: the best of each case takes its portions from what is left, then the next."""
    out = """need AS (SELECT c.case_id, c.product_id, l.part_id, l.amount FROM o_offered c JOIN leafs l ON l.product_id = c.product_id WHERE l.amount > 0),
        st AS MATERIALIZED (SELECT case_id, product_id AS part_id, CAST(left_ AS BIGINT) AS left_, micro FROM rest),
        whole_ AS (SELECT n.case_id, n.product_id FROM need n LEFT JOIN st ON st.case_id = n.case_id AND st.part_id = n.part_id GROUP BY ALL HAVING bool_and(st.part_id IS NOT NULL)),
        nd AS MATERIALIZED (SELECT n.*, micro FROM need n JOIN whole_ w ON w.case_id = n.case_id AND w.product_id = n.product_id JOIN st ON st.case_id = n.case_id AND st.part_id = n.part_id),
        head AS (SELECT *, row_number() OVER (PARTITION BY case_id, product_id ORDER BY amount * micro DESC, part_id) AS rn, count(*) OVER (PARTITION BY case_id, product_id) AS n, sum(CAST(amount AS HUGEINT) * micro) OVER (PARTITION BY case_id, product_id) AS unit FROM nd),
        mains AS (SELECT *, min(amount) OVER (PARTITION BY case_id, part_id) AS least FROM head WHERE rn = 1),
        pool AS MATERIALIZED (SELECT m.case_id, m.product_id, CAST(m.unit AS DOUBLE) AS unit, (1 + (n - 1) / 2.0::DOUBLE) * sqrt(CAST(least AS DOUBLE) / amount) * (10000 + greatest(coalesce(r.own, o.whole, 0), 0)) / 10000::DOUBLE AS weight
            FROM mains m JOIN products p ON p.product_id = m.part_id LEFT JOIN categories g ON g.category_id = p.category_id LEFT JOIN rate r ON r.case_id = m.case_id AND r.division = coalesce(g.division, 'unbestimmt') LEFT JOIN overall o ON o.case_id = m.case_id),
        left0 AS (SELECT case_id, part_id, left_ FROM st)"""
    for k in range(1, most + 1):
        gone = "".join(f" AND NOT EXISTS (SELECT 1 FROM pick{j} x WHERE x.case_id = p.case_id AND x.product_id = p.product_id)" for j in range(1, k))
        out += f""", fit{k} AS (SELECT d.case_id, d.product_id, min(left_ // amount) AS portions FROM nd d JOIN left{k - 1} l ON l.case_id = d.case_id AND l.part_id = d.part_id GROUP BY ALL),
        pick{k} AS MATERIALIZED (SELECT case_id, product_id, portions FROM (SELECT p.case_id, p.product_id, portions, row_number() OVER (PARTITION BY p.case_id ORDER BY portions * unit / 1000000 * weight DESC, p.product_id) AS rn
            FROM pool p JOIN fit{k} f ON f.case_id = p.case_id AND f.product_id = p.product_id WHERE portions > 0 AND portions * unit * weight > 0{gone}) t WHERE rn = 1),
        left{k} AS MATERIALIZED (SELECT l.case_id, l.part_id, left_ - coalesce(amount * portions, 0) AS left_ FROM left{k - 1} l LEFT JOIN (SELECT d.case_id, d.part_id, amount, portions FROM nd d JOIN pick{k} b ON b.case_id = d.case_id AND b.product_id = d.product_id) t ON t.case_id = l.case_id AND t.part_id = l.part_id)"""
    return out + " " + " UNION ALL ".join(f"SELECT case_id, product_id, CAST({k} AS BIGINT) AS place FROM pick{k}" for k in range(1, most + 1))


_OFFERED = f"""{_FITS}, {_SELLABLE}, offered AS (SELECT c.case_id, s.product_id FROM cases c CROSS JOIN sells s JOIN fits f ON f.case_id = c.case_id AND f.product_id = s.product_id
        WHERE (s.valid_from IS NULL OR period_to >= s.valid_from) AND (s.valid_to IS NULL OR period_to < s.valid_to) AND NOT EXISTS (SELECT 1 FROM case_products x WHERE x.case_id = c.case_id AND x.product_id = s.product_id)
          AND NOT EXISTS (SELECT 1 FROM case_products x WHERE x.case_id = c.case_id AND x.ord % 2 = 0 AND replace(x.product_id, 'sold.a', 'sold.b') = s.product_id))"""
#: Steps where what is offered is reached as well.
_WITH_OFFERED = {
    **{k: STEPS[k] for k in ("o_units", "o_lookup", "o_product", "o_enabled")},
    "o_offered": f"WITH RECURSIVE {_OFFERED} SELECT case_id, product_id FROM offered",
    "o_listed": STEPS["o_reach"].replace("o_reach", "o_listed"),
    "o_reach": "SELECT case_id, product_id FROM (SELECT case_id, product_id FROM o_enabled UNION SELECT case_id, product_id FROM o_offered) t UNION SELECT r.case_id, e.part_id FROM o_reach r JOIN recipes e ON e.product_id = r.product_id",
    **{k: v for k, v in STEPS.items() if k not in ("o_units", "o_lookup", "o_product", "o_enabled", "o_reach")},
}
ORACLES = {k: steps(s) for k, s in {
    "used_by": f"WITH {_USED} SELECT *, row_number() OVER (PARTITION BY case_id, part_id ORDER BY qty DESC, product_id, per_portion) AS place FROM uses",
    "supply_rows": f"""WITH {_LEFT}, {_USED}, n AS (SELECT case_id, part_id, count(*) AS n, CAST(sum(qty) AS BIGINT) AS q FROM uses GROUP BY ALL)
        SELECT h.case_id, h.product_id, coalesce(p.name, '') AS name, p.unit, h.bought, h.used, h.sellable, coalesce(n.n, 0) AS n_uses, coalesce(n.q, 0) AS qty_used, r.qty AS leftover, r.binding
        FROM have h LEFT JOIN products p ON p.product_id = h.product_id JOIN rest r ON r.case_id = h.case_id AND r.product_id = h.product_id LEFT JOIN n ON n.case_id = h.case_id AND n.part_id = h.product_id""",
    "estimate_groups": """WITH e AS (SELECT case_id, CASE vat WHEN 0 THEN 'preis' WHEN 700 THEN 'rest' ELSE 'rezeptur' END AS source, line_net FROM lines WHERE case_id <> 'case.3' OR vat = 0)
        SELECT c.case_id, s.source, count(e.source) AS n, CAST(coalesce(sum(line_net), 0) AS BIGINT) AS cost, CAST(coalesce(sum(line_net * 3), 0) AS BIGINT) AS revenue_net
        FROM (SELECT DISTINCT case_id FROM e) c CROSS JOIN (SELECT unnest(['preis', 'rest', 'rezeptur']) AS source) s LEFT JOIN e ON e.case_id = c.case_id AND e.source = s.source GROUP BY c.case_id, s.source""",
    "calculation_groups": f"""WITH {_SOLD} SELECT s.case_id, CASE WHEN gewerbe = '' OR gewerbe LIKE '56%' THEN division END AS division, count(*) AS n, string_agg(product_id, ',' ORDER BY product_id) AS products, CAST(sum(portions * 100) AS BIGINT) AS cost_of_goods
        FROM sold s JOIN cases c ON c.case_id = s.case_id WHERE portions > 0 AND gross_price > 0 GROUP BY 1, 2""",
    "binding_names": f"""WITH {_LEFT} SELECT d.case_id, d.product_id, string_agg(DISTINCT p.name, ', ' ORDER BY p.name) AS names FROM demand d JOIN rest r ON r.case_id = d.case_id AND r.product_id = d.part_id AND r.binding
        JOIN products p ON p.product_id = d.part_id GROUP BY d.case_id, d.product_id""",
    "find_names": "SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS name, NOT starts_with(lower(p_name), 's') AS inside FROM part WHERE contains(lower(p_name), 's')",
    "and_more": """SELECT invoice_id, array_to_string(n[1:3], ', ') || CASE WHEN len(n) > 3 THEN ' und ' || CAST(len(n) - 3 AS STRING) || ' weitere' ELSE '' END AS label
        FROM (SELECT invoice_id, list_sort(list(DISTINCT name)) AS n FROM lines GROUP BY invoice_id) t""",
    "warnings": f"""WITH {_SOLD} SELECT case_id, 'usage-negative' AS code, product_id AS key FROM o_used WHERE used < 0
        UNION ALL SELECT case_id, 'yield-choice-unknown', rule_id FROM yield_choices WHERE rule_id IS NOT NULL AND rule_id NOT IN (SELECT rule_id FROM yield_rules)
        UNION ALL SELECT case_id, 'missing_factor', invoice_id || ':' || CAST(no AS STRING) FROM o_routed WHERE bucket = 'missing_factor'
        UNION ALL SELECT DISTINCT case_id, 'piece_weight', product_id FROM o_routed WHERE bucket = 'purchase' AND source = 'piece'
        UNION ALL SELECT case_id, 'stock_unit', product_id FROM o_entries WHERE counted IS NOT NULL AND base IS DISTINCT FROM counted
        UNION ALL SELECT case_id, 'price-missing', product_id FROM sold WHERE portions > 0 AND gross_price <= 0
        UNION ALL SELECT case_id, 'sparte-missing', product_id FROM sold WHERE portions > 0 AND division = 'unbestimmt' AND gross_price <> 0""",
    "report_data": """WITH i AS (SELECT case_id, count(*) AS n, count(DISTINCT supplier_name) AS s FROM invoices GROUP BY case_id),
        l AS (SELECT case_id, count(*) FILTER (bucket = 'purchase') AS n, CAST(coalesce(sum(line_net) FILTER (bucket IN ('unmapped', 'no_revenue')), 0) AS BIGINT) AS out FROM o_routed GROUP BY case_id),
        y AS (SELECT case_id, CAST(sum(cost) AS BIGINT) AS net, bool_or(rule_id IS NOT NULL) AS any_ FROM o_yield GROUP BY case_id)
        SELECT c.case_id, c.label, CAST(date_diff('day', period_from, period_to) + 1 AS BIGINT) AS period_days, coalesce(i.n, 0) AS n_invoices, coalesce(i.s, 0) AS n_suppliers, coalesce(l.n, 0) AS n_included, coalesce(y.net, 0) AS included_net,
               coalesce(y.any_, false) AS any_yields, coalesce(l.out, 0) AS excluded FROM cases c LEFT JOIN i ON i.case_id = c.case_id LEFT JOIN l ON l.case_id = c.case_id LEFT JOIN y ON y.case_id = c.case_id""",
    "group_exclusions": """WITH g AS (SELECT case_id, 'a:' || seller_article_id AS identity, bucket AS reason, count(*) AS n, CAST(sum(line_net) AS BIGINT) AS net FROM o_routed WHERE bucket <> 'purchase' GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY net DESC, identity, reason) AS place FROM g""",
    "sellable_products": f"WITH {_SELLABLE} SELECT product_id FROM sells",
    "fits_trade": f"WITH RECURSIVE {_FITS} SELECT * FROM fits",
    "ware_filter": """SELECT c.case_id, p.product_id FROM cases c CROSS JOIN products p WHERE coalesce(p.category_id, '') <> '' AND (c.gewerbe = '' OR NOT EXISTS (SELECT 1 FROM category_codes k WHERE k.category_id = p.category_id)
            OR EXISTS (SELECT 1 FROM category_codes k WHERE k.category_id = p.category_id AND starts_with(c.gewerbe, k.code)))
        UNION ALL SELECT c.case_id, p.product_id FROM cases c CROSS JOIN products p WHERE coalesce(p.category_id, '') = '' AND EXISTS (SELECT 1 FROM mappings m WHERE m.product_id = p.product_id AND m.confirmed)""",
    "loop_free_parts": f"""WITH RECURSIVE {_REACHED} SELECT m.product_id, p.product_id AS part_id FROM (SELECT DISTINCT product_id FROM recipes) m CROSS JOIN products p
        WHERE m.product_id <> p.product_id AND NOT EXISTS (SELECT 1 FROM pair x WHERE x.src = p.product_id AND x.part_id = m.product_id)""",
    "used_in": f"WITH RECURSIVE {_REACHED} SELECT c.case_id, x.part_id, string_agg(DISTINCT p.name, ', ' ORDER BY p.name) AS names FROM case_products c JOIN pair x ON x.src = c.product_id JOIN products p ON p.product_id = c.product_id GROUP BY 1, 2",
    "suggestion_candidates": f"WITH RECURSIVE {_OFFERED} SELECT case_id, product_id FROM offered",
    "import_summary": """WITH i AS (SELECT case_id, invoice_id, CASE WHEN source = 'ubl' THEN 'stored' WHEN CAST(number AS BIGINT) % 7 = 0 THEN 'failed' ELSE 'draft' END AS s FROM invoices)
        SELECT case_id, count(*) FILTER (s = 'stored') AS stored, count(*) FILTER (s = 'draft') AS drafts, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'stored') || ' Rechnungen übernommen, ' || count(*) FILTER (s = 'draft') || ' zur Durchsicht' AS summary,
               'Nicht importiert: ' || string_agg(invoice_id, '; ' ORDER BY invoice_id) FILTER (s = 'failed') AS failures FROM i GROUP BY case_id""",
    "rules_date": "SELECT greatest((SELECT max(ts) FROM events), (SELECT max(o_orderdate) FROM orders)) AS changed_at",
    "change_rules": """WITH last AS (SELECT max(event_id) + 1 AS v FROM events), now AS (SELECT user_id, arg_max(event_id, event_id) AS rev, arg_max(props, event_id) AS content, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id)
        SELECT 'product' AS kind, CAST(user_id + 1000000 AS STRING) AS id, v AS rev, CAST(event_id AS STRING) AS content, CAST(NULL AS BIGINT) AS deleted_at FROM events CROSS JOIN last WHERE event_type = 'purchase'
        UNION ALL SELECT 'product', CAST(user_id AS STRING), rev, content, CAST(0 AS BIGINT) FROM now WHERE t <> 'error' AND user_id IN (SELECT user_id FROM events WHERE event_id % 50 = 0)""",
    "rescale_guard": """SELECT DISTINCT product_id, u AS user FROM (SELECT p.product_id, m.mapping_id AS u FROM products p JOIN mappings m ON m.product_id = p.product_id WHERE p.unit = 'MLT'
            UNION ALL SELECT p.product_id, r.product_id FROM products p JOIN recipes r ON r.part_id = p.product_id AND r.product_id <> p.product_id WHERE p.unit = 'MLT') t
        WHERE u NOT IN (SELECT product_id FROM products WHERE unit IN ('MLT', 'GRM') OR product_id LIKE 'sold.a.%')""",
    "seed_rules": """WITH s AS (SELECT *, (length(product_id) * 3 + length(name)) % 7 AS n FROM products)
        SELECT product_id, CASE WHEN n IN (0, 2, 3) THEN upper(name) ELSE name END AS name, piece_amount, CAST(CASE WHEN n < 4 THEN 0 ELSE 5 END AS BIGINT) AS rev, CAST(CASE WHEN n = 1 THEN 9 END AS BIGINT) AS deleted_at FROM s""",
    "diff_case": "SELECT case_id, product_id, ord, gross_price, CASE WHEN ord % 3 = 0 THEN 0 ELSE vat END AS vat FROM case_products WHERE ord % 4 <> 0",
    "amend": """SELECT case_id, count(*) AS n, count(new) AS mapped FROM (SELECT case_id, mapping_id, CASE WHEN ord % 2 = 0 THEN 'own.' || name ELSE mapping_id END AS new, CASE WHEN length(invoice_id) % 2 = 0 THEN upper(name) ELSE name END AS held, name FROM lines) t
        WHERE new IS DISTINCT FROM mapping_id AND held = name GROUP BY case_id""",
    "purge": """SELECT case_id, count(*) AS n, 'document' AS what FROM invoices WHERE source = 'ubl' GROUP BY case_id
        UNION ALL SELECT case_id, count(DISTINCT mapping_id), 'mapping' FROM lines WHERE mapping_id IN (SELECT mapping_id FROM mappings WHERE mapping_id LIKE 'map.g.%') GROUP BY case_id""",
    "stale_recipes": "SELECT DISTINCT c.case_id, c.product_id FROM case_products c JOIN recipes r ON r.product_id = c.product_id WHERE r.amount = 175",
    "needs_mapping": "SELECT case_id FROM cases WHERE case_no % 3 = 0 OR case_no % 2 <> 1",
    "upsert_invoices": """WITH s AS (SELECT case_id, invoice_id, net_total, CAST(number AS BIGINT) * 10 AS ord FROM invoices WHERE source = 'ubl'),
        i AS (SELECT i.case_id, i.invoice_id, i.gross_total AS net_total, s.ord FROM invoices i LEFT JOIN s ON s.case_id = i.case_id AND s.invoice_id = i.invoice_id WHERE length(i.invoice_id) % 2 = 0)
        SELECT case_id, invoice_id, CAST(net_total AS BIGINT) AS net_total, ord FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.case_id = s.case_id AND i.invoice_id = s.invoice_id)
        UNION ALL SELECT i.case_id, i.invoice_id, CAST(net_total AS BIGINT), coalesce(i.ord, coalesce(m.last + 1, 0) + row_number() OVER (PARTITION BY i.case_id, i.ord IS NULL ORDER BY i.invoice_id) - 1) FROM i LEFT JOIN (SELECT case_id, max(ord) AS last FROM s GROUP BY case_id) m ON m.case_id = i.case_id""",
    "unseat_default": """WITH y AS (SELECT rule_id, is_default, length(rule_id) AS rev, CASE WHEN product_id IS NOT NULL THEN substr(product_id, 1, 12) ELSE 'c' END AS target FROM yield_rules)
        SELECT rule_id, target, is_default AND row_number() OVER (PARTITION BY target, is_default ORDER BY rev DESC, rule_id) = 1 AS is_default FROM y""",
    "yield_options": """WITH t AS (SELECT DISTINCT case_id, unnest(['p:' || b.product_id, 'c:' || p.category_id]) AS target FROM o_balance b JOIN products p ON p.product_id = b.product_id),
        r AS (SELECT rule_id, deduction, is_default, CASE WHEN product_id IS NOT NULL THEN 'p:' || product_id ELSE 'c:' || category_id END AS target FROM yield_rules),
        c AS (SELECT case_id, target, arg_max(struct_pack(r := rule_id), ord).r AS picked, count(*) AS n FROM (SELECT case_id, ord, rule_id, CASE WHEN product_id IS NOT NULL THEN 'p:' || product_id ELSE 'c:' || category_id END AS target FROM yield_choices) x GROUP BY ALL)
        SELECT t.case_id, t.target, r.rule_id, r.deduction, CASE WHEN c.n > 0 THEN coalesce(c.picked = r.rule_id, false) ELSE r.is_default END AS chosen FROM t JOIN r ON r.target = t.target LEFT JOIN c ON c.case_id = t.case_id AND c.target = t.target""",
    "promote_mapping": """WITH own AS (SELECT mapping_id, product_id, coalesce(factor, 77) AS factor FROM mappings WHERE NOT confirmed), w AS (SELECT product_id, min(factor) AS f FROM own WHERE factor > 0 GROUP BY product_id),
        p AS (SELECT CASE WHEN w.f IS NOT NULL AND p.piece_amount IS NULL AND p.counted IN ('g', 'ml') THEN w.f ELSE p.piece_amount END AS a, CASE WHEN w.f IS NOT NULL AND p.piece_amount IS NULL AND p.counted IN ('g', 'ml') THEN p.counted ELSE p.piece_unit END AS u
            FROM o_product p LEFT JOIN w ON w.product_id = p.product_id)
        SELECT 'mapping true' AS what, count(*) AS n, CAST(sum(f) AS BIGINT) AS total FROM (SELECT CASE WHEN confirmed THEN factor ELSE coalesce(factor, 77) END AS f FROM mappings) m
        UNION ALL SELECT 'piece ' || coalesce(u, '-'), count(*), CAST(sum(a) AS BIGINT) FROM p GROUP BY u""",
    "drop_promoted_recipes": """SELECT c.case_id, r.product_id, r.ord FROM case_products c JOIN recipes r ON r.product_id = c.product_id WHERE length(c.case_id) = 7 AND EXISTS (SELECT 1 FROM recipes x WHERE x.product_id = r.product_id AND x.ord = 2)""",
    "users_of": """SELECT 'category' AS kind, category_id AS id, 'product ' || product_id AS user FROM products WHERE category_id IS NOT NULL UNION SELECT 'category', category_id, 'yield ' || rule_id FROM yield_rules WHERE category_id IS NOT NULL
        UNION SELECT 'product', product_id, 'mapping ' || mapping_id FROM mappings UNION SELECT 'product', part_id, 'product ' || product_id FROM recipes UNION SELECT 'product', product_id, 'yield ' || rule_id FROM yield_rules WHERE product_id IS NOT NULL""",
    "period_filter": "SELECT case_id, count(*) AS n FROM lines WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY case_id",
}.items()}
ORACLES["suggest_assortment"] = steps(f"WITH RECURSIVE {_SOLD_PORTIONS}, {_rounds()}", _WITH_OFFERED)
