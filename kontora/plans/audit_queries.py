"""Queries of the audit engine over the driver's tables: lines, matching, recipes, stock and yield; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import UNITS, pack_size, unit
from ..operators import matching, recipes, stock
from ..shared import stored
from ..views import Audits, oracle

_VALUES = ", ".join(f"('{k}', '{u[0]}', '{u[2]}', {u[3]}, {str(u[4]).lower()}, {n})" for u in UNITS for n, ks in ((1, [u[0].lower()]), (2, u[5])) for k in ks)
_CANON = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{Nd}},]+', ' ', 'g'))"
_VALID = "(l.date IS NULL OR ((m.valid_from IS NULL OR l.date >= m.valid_from) AND (m.valid_to IS NULL OR l.date < m.valid_to)))"
_USABLE = f"{_VALID} AND (coalesce(m.unit_code, '') = '' OR coalesce(l.unit_code, '') = '' OR lower(m.unit_code) = lower(l.unit_code))"
_HIT = "SELECT l.case_id, l.invoice_id, l.ord, {} AS tier, m.mapping_id AS match_id, m.product_id, m.factor AS match_factor FROM lines l JOIN mappings m ON {}"

#: Statements that only the SQL side uses.
STEPS = {
    "o_units": f"SELECT * FROM (VALUES {_VALUES}) t(key, code, base, factor, container, pref)",
    "o_lookup": "SELECT key, arg_min(code, pref) AS code, arg_min(base, pref) AS base, arg_min(factor, pref) AS factor, arg_min(container, pref) AS container FROM o_units GROUP BY key",
    "o_matched": f"""
        SELECT l.*, h.match_id, h.product_id, h.match_factor FROM lines l LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY case_id, invoice_id, ord ORDER BY tier, match_id) AS rn FROM (
                {_HIT.format(0, "l.mapping_id = m.mapping_id")}
                UNION ALL {_HIT.format(1, "l.supplier_name = m.supplier_name AND l.seller_article_id = m.seller_article_id")} WHERE {_USABLE}
                UNION ALL {_HIT.format(2, "l.gtin = m.gtin")} WHERE {_USABLE}
                UNION ALL {_HIT.format(3, f"{_CANON.format('l.name')} = {_CANON.format('m.name')} AND {_CANON.format('l.name')} <> ''")} WHERE {_USABLE}
            ) hits
        ) h ON h.case_id = l.case_id AND h.invoice_id = l.invoice_id AND h.ord = l.ord AND h.rn = 1""",
    "o_enabled": "SELECT DISTINCT case_id, product_id FROM case_products JOIN products p USING (product_id) JOIN cases USING (case_id) WHERE (p.valid_from IS NULL OR period_to >= p.valid_from) AND (p.valid_to IS NULL OR period_to < p.valid_to)",
    "o_reach": "SELECT case_id, product_id FROM o_enabled UNION SELECT r.case_id, e.part_id FROM o_reach r JOIN recipes e ON e.product_id = r.product_id",
    "o_product": """
        SELECT p.*, CASE WHEN NOT u.container THEN u.base END AS counted, u.factor AS unit_factor, coalesce(p.category_id, '') = '' OR coalesce(c.division, '?') <> 'unbestimmt' AS goods, c.division
        FROM products p LEFT JOIN o_lookup u ON u.key = lower(p.unit) LEFT JOIN categories c ON c.category_id = p.category_id""",
    "o_parsed": """
        SELECT m.*, u.base AS b_base, u.factor AS b_factor, u.container AS b_container,
               CASE WHEN name LIKE '% 24 x 0,33 l' THEN 24 WHEN name LIKE '% 0,7 l 38%' THEN 1 WHEN name LIKE '% 5 kg' THEN 1 WHEN name LIKE '% 20 Stk' THEN 20 WHEN name LIKE '% 6 x 0,7' THEN 6 END AS p_count,
               CASE WHEN name LIKE '% 24 x 0,33 l' THEN 330 WHEN name LIKE '% 0,7 l 38%' THEN 700 WHEN name LIKE '% 5 kg' THEN 5000 WHEN name LIKE '% 20 Stk' THEN 1000 WHEN name LIKE '% 6 x 0,7' THEN 700 END AS p_size,
               CASE WHEN name LIKE '% 24 x 0,33 l' THEN 'ml' WHEN name LIKE '% 0,7 l 38%' THEN 'ml' WHEN name LIKE '% 5 kg' THEN 'g' WHEN name LIKE '% 20 Stk' THEN 'piece' END AS p_base
        FROM o_matched m LEFT JOIN o_lookup u ON u.key = lower(regexp_replace(trim(m.unit_code), '[.]$', ''))""",
    "o_factor": """
        SELECT l.*, p.counted AS want, p.product_id IS NOT NULL AS known,
               CASE WHEN p.counted IS NULL THEN NULL
                    WHEN NOT b_container AND b_base = p.counted THEN 'table'
                    WHEN match_factor IS NOT NULL THEN 'manual'
                    WHEN p_count IS NOT NULL AND ((p.counted = 'piece' AND p_base = 'piece') OR (p.counted <> 'piece' AND (p_base IS NULL OR p_base = p.counted))) THEN 'pack'
                    WHEN p_count IS NOT NULL AND piece_amount > 0 AND ((p.counted = piece_unit AND p_base = 'piece') OR (p.counted = 'piece' AND (p_base IS NULL OR p_base = piece_unit))) THEN 'piece'
                    WHEN NOT b_container AND piece_amount > 0 AND ((p.counted = piece_unit AND b_base = 'piece') OR (p.counted = 'piece' AND b_base = piece_unit)) THEN 'piece' END AS source,
               piece_amount, piece_unit,
               p_count IS NOT NULL AND piece_amount > 0 AND ((p.counted = piece_unit AND p_base = 'piece') OR (p.counted = 'piece' AND (p_base IS NULL OR p_base = piece_unit))) AS by_pack
        FROM o_parsed l LEFT JOIN o_product p ON p.product_id = l.product_id""",
    "o_amount": """
        SELECT *, CASE source WHEN 'table' THEN 0 WHEN 'manual' THEN match_factor
                   WHEN 'pack' THEN CASE WHEN want = 'piece' THEN p_count ELSE p_count * p_size END
                   WHEN 'piece' THEN CASE WHEN want = 'piece' THEN CASE WHEN by_pack THEN CASE WHEN p_base = 'piece' THEN p_count ELSE p_count * p_size END ELSE b_factor END
                                          ELSE CASE WHEN by_pack THEN p_count ELSE b_factor END * piece_amount END END AS fac,
               CASE WHEN source = 'piece' AND want = 'piece' THEN piece_amount ELSE 1 END AS per_
        FROM o_factor""",
    "o_routed": """
        SELECT a.*, CASE WHEN NOT known THEN 'unmapped' WHEN a.product_id = 'prod.pfand' THEN 'deposit' WHEN n.product_id IS NOT NULL THEN 'no_revenue'
                         WHEN r.product_id IS NULL OR want IS NULL THEN 'unused' WHEN source IS NULL THEN 'missing_factor' ELSE 'purchase' END AS bucket,
               CAST(CASE WHEN per_ = 1 THEN quantity * CASE WHEN source = 'table' THEN b_factor ELSE fac END // 1000
                    ELSE sign(quantity) * ((abs(quantity) * fac + per_ * 500) // (per_ * 1000)) END AS BIGINT) AS amount
        FROM o_amount a LEFT JOIN (SELECT DISTINCT case_id, product_id FROM o_reach) r ON r.case_id = a.case_id AND r.product_id = a.product_id
        LEFT JOIN (SELECT DISTINCT case_id, product_id FROM no_revenue) n ON n.case_id = a.case_id AND n.product_id = a.product_id""",
    "o_bought": "SELECT case_id, product_id, any_value(want) AS counted, CAST(sum(amount) AS BIGINT) AS bought, CAST(sum(line_net) AS BIGINT) AS cost, count(*) AS n_lines, count(*) FILTER (source = 'piece') AS n_by_piece FROM o_routed WHERE bucket = 'purchase' GROUP BY case_id, product_id",
    "o_entries": """
        SELECT i.*, u.base, u.factor, p.counted FROM inventory i JOIN o_product p ON p.product_id = i.product_id LEFT JOIN o_lookup u ON u.key = lower(i.unit)
        WHERE EXISTS (SELECT 1 FROM o_reach r WHERE r.case_id = i.case_id AND r.product_id = i.product_id) AND NOT EXISTS (SELECT 1 FROM no_revenue n WHERE n.case_id = i.case_id AND n.product_id = i.product_id)""",
    "o_balance": """
        SELECT coalesce(b.case_id, e.case_id) AS case_id, coalesce(b.product_id, e.product_id) AS product_id, coalesce(bought, 0) AS bought, coalesce(cost, 0) AS cost, coalesce(opening, 0) AS opening, coalesce(closing, 0) AS closing
        FROM o_bought b FULL JOIN (SELECT case_id, product_id, arg_max(opening * factor, ord) AS opening, arg_max(closing * factor, ord) AS closing FROM o_entries WHERE base = counted GROUP BY case_id, product_id) e
        ON e.case_id = b.case_id AND e.product_id = b.product_id""",
    "o_used": "SELECT *, opening + bought - closing AS used, CAST(CASE WHEN bought > 0 THEN CAST(cost AS HUGEINT) * (opening + bought - closing) // bought ELSE cost END AS BIGINT) AS used_cost FROM o_balance",
    "o_yield": """
        SELECT s.*, CASE WHEN c1.n > 0 AND c1.rule_id IS NULL THEN NULL WHEN r1.rule_id IS NOT NULL THEN r1.rule_id WHEN c2.n > 0 AND c2.rule_id IS NULL THEN NULL
                         WHEN r2.rule_id IS NOT NULL THEN r2.rule_id ELSE coalesce(d1.rule_id, d2.rule_id) END AS rule_id
        FROM o_used s LEFT JOIN products p ON p.product_id = s.product_id
        LEFT JOIN (SELECT case_id, product_id, arg_max(struct_pack(r := rule_id), ord).r AS rule_id, count(*) AS n FROM yield_choices WHERE product_id IS NOT NULL GROUP BY ALL) c1 ON c1.case_id = s.case_id AND c1.product_id = s.product_id
        LEFT JOIN (SELECT case_id, category_id, arg_max(struct_pack(r := rule_id), ord).r AS rule_id, count(*) AS n FROM yield_choices WHERE product_id IS NULL GROUP BY ALL) c2 ON c2.case_id = s.case_id AND c2.category_id = p.category_id
        LEFT JOIN yield_rules r1 ON r1.rule_id = c1.rule_id LEFT JOIN yield_rules r2 ON r2.rule_id = c2.rule_id
        LEFT JOIN (SELECT product_id, min(rule_id) AS rule_id FROM yield_rules WHERE is_default AND product_id IS NOT NULL GROUP BY product_id) d1 ON d1.product_id = s.product_id
        LEFT JOIN (SELECT category_id, min(rule_id) AS rule_id FROM yield_rules WHERE is_default AND product_id IS NULL GROUP BY category_id) d2 ON d2.category_id = p.category_id""",
}


def steps(sql: str, known: dict[str, str] = STEPS) -> str:
    """A DuckDB statement with the steps (of known) and views that it names put in front."""
    import re

    body, found, todo = sql.strip(), set(), [sql]
    while todo:
        text = todo.pop()
        for s in known:
            if s not in found and re.search(rf"\b{s}\b", text):
                found.add(s)
                todo.append(known[s])
    ctes = ",\n".join(f"{s} AS ({known[s]})" for s in known if s in found)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    rest = (",\n" + body[own.end() :]) if own else "\n" + body
    full = f"WITH RECURSIVE {ctes}{rest}" if ctes else body
    return oracle(full, recursive=True)


class Audit:
    """The steps of the calculation over one folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.v = Audits(spark, sf_dir)

    def enabled(self) -> DataFrame:
        return recipes.enabled_products(self.v.cases, self.v.case_products, self.v.products)

    def reached(self) -> DataFrame:
        return recipes.reachable(self.enabled(), self.v.recipes)

    def matched(self) -> DataFrame:
        return matching.match_mapping(self.v.lines, self.v.mappings)

    def routed(self, reached: DataFrame | None = None, once: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
        """Routed lines; written where what follows reads them more than once. kept: the columns that are written, all by default."""
        v = self.v
        out = stock.route_lines(v.lines, v.mappings, v.products, v.categories, reached or self.reached(), v.no_revenue)
        out = out.select(*kept) if kept else out
        return out if once else stored(out, "routed")

    def balance(self) -> DataFrame:
        v, reached = self.v, stored(self.reached(), "reached")
        return stock.stock_balance(stock.stock_purchases(self.routed(reached, once=True)), v.inventory, v.products, reached, v.no_revenue)

    def sellable(self) -> DataFrame:
        v = self.v
        return stock.sellable(stock.resolve_yield(stored(self.balance(), "balance"), v.products, v.yield_choices, v.yield_rules))


def _q(f):
    return lambda spark, sf_dir: f(Audit(spark, sf_dir))


KEY = ["case_id", "invoice_id", "ord"]


def _included(a: Audit) -> DataFrame:
    """Places of included lines, which are numbered with the columns that their order needs; names and amounts stay behind."""
    excluded = a.routed(once=True).filter("bucket <> 'purchase'")
    return stock.included_lines(a.v.lines.select(*KEY, "no", "number", "date"), excluded).select(*KEY, "place")


QUERIES = {
    "purchases_by_product": _q(lambda a: stock.stock_purchases(a.routed(once=True))),
    "match_mapping": _q(lambda a: a.matched().select(*KEY, "match_id", "product_id", "match_factor")),
    "mapping_still_fits": _q(lambda a: matching.mapping_still_fits(a.v.lines, a.v.mappings).filter("mapping_id is not null").select(*KEY, "mapping_id")),
    "overlay_mappings": _q(lambda a: matching.overlay_mappings(a.v.mappings.filter("confirmed"), a.v.mappings.filter("not confirmed or factor > 4000"), a.v.products).select("mapping_id", "product_id", "confirmed")),
    "resolve_unit": _q(lambda a: a.v.lines.groupBy("unit_code").agg(F.count("*").alias("n")).select("unit_code", "n", unit(F.col("unit_code"))["code"].alias("code"), unit(F.col("unit_code"))["base"].alias("base"), unit(F.col("unit_code"))["factor"].alias("factor"))),
    "pack_sizes": _q(lambda a: a.v.lines.groupBy("name").agg(F.count("*").alias("n")).withColumn("p", pack_size(F.col("name"))).select("name", "n", F.col("p.count").alias("pack_count"), F.col("p.size").alias("pack_size"), F.col("p.base").alias("pack_base"))),
    "enabled_products": _q(lambda a: a.enabled()),
    "reachable": _q(lambda a: a.reached()),
    "reach_pairs": _q(lambda a: recipes.reach_pairs(a.v.recipes).withColumnRenamed("product_id", "part_id")),
    "recipe_cycles": _q(lambda a: recipes.cycles(a.v.recipes.unionByName(a.v.recipes.filter("product_id like 'sold.b.%' and part_id like 'sold.a.%'").selectExpr("part_id as product_id", "ord", "product_id as part_id", "amount", "unit").filter("length(part_id) = 9")))),
    "recipe_leaves": _q(lambda a: recipes.leaves(a.v.products, a.v.recipes)),
    "recipe_line_fits": _q(lambda a: recipes.line_fits(a.v.recipes, a.v.products).select("product_id", "ord", "part_id")),
    "route_lines": _q(lambda a: a.routed(once=True).select(*KEY, "bucket", "product_id", "counted", "factor", "per", "factor_source", "qty")),
    "route_summary": _q(lambda a: a.routed(once=True).groupBy("case_id", "bucket").agg(F.count("*").alias("n"), F.sum("line_net").alias("net"))),
    "case_totals": _q(lambda a: stock.case_totals(a.routed(once=True))),
    "line_totals": _q(lambda a: stock.line_totals(a.v.lines)),
    "supplier_sums": _q(lambda a: stock.supplier_sums(a.v.invoices)),
    "stock_balance": _q(lambda a: a.balance()),
    "stock_unit_flags": _q(lambda a: stock.stock_unit_flags(a.v.inventory, a.v.products, a.reached(), a.v.no_revenue)),
    "resolve_yield": _q(lambda a: a.sellable().select("case_id", "product_id", "rule_id", "deduction")),
    "sellable_stock": _q(lambda a: a.sellable().select("case_id", "product_id", "used", "used_cost", "sellable")),
    "included_lines": _q(_included),
}

_SEL = "case_id, invoice_id, ord"
#: What a product is made of in the end, as a statement step.
ORACLE_LEAVES = """leaf_paths AS (
            SELECT p.product_id, p.product_id AS leaf, CAST(u.factor AS DOUBLE) AS q, CASE WHEN NOT u.container THEN u.base END AS unit FROM products p LEFT JOIN o_lookup u ON u.key = lower(p.unit)
            UNION ALL SELECT r.product_id, e.part_id, r.q * e.amount * u.factor / (b.batch * bu.factor), u.base FROM leaf_paths r JOIN recipes e ON e.product_id = r.leaf JOIN products b ON b.product_id = r.leaf JOIN o_lookup u ON u.key = lower(e.unit) JOIN o_lookup bu ON bu.key = lower(b.unit)),
    leafs AS (SELECT product_id, leaf AS part_id, CAST(greatest(floor(sum(q) + 0.5 + 1e-9), 1) AS BIGINT) AS amount, any_value(unit) AS unit FROM leaf_paths r WHERE NOT EXISTS (SELECT 1 FROM recipes e WHERE e.product_id = r.leaf) GROUP BY product_id, leaf)"""

ORACLES = {k: steps(s) for k, s in {
    "purchases_by_product": "SELECT * FROM o_bought",
    "match_mapping": f"SELECT {_SEL}, match_id, product_id, match_factor FROM o_matched",
    "mapping_still_fits": f"""SELECT l.case_id, l.invoice_id, l.ord, l.mapping_id FROM lines l JOIN mappings m ON l.mapping_id = m.mapping_id
        WHERE {_USABLE} AND ((l.supplier_name = m.supplier_name AND l.seller_article_id = m.seller_article_id) OR l.gtin = m.gtin OR ({_CANON.format('l.name')} = {_CANON.format('m.name')} AND {_CANON.format('l.name')} <> ''))""",
    "overlay_mappings": """SELECT mapping_id, product_id, confirmed FROM mappings WHERE confirmed UNION ALL
        SELECT mapping_id, product_id, confirmed FROM mappings m WHERE (NOT confirmed OR factor > 4000) AND NOT EXISTS (SELECT 1 FROM mappings r WHERE r.confirmed AND r.mapping_id = m.mapping_id) AND product_id IN (SELECT product_id FROM products)""",
    "resolve_unit": "SELECT unit_code, count(*) AS n, any_value(u.code) AS code, any_value(base) AS base, any_value(factor) AS factor FROM lines LEFT JOIN o_lookup u ON u.key = lower(regexp_replace(trim(unit_code), '[.]$', '')) GROUP BY unit_code",
    "pack_sizes": "SELECT name, count(*) AS n, CAST(any_value(p_count) AS BIGINT) AS pack_count, CAST(any_value(p_size) AS BIGINT) AS pack_size, any_value(p_base) AS pack_base FROM o_parsed GROUP BY name",
    "enabled_products": "SELECT * FROM o_enabled",
    "reachable": "SELECT DISTINCT case_id, product_id FROM o_reach",
    "reach_pairs": "WITH RECURSIVE r AS (SELECT product_id AS src, part_id FROM recipes UNION SELECT r.src, e.part_id FROM r JOIN recipes e ON e.product_id = r.part_id) SELECT src, part_id FROM r",
    "recipe_cycles": "SELECT DISTINCT x AS product_id FROM (SELECT product_id AS x FROM recipes WHERE product_id LIKE 'sold.b.%' AND part_id LIKE 'sold.a.%' AND length(product_id) = 9 AND ord = 1 UNION ALL SELECT part_id FROM recipes WHERE product_id LIKE 'sold.b.%' AND part_id LIKE 'sold.a.%' AND length(product_id) = 9) t",
    "recipe_leaves": f"WITH RECURSIVE {ORACLE_LEAVES} SELECT * FROM leafs",
    "recipe_line_fits": "SELECT r.product_id, r.ord, r.part_id FROM recipes r JOIN o_product p ON p.product_id = r.part_id JOIN o_lookup u ON u.key = lower(r.unit) WHERE u.base = p.counted",
    "route_lines": f"""SELECT {_SEL}, bucket, CASE WHEN known THEN product_id END AS product_id, CASE WHEN bucket = 'purchase' THEN want END AS counted, CAST(CASE WHEN bucket = 'purchase' THEN fac END AS BIGINT) AS factor,
        CAST(CASE WHEN bucket = 'purchase' THEN per_ END AS BIGINT) AS per, CASE WHEN bucket = 'purchase' THEN source END AS factor_source, CASE WHEN bucket = 'purchase' THEN amount END AS qty FROM o_routed""",
    "route_summary": "SELECT case_id, bucket, count(*) AS n, CAST(sum(line_net) AS BIGINT) AS net FROM o_routed GROUP BY case_id, bucket",
    "case_totals": """WITH t AS (SELECT case_id, CAST(sum(line_net) AS BIGINT) AS a, CAST(coalesce(sum(line_net) FILTER (bucket = 'deposit' AND line_net > 0), 0) AS BIGINT) AS deposit_charged, CAST(coalesce(sum(line_net) FILTER (bucket = 'deposit' AND line_net < 0), 0) AS BIGINT) AS deposit_refunded,
            CAST(coalesce(sum(line_net) FILTER (bucket = 'unmapped'), 0) AS BIGINT) AS unmapped_cost, CAST(coalesce(sum(line_net) FILTER (bucket IN ('unused', 'missing_factor')), 0) AS BIGINT) AS unused_cost, CAST(coalesce(sum(line_net) FILTER (bucket = 'no_revenue'), 0) AS BIGINT) AS no_revenue_cost FROM o_routed GROUP BY case_id)
        SELECT case_id, deposit_charged, deposit_refunded, unmapped_cost, unused_cost, no_revenue_cost, a - deposit_charged - deposit_refunded AS purchases,
               CAST(coalesce((CAST(unmapped_cost AS HUGEINT) + no_revenue_cost) * 10000 // nullif(a - deposit_charged - deposit_refunded, 0), 0) AS BIGINT) AS excluded_share FROM t""",
    "line_totals": """WITH r AS (SELECT case_id, invoice_id, vat, sum(line_net) AS net FROM lines GROUP BY ALL)
        SELECT case_id, invoice_id, CAST(sum(net) AS BIGINT) AS net, CAST(sum(net) + sum(sign(net) * ((abs(net) * vat + 5000) // 10000)) AS BIGINT) AS gross FROM r GROUP BY ALL""",
    "supplier_sums": "SELECT case_id, supplier_name, count(*) AS n, CAST(sum(net_total) AS BIGINT) AS net, CAST(sum(gross_total) AS BIGINT) AS gross FROM invoices GROUP BY ALL",
    "stock_balance": "SELECT case_id, product_id, bought, cost, opening, closing, used, used_cost FROM o_used",
    "stock_unit_flags": "SELECT case_id, product_id, ord, unit, counted FROM o_entries WHERE counted IS NOT NULL AND base IS DISTINCT FROM counted",
    "resolve_yield": "SELECT y.case_id, y.product_id, y.rule_id, CAST(coalesce(r.deduction, 0) AS BIGINT) AS deduction FROM o_yield y LEFT JOIN yield_rules r ON r.rule_id = y.rule_id",
    "sellable_stock": "SELECT y.case_id, y.product_id, used, used_cost, CAST(CAST(used AS HUGEINT) * (10000 - coalesce(r.deduction, 0)) // 10000 AS BIGINT) AS sellable FROM o_yield y LEFT JOIN yield_rules r ON r.rule_id = y.rule_id",
    "included_lines": """SELECT case_id, invoice_id, ord, row_number() OVER (PARTITION BY case_id ORDER BY date, number, invoice_id, ord) AS place FROM lines l
        WHERE NOT EXISTS (SELECT 1 FROM o_routed r WHERE r.bucket <> 'purchase' AND r.case_id = l.case_id AND r.invoice_id = l.invoice_id AND r.no = l.no)""",
}.items()}
