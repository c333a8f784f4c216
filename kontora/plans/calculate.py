"""The whole calculation of many audits at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import allocation, assortment, matching, recipes, revenue, stock
from ..shared import stored


#: The columns of routed lines that lists other than those of lines are made of.
REPORTED = (*stock.BALANCED, "name")


@dataclass
class Rules:
    products: DataFrame
    categories: DataFrame
    recipes: DataFrame
    mappings: DataFrame
    yield_rules: DataFrame


@dataclass
class Cases:
    cases: DataFrame
    lines: DataFrame
    case_products: DataFrame
    inventory: DataFrame
    no_revenue: DataFrame
    yield_choices: DataFrame
    pinned: DataFrame
    declared: DataFrame
    own_mappings: DataFrame | None = None
    own_recipes: DataFrame | None = None


@dataclass
class Report:
    """One DataFrame per list of a report."""

    routed: DataFrame
    stock: DataFrame
    routes: DataFrame
    allocation: DataFrame
    products: DataFrame
    markups: DataFrame
    estimates: DataFrame
    totals: DataFrame
    vat: DataFrame
    excluded: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def _mappings(c: Cases, r: Rules) -> DataFrame:
    return r.mappings if c.own_mappings is None else matching.overlay_mappings(r.mappings, c.own_mappings, r.products)


def calculate(c: Cases, r: Rules, matched: DataFrame | None = None, kept: tuple[str, ...] = ()) -> Report:
    """Match and route the lines, balance the stock, allocate portions, and derive revenue, estimates and VAT rows.

    What several lists share (routed lines, stock, routes, allocation, product rows) is written once and read again.
    matched: the lines as match_mapping gives them, where several calculations share them. kept: the columns of routed lines
    that are written and that the report then has; all by default, REPORTED are those that the other lists need.
    """
    mappings = _mappings(c, r)
    own = c.own_recipes
    recipe = r.recipes if own is None else recipes.effective_recipes(c.cases, own, r.recipes, r.products)
    listed = recipes.enabled_products(c.cases, c.case_products, r.products)
    reached = stored(recipes.reachable(listed, recipe), "reached")
    lines = stock.route_lines(c.lines, mappings, r.products, r.categories, reached, c.no_revenue, matched=matched)
    routed = stored(lines.select(*kept) if kept else lines, "routed")
    balance = stock.stock_balance(stock.stock_purchases(routed), c.inventory, r.products, reached, c.no_revenue)
    supply = stored(stock.sellable(stock.resolve_yield(balance, r.products, c.yield_choices, r.yield_rules)), "supply")
    scratch_made = stored(recipes.leaves(r.products, r.recipes), "made-from-scratch")
    ways = stored(allocation.routes(listed, recipe, r.products, supply, scratch_made), "ways")
    taken = stored(allocation.allocate(ways, supply, c.pinned), "allocation")
    rows = stored(revenue.product_rows(c.cases, c.case_products, r.products, r.categories, ways, taken, supply, c.pinned, scratch_made), "product-rows")
    totals = revenue.revenue_totals(rows, supply)
    rates = revenue.markups(rows, c.cases)
    priced = revenue.price_estimates(revenue.estimates(rows, taken, supply, routed, r.products, r.categories), rates, totals)
    sums = priced.groupBy("case_id").agg(F.sum("cost").alias("estimated_cost"), F.coalesce(F.sum("revenue_net"), F.lit(0)).alias("estimated_revenue"))
    excluded = stock.case_totals(routed)
    all_totals = totals.join(sums, "case_id", "left").join(excluded, "case_id", "full_outer").na.fill(0)
    calculated = rows.select("case_id", "vat", F.col("revenue_net").alias("net")).unionByName(revenue.spread_estimates(priced, rows))
    return Report(routed, supply, ways, taken, rows, rates, priced, all_totals, revenue.vat_rows(c.declared, calculated), routed.filter("bucket <> 'purchase'"))


def suggest_assortment(c: Cases, r: Rules, category_codes: DataFrame, dismissed: DataFrame, most: int = 5) -> DataFrame:
    """(case_id, product_id, place): what a business may sell besides what it lists, out of what its sales leave.

    The calculation runs twice over the same matched lines: as it is, and once more with the candidates listed, the portions
    sold pinned and the candidates pinned at none, so that what only they would use up counts as stock and as left over.
    Rates are those of the first run. category_codes: (category_id, code). dismissed: (case_id, product_id).
    """
    k = F.col
    key = ["case_id", "product_id"]
    needed = ["case_id", "name", "unit_code", "quantity", "line_net"]
    matched = stored(matching.match_mapping(c.lines, _mappings(c, r)).select(*needed, "match_id", "product_id", "match_factor"), "matched")
    c = replace(c, lines=matched.select(*needed))
    sold = calculate(c, r, matched, REPORTED)
    leaves = stored(recipes.leaves(r.products, r.recipes), "made-from-scratch")
    fits = stored(assortment.fits_trade(leaves, r.products, category_codes, c.cases.select("case_id", "gewerbe")), "fits")
    sellable = assortment.sellable_products(r.products, r.recipes, r.categories)
    offered = stored(assortment.candidates(c.cases, c.case_products, sellable, fits, dismissed), "candidates")
    listed = c.case_products.select(*key).distinct()
    last = c.case_products.groupBy("case_id").agg(F.max("ord").alias("last"))
    place = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("case_id").orderBy("product_id"))
    new = offered.join(last, "case_id", "left").select(*key, place.cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("gross_price"), F.lit(0).cast("bigint").alias("vat"))
    both = c.case_products.select(*new.columns).unionByName(new)
    pins = sold.products.join(listed, key, "left_semi").filter("portions > 0").select(*key, "portions")
    pins = stored(pins.unionByName(offered.select(*key, F.lit(0).cast("bigint").alias("portions"))), "pins")
    again = calculate(replace(c, case_products=stored(both, "listed-and-offered"), pinned=pins), r, matched, REPORTED)
    left = again.allocation.filter("kind = 'stock'").groupBy("case_id", k("node").alias("part_id")).agg(F.sum("n").alias("left"))
    supply = again.stock.select("case_id", k("product_id").alias("part_id"), "used", "used_cost").join(left, ["case_id", "part_id"], "left").na.fill(0, ["left"])
    amounts = offered.join(leaves, "product_id").select(*key, "part_id", "amount")
    divisions = r.products.join(r.categories, "category_id").select(k("product_id").alias("part_id"), "division")
    rates = sold.markups.filter("cost_of_goods > 0 and revenue_net > 0").select("case_id", "division", "markup")
    overall = sold.totals.select("case_id", F.when(k("revenue") > 0, k("markup")).otherwise(0).alias("markup"))
    return assortment.suggest(amounts, supply, divisions, rates, overall, most)
