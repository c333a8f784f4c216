"""From invoice lines to the stock of each product: routing, conversion, balance and yield."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FULL, WIDE, round_div, trunc_div, wide
from ..functions.units import base_unit, converted_quantity, factor, pack_size, to_base, unit
from ..shared import stored
from . import ordered
from .matching import match_mapping

DEPOSIT = "prod.pfand"
#: The columns of routed lines that purchases and totals are made of.
BALANCED = ("case_id", "product_id", "bucket", "counted", "factor_source", "qty", "line_net")


def with_division(products: DataFrame, categories: DataFrame) -> DataFrame:
    """products with division and goods: a product counts as goods unless its category belongs to no division."""
    c = categories.select("category_id", "division")
    goods = F.coalesce(F.col("category_id"), F.lit("")).eqNullSafe("") | (F.coalesce("division", F.lit("?")) != "unbestimmt")
    return products.join(c, "category_id", "left").withColumn("goods", goods).select(*products.columns, "division", "goods")


def route_lines(lines: DataFrame, mappings: DataFrame, products: DataFrame, categories: DataFrame, reached: DataFrame, no_revenue: DataFrame, deposit: str = DEPOSIT, matched: DataFrame | None = None) -> DataFrame:
    """lines with their bucket and, for purchases, the converted quantity. matched: lines that are matched already.

    Buckets in order of precedence: unmapped, deposit, no_revenue, unused, missing_factor, purchase. Adds match_id,
    product_id, bucket, counted (unit), factor, per, factor_source and qty. Pack sizes are read once per name, units once
    per code.
    """
    c = F.col
    piece = F.when(c("piece_amount").isNotNull(), F.struct(c("piece_amount").alias("amount"), c("piece_unit").alias("unit")))
    p = with_division(products, categories).select("product_id", base_unit(c("unit")).alias("counted"), "goods", piece.alias("piece"), F.lit(True).alias("known"))
    printed = stored(lines.select(c("name").alias("_name"), c("unit_code").alias("_code")).distinct(), "names-and-codes")
    packs = stored(printed.select("_name").distinct().withColumn("pack", pack_size(c("_name"))).filter("pack is not null"), "packs")
    codes = stored(printed.select("_code").distinct().withColumn("billed", unit(c("_code"))).filter("billed is not null"), "codes")
    matched = (match_mapping(lines, mappings) if matched is None else matched).join(p, "product_id", "left")
    matched = matched.join(packs, c("name") == c("_name"), "left").join(codes, c("unit_code") == c("_code"), "left")
    matched = matched.join(reached.select("case_id", "product_id", F.lit(True).alias("is_reached")), ["case_id", "product_id"], "left")
    matched = matched.join(no_revenue.select("case_id", "product_id", F.lit(True).alias("is_free")).distinct(), ["case_id", "product_id"], "left")
    routed = matched.withColumn("f", factor(c("counted"), c("piece"), c("unit_code"), c("pack"), c("match_factor"), c("billed")))
    bucket = (
        F.when(c("known").isNull(), "unmapped").when(c("product_id") == deposit, "deposit").when(c("is_free"), "no_revenue")
        .when(c("is_reached").isNull() | c("counted").isNull(), "unused").when(c("f").isNull(), "missing_factor").otherwise("purchase")
    )
    routed = routed.withColumn("bucket", bucket)
    buys = c("bucket") == "purchase"
    return routed.select(
        *lines.columns, "match_id", F.when(c("known"), c("product_id")).alias("product_id"), "bucket", F.when(buys, c("counted")).alias("counted"),
        F.when(buys, c("f.factor")).alias("factor"), F.when(buys, c("f.per")).alias("per"), F.when(buys, c("f.source")).alias("factor_source"),
        F.when(buys, converted_quantity(c("quantity"), c("unit_code"), c("f"), c("billed"))).alias("qty"),
    )


def stock_purchases(routed: DataFrame) -> DataFrame:
    """(case_id, product_id, counted, bought, cost, n_lines, n_by_piece) of all purchases."""
    return routed.filter("bucket = 'purchase'").groupBy("case_id", "product_id", "counted").agg(
        F.sum("qty").alias("bought"), F.sum("line_net").alias("cost"), F.count("*").alias("n_lines"), F.count_if(F.col("factor_source") == "piece").alias("n_by_piece")
    )


def stock_balance(purchases: DataFrame, inventory: DataFrame, products: DataFrame, reached: DataFrame, no_revenue: DataFrame) -> DataFrame:
    """(case_id, product_id, bought, cost, opening, closing, used, used_cost).

    Used is what was bought or, where the stock was counted in the product's unit, opening + bought - closing; the last
    entry of a product holds. Only products that are sold or inside something sold, and that bring revenue, are balanced.
    """
    c = F.col
    counted = products.select("product_id", base_unit(c("unit")).alias("counted"))
    entries = inventory.join(counted, "product_id").join(reached.select("case_id", "product_id"), ["case_id", "product_id"], "left_semi").join(no_revenue.select("case_id", "product_id"), ["case_id", "product_id"], "left_anti")
    fitting = entries.filter(unit(c("unit")).base == c("counted"))
    last = fitting.groupBy("case_id", "product_id").agg(F.max_by(F.struct(to_base(c("opening"), c("unit")).alias("opening"), to_base(c("closing"), c("unit")).alias("closing")), "ord").alias("e"))
    both = purchases.select("case_id", "product_id", "bought", "cost").join(last, ["case_id", "product_id"], "full_outer")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    both = both.select("case_id", "product_id", zero(c("bought")).alias("bought"), zero(c("cost")).alias("cost"), zero(c("e.opening")).alias("opening"), zero(c("e.closing")).alias("closing"))
    both = both.withColumn("used", c("opening") + c("bought") - c("closing"))
    used_cost = F.when(c("bought") > 0, trunc_div(wide(c("cost")) * wide(c("used")), c("bought"))).otherwise(c("cost")).cast("bigint")
    return both.withColumn("used_cost", used_cost)


def stock_unit_flags(inventory: DataFrame, products: DataFrame, reached: DataFrame, no_revenue: DataFrame) -> DataFrame:
    """Inventory entries that do not count, as their unit is not the product's."""
    c = F.col
    counted = products.select("product_id", base_unit(c("unit")).alias("counted")).filter(c("counted").isNotNull())
    entries = inventory.join(counted, "product_id").join(reached.select("case_id", "product_id"), ["case_id", "product_id"], "left_semi").join(no_revenue.select("case_id", "product_id"), ["case_id", "product_id"], "left_anti")
    return entries.filter(~unit(c("unit")).base.eqNullSafe(c("counted"))).select("case_id", "product_id", "ord", "unit", "counted")


def resolve_yield(stock: DataFrame, products: DataFrame, choices: DataFrame, rules: DataFrame) -> DataFrame:
    """stock with rule_id and deduction.

    The case's last choice for the product, else for its category, decides; a choice of no rule means no deduction and an
    unknown rule is passed over. Without a choice the product's default holds, else the category's.
    """
    c = F.col
    known = rules.select(c("rule_id"), "deduction")
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    pick = lambda df, by: df.groupBy("case_id", by).agg(F.max_by(F.struct(c("rule_id").isNull().alias("none"), "rule_id"), "ord").alias("y"))
    own = pick(choices.filter(~blank("product_id")), "product_id").withColumnRenamed("y", "y1")
    cat = pick(choices.filter(blank("product_id") & ~blank("category_id")), "category_id").withColumnRenamed("y", "y2")
    first = lambda df, by, to: df.groupBy(by).agg(F.min_by(F.struct("rule_id", "deduction"), "rule_id").alias(to))
    by_product = first(rules.filter(c("is_default") & ~blank("product_id")), "product_id", "d1")
    by_category = first(rules.filter(c("is_default") & blank("product_id") & ~blank("category_id")), "category_id", "d2")
    r = lambda k: known.select(c("rule_id").alias(f"_r{k}"), F.struct("rule_id", "deduction").alias(f"k{k}"))
    df = stock.join(products.select("product_id", F.when(~blank("category_id"), c("category_id")).alias("category_id")), "product_id", "left")
    df = df.join(own, ["case_id", "product_id"], "left").join(cat, ["case_id", "category_id"], "left")
    df = df.join(r(1), c("y1.rule_id") == c("_r1"), "left").join(r(2), c("y2.rule_id") == c("_r2"), "left")
    df = df.join(by_product, "product_id", "left").join(by_category, "category_id", "left")
    none = F.lit(None).cast("struct<rule_id:string,deduction:bigint>")
    rule = F.when(c("y1.none"), none).when(c("k1").isNotNull(), c("k1")).when(c("y2.none"), none).when(c("k2").isNotNull(), c("k2")).otherwise(F.coalesce("d1", "d2"))
    return df.withColumn("_rule", rule).select(*stock.columns, c("_rule.rule_id").alias("rule_id"), F.coalesce("_rule.deduction", F.lit(0)).cast("bigint").alias("deduction"))


def sellable(yielded: DataFrame) -> DataFrame:
    """yielded with sellable, the part of what was used that the deduction leaves."""
    return yielded.withColumn("sellable", trunc_div(wide(F.col("used")) * (F.lit(FULL).cast(WIDE) - wide(F.col("deduction"))), FULL).cast("bigint"))


def case_totals(routed: DataFrame) -> DataFrame:
    """Per case: purchases without deposits, deposits charged and refunded, what stays outside, and its share in basis points."""
    c = F.col
    of = lambda cond: F.coalesce(F.sum(F.when(cond, c("line_net"))), F.lit(0)).cast("bigint")
    deposit = c("bucket") == "deposit"
    t = routed.groupBy("case_id").agg(
        F.sum("line_net").alias("all_net"), of(deposit & (c("line_net") > 0)).alias("deposit_charged"), of(deposit & (c("line_net") < 0)).alias("deposit_refunded"),
        of(c("bucket") == "unmapped").alias("unmapped_cost"), of(c("bucket").isin("unused", "missing_factor")).alias("unused_cost"), of(c("bucket") == "no_revenue").alias("no_revenue_cost"),
    )
    t = t.withColumn("purchases", (c("all_net") - c("deposit_charged") - c("deposit_refunded")).cast("bigint")).drop("all_net")
    share = F.coalesce(trunc_div(wide(c("unmapped_cost") + c("no_revenue_cost")) * F.lit(FULL).cast(WIDE), c("purchases")), F.lit(0)).cast("bigint")
    return t.withColumn("excluded_share", share)


def line_totals(lines: DataFrame) -> DataFrame:
    """Per invoice: net, and gross with each rate's tax rounded once."""
    by_rate = lines.groupBy("case_id", "invoice_id", "vat").agg(F.sum("line_net").alias("net"))
    tax = round_div(wide(F.col("net")) * wide(F.col("vat")), FULL)
    return by_rate.groupBy("case_id", "invoice_id").agg(F.sum("net").alias("net"), (F.sum("net") + F.sum(tax)).alias("gross"))


def supplier_sums(invoices: DataFrame) -> DataFrame:
    """Per case and supplier: number of invoices, net and gross."""
    return invoices.groupBy("case_id", "supplier_name").agg(F.count("*").alias("n"), F.sum("net_total").alias("net"), F.sum("gross_total").alias("gross"))


def included_lines(lines: DataFrame, excluded: DataFrame) -> DataFrame:
    """Lines of invoices that are in no list of excluded lines, keyed by invoice and printed number, with their place by date and number."""
    key = ["case_id", "invoice_id", "no"]
    left = lines.join(excluded.select(*key).distinct(), key, "left_anti")
    return ordered.numbered(left, ["case_id"], ["date", "number", "invoice_id", "ord"], "place")
