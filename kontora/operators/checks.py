"""Checks of read invoices and of rules and cases; every result is a table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FULL, line_net, round_div, wide
from ..functions.text import valid_code, valid_id
from ..functions.units import base_unit, unit
from .recipes import cycles

KEY = ["case_id", "invoice_id"]


def check_invoices(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(case_id, invoice_id, code, line_no, field): one row per cell that a failed check involves; line_no 0 is the header.

    Zero quantities, missing units, quantity times price against the net, totals that are not positive, lines against
    the net, and the gross against the tax of each rate or of each line. Stated totals go before the invoice's own.
    """
    c = F.col
    cells = lambda code, *fields: [F.struct(F.lit(code).alias("code"), F.lit(f).alias("field")) for f in fields]
    flag = lambda cond, xs: F.when(cond, F.array(*xs)).otherwise(F.array().cast("array<struct<code:string,field:string>>"))
    off = line_net(c("quantity"), c("unit_price"), c("price_base_qty")) != c("line_net")
    per_line = lines.select(*KEY, c("no").alias("line_no"), F.explode(F.concat(
        flag(c("quantity") == 0, cells("zero", "quantity")), flag(F.coalesce("unit_code", F.lit("")) == "", cells("no_unit", "unit")), flag(off, cells("line_total", "quantity", "unit_price", "line_net")),
    )).alias("f"))
    tax = round_div(wide(c("line_net")) * wide(c("vat")), FULL)
    by_rate = lines.groupBy(*KEY, "vat").agg(F.sum("line_net").alias("base"), F.sum(tax).alias("line_tax"))
    sums = by_rate.groupBy(*KEY).agg(F.sum("base").alias("sum"), F.sum("line_tax").alias("line_tax"), F.count("*").alias("rates"), F.max("vat").alias("rate"), F.sum(round_div(wide(c("base")) * wide(c("vat")), FULL)).alias("rate_tax"))
    head = invoices.select(*KEY, F.coalesce("stated_net", "net_total").alias("net"), F.coalesce("stated_gross", "gross_total").alias("gross")).join(sums, KEY, "left")
    expected = c("net") + F.when(c("rates") == 1, round_div(wide(c("net")) * wide(c("rate")), FULL)).otherwise(c("rate_tax"))
    bad_sum = F.coalesce(c("sum") != c("net"), F.lit(False))
    bad_gross = F.coalesce((expected != c("gross")) & (c("net") + c("line_tax") != c("gross")), F.lit(False))
    head = head.withColumns({"bad_sum": bad_sum, "bad_gross": bad_gross})
    per_head = head.select(*KEY, F.lit(0).cast("bigint").alias("line_no"), F.explode(F.concat(
        flag(c("net") <= 0, cells("nonpositive", "net_total")), flag(c("gross") <= 0, cells("nonpositive", "gross_total")),
        flag(c("bad_sum"), cells("sum_net", "net_total")), flag(c("bad_gross"), cells("gross_check", "gross_total", "net_total")),
    )).alias("f"))
    spread = lines.select(*KEY, c("no").alias("line_no")).join(head.filter("bad_sum or bad_gross").select(*KEY, "bad_sum", "bad_gross"), KEY)
    spread = spread.select(*KEY, "line_no", F.explode(F.concat(flag(c("bad_sum"), cells("sum_net", "line_net")), flag(c("bad_gross"), cells("gross_check", "vat")))).alias("f"))
    return reduce(DataFrame.unionByName, [per_line, per_head, spread]).select(*KEY, "f.code", "line_no", "f.field")


def verify(invoices: DataFrame, lines: DataFrame, flags: DataFrame, automatic: bool = True) -> DataFrame:
    """invoices with accepted: complete and without a flag (automatic), or without a blocking flag (confirmed by a person)."""
    c = F.col
    said = lambda code: F.count_if(c("code") == code)
    found = flags.groupBy(*KEY).agg(F.count("*").alias("n_flags"), said("line_total").alias("_total"), said("sum_net").alias("_sum"))
    n = lines.groupBy(*KEY).agg(F.count("*").alias("n_lines"))
    both = invoices.join(found, KEY, "left").join(n, KEY, "left").na.fill(0, ["n_flags", "_total", "_sum", "n_lines"])
    both = both.withColumn("n_blocking", c("_total") + F.when(c("stated_net").isNull(), c("_sum")).otherwise(0))
    complete = (c("n_flags") == 0) & (c("n_lines") > 0) & (F.coalesce("supplier_name", F.lit("")) != "") & (F.coalesce("number", F.lit("")) != "") & c("date").isNotNull() & (F.coalesce("stated_net", F.lit(0)) > 0) & (F.coalesce("stated_gross", F.lit(0)) > 0)
    return both.withColumn("accepted", complete if automatic else c("n_blocking") == 0).select(*invoices.columns, "n_flags", "n_blocking", "accepted")


def _findings(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    rows = [df.select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key")) for code, df, key in parts]
    return reduce(DataFrame.unionByName, rows)


def validate_rules(products: DataFrame, categories: DataFrame, recipes: DataFrame, mappings: DataFrame, yield_rules: DataFrame) -> DataFrame:
    """(code, key): every entry that breaks a rule of the catalogue."""
    c = F.col
    blank = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    ids = products.select("product_id")
    keyless = blank("gtin") & blank("name") & (blank("supplier_name") | blank("seller_article_id"))
    part_unit = recipes.join(products.select(c("product_id").alias("part_id"), base_unit(c("unit")).alias("counted")), "part_id")
    defaults = yield_rules.filter("is_default").withColumn("target", F.coalesce("product_id", "category_id"))
    return _findings([
        ("product_name", products.filter(blank("name")), "product_id"),
        ("product_id", products.filter(~valid_id(F.replace(c("product_id"), F.lit("#"), F.lit("")))), "product_id"),
        ("validity", products.filter("valid_from >= valid_to"), "product_id"),
        ("product_unit", products.filter(base_unit(c("unit")).isNull()), "product_id"),
        ("batch", products.filter("batch <= 0"), "product_id"),
        ("category", products.filter(~blank("category_id")).join(categories.select("category_id"), "category_id", "left_anti"), "product_id"),
        ("piece", products.filter("piece_amount <= 0 or (piece_amount is not null and coalesce(piece_unit, '') not in ('g', 'ml'))"), "product_id"),
        ("recipe_part", recipes.join(ids.withColumnRenamed("product_id", "part_id"), "part_id", "left_anti"), "product_id"),
        ("recipe_amount", recipes.filter("amount <= 0"), "product_id"),
        ("recipe_unit", part_unit.filter(~unit(c("unit")).base.eqNullSafe(c("counted"))), "product_id"),
        ("recipe_cycle", cycles(recipes), "product_id"),
        ("mapping_key", mappings.filter(keyless), "mapping_id"),
        ("mapping_factor", mappings.filter("factor <= 0"), "mapping_id"),
        ("mapping_product", mappings.join(ids, "product_id", "left_anti"), "mapping_id"),
        ("mapping_unit", mappings.filter(~blank("unit_code") & unit(c("unit_code")).isNull()), "mapping_id"),
        ("mapping_confirmed", mappings.filter("not confirmed"), "mapping_id"),
        ("yield_deduction", yield_rules.filter("deduction < 0 or deduction > 10000"), "rule_id"),
        ("yield_target", yield_rules.filter("(product_id is null) = (category_id is null)"), "rule_id"),
        ("yield_default", defaults.groupBy("target").count().filter("count > 1"), "target"),
    ])


def validate_cases(cases: DataFrame, case_products: DataFrame, inventory: DataFrame, yield_choices: DataFrame, declared: DataFrame) -> DataFrame:
    """(code, key): every case entry that is not allowed; the key is the case."""
    c = F.col
    twice = lambda df, *by: df.groupBy(*by).count().filter("count > 1")
    return _findings([
        ("case_id", cases.filter(~valid_id(c("case_id"))), "case_id"),
        ("label", cases.filter("trim(label) = ''"), "case_id"),
        ("period", cases.filter("period_from > period_to"), "case_id"),
        ("gewerbe", cases.filter((F.coalesce("gewerbe", F.lit("")) != "") & ~valid_code(c("gewerbe"))), "case_id"),
        ("product_vat", case_products.filter("vat not in (0, 700, 1900)"), "case_id"),
        ("product_price", case_products.filter("gross_price < 0"), "case_id"),
        ("product_twice", twice(case_products, "case_id", "product_id"), "case_id"),
        ("stock_negative", inventory.filter("opening < 0 or closing < 0"), "case_id"),
        ("stock_unit", inventory.filter(unit(c("unit")).isNull()), "case_id"),
        ("stock_twice", twice(inventory, "case_id", "product_id"), "case_id"),
        ("yield_target", yield_choices.filter("(product_id is null) = (category_id is null)"), "case_id"),
        ("declared_vat", declared.filter("vat not in (0, 700, 1900)"), "case_id"),
        ("declared_negative", declared.filter("net < 0"), "case_id"),
    ])


def covers(gewerbe: Column, code: Column) -> Column:
    """Whether a category holds in a trade: no code, no list, or a prefix of the code in the list."""
    return (F.coalesce(code, F.lit("")) == "") | (F.size(gewerbe) == 0) | F.exists(gewerbe, lambda g: code.startswith(g))


def contradicts(packages: Column, held: Column) -> Column:
    """Whether both sides name packages and none is common."""
    return (F.size(packages) > 0) & (F.size(held) > 0) & ~F.arrays_overlap(packages, held)
