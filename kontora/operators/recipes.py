"""Recipes as edge tables: what products are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import WIDE, fraction_sum, reduced, trunc_div, wide
from ..functions.units import base_unit, to_base, unit
from ..shared import stored
from .matching import valid_on


def enabled_products(cases: DataFrame, case_products: DataFrame, products: DataFrame) -> DataFrame:
    """(case_id, product_id) of listed products that exist and are valid at the end of the period."""
    p = products.select("product_id", "valid_from", "valid_to")
    both = case_products.select("case_id", "product_id").join(cases.select("case_id", "period_to"), "case_id").join(p, "product_id")
    return both.filter(valid_on(F.col("valid_from"), F.col("valid_to"), F.col("period_to"))).select("case_id", "product_id").distinct()


def line_fits(recipes: DataFrame, products: DataFrame) -> DataFrame:
    """Recipe lines whose part exists and is counted in the base unit of the line."""
    parts = products.select(F.col("product_id").alias("part_id"), base_unit(F.col("unit")).alias("_counted"))
    return recipes.join(parts, "part_id").filter(unit(F.col("unit")).base == F.col("_counted")).select(*recipes.columns)


def effective_recipes(case_ids: DataFrame, own: DataFrame, recipes: DataFrame, products: DataFrame) -> DataFrame:
    """(case_id, product_id, ord, part_id, amount, unit): a case's own recipe, where any of its lines fits, else the catalogue's."""
    fit = line_fits(own, products).join(products.select("product_id"), "product_id", "left_semi")
    over = fit.select("case_id", "product_id").distinct()
    catalogue = case_ids.select("case_id").distinct().crossJoin(recipes).join(over, ["case_id", "product_id"], "left_anti")
    columns = ["case_id", "product_id", "ord", "part_id", "amount", "unit"]
    return catalogue.select(*columns).unionByName(fit.select(*columns))


def _extend(reached: DataFrame, edges: DataFrame, by: list[str], at: str, what: str) -> DataFrame:
    """Follow edges (…, product_id, part_id) from rows of reached at column `at` until nothing is new."""
    keys = [*by, at]
    seen = stored(reached.distinct(), what)
    new = seen
    step = edges.select(*[c for c in by if c in edges.columns], F.col("product_id").alias(at), F.col("part_id").alias("_next")).distinct()
    on = [c for c in keys if c in step.columns]
    while not new.isEmpty():
        found = new.join(step, on).drop(at).withColumnRenamed("_next", at).select(*keys).distinct()
        new = stored(found.join(seen, keys, "left_anti"), what)
        seen = seen.unionByName(new)
    return seen


def reachable(listed: DataFrame, recipes: DataFrame) -> DataFrame:
    """(case_id, product_id) of everything that listed products contain, themselves included; cycles do no harm.

    Recipes with a case_id are those of the case, recipes without hold for all.
    """
    return _extend(listed.select("case_id", "product_id"), recipes, ["case_id"], "product_id", "reachable")


def reach_pairs(recipes: DataFrame) -> DataFrame:
    """(src, product_id): every product that src contains, at any depth."""
    direct = recipes.select(F.col("product_id").alias("src"), F.col("part_id").alias("product_id"))
    return _extend(direct, recipes, ["src"], "product_id", "reach-pairs")


def cycles(recipes: DataFrame) -> DataFrame:
    """Products whose recipe contains themselves."""
    return reach_pairs(recipes).filter("src = product_id").select("product_id").distinct()


def leaves(products: DataFrame, recipes: DataFrame, depth: int = 32) -> DataFrame:
    """(product_id, part_id, amount, unit): what one of a product's units uses up of products without a recipe.

    Amounts are exact fractions along every path, summed per part over a common denominator and rounded once, half up and
    never to nothing. A product without a recipe uses itself. Recipes have to be free of cycles; deeper ones are an error.
    """
    p = products.select("product_id", base_unit(F.col("unit")).alias("counted"), to_base(F.lit(1), F.col("unit")).alias("one"), to_base(F.col("batch"), F.col("unit")).alias("batch"))
    made = recipes.select("product_id").distinct()
    step = recipes.join(p.select("product_id", "batch"), "product_id").select(
        F.col("product_id").alias("at"), F.col("part_id").alias("next"), to_base(F.col("amount"), F.col("unit")).alias("up"), F.col("batch").alias("down"), F.coalesce(unit(F.col("unit")).base, F.lit("piece")).alias("base")
    )
    one = F.lit(1).cast(WIDE)
    open_ = p.select("product_id", F.col("product_id").alias("at"), F.coalesce("counted", F.lit("piece")).alias("base"), one.alias("num"), one.alias("den"))
    done = None
    for _ in range(depth):
        leaf = open_.join(made.select(F.col("product_id").alias("at")), "at", "left_anti")
        done = leaf if done is None else done.unionByName(leaf)
        moved = open_.join(step.withColumnRenamed("base", "_base"), "at")
        num, den = reduced(wide(F.col("num") * wide(F.col("up"))), wide(F.col("den") * wide(F.col("down"))))
        open_ = stored(moved.select("product_id", F.col("next").alias("at"), F.col("_base").alias("base"), num.alias("num"), den.alias("den")), "leaves")
        if open_.isEmpty():
            break
    else:
        raise ValueError("recipes are deeper than allowed, or contain themselves")
    total = done.groupBy("product_id", "at").agg(F.first("base").alias("unit"), fraction_sum(F.collect_list(F.struct("num", "den"))).alias("sum"))
    total = total.select("product_id", "at", "unit", "sum.num", "sum.den")
    scaled = total.join(p.select("product_id", "one"), "product_id").withColumn("n", (F.col("num") * wide(F.col("one"))).cast(WIDE))
    rounded = F.greatest(trunc_div(F.col("n") + trunc_div(F.col("den"), 2).cast(WIDE), F.col("den")), F.lit(1).cast(WIDE))
    amount = F.when(F.col("n") > 0, rounded).otherwise(F.lit(0)).cast("bigint")
    return scaled.select("product_id", F.col("at").alias("part_id"), amount.alias("amount"), "unit")
