"""Wordings of wares, vectors for them, and mappings made from suggestions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reading import containers, wording
from ..functions.text import canonical_name, title_if_upper
from ..shared import stored
from .matching import match_mapping

LEAST = 80
LINE = ["case_id", "invoice_id", "ord"]


def build_wordings(products: DataFrame, aliases: DataFrame, mappings: DataFrame) -> DataFrame:
    """(ware_id, rule_id, text, valid_from, valid_to): names and aliases of wares, and what confirmed mappings were seen as.

    A mapping's wording is left out where the ware has the same text already. aliases: (product_id, alias).
    """
    c = F.col
    none = F.lit(None).cast("string")
    span = ["valid_from", "valid_to"]
    names = products.select(c("product_id").alias("ware_id"), none.alias("rule_id"), c("name").alias("text"), *span)
    names = names.unionByName(aliases.join(products.select("product_id", *span), "product_id").select(c("product_id").alias("ware_id"), none.alias("rule_id"), c("alias").alias("text"), *span))
    names = names.filter(F.trim("text") != "").dropDuplicates(["ware_id", "text"])
    seen = mappings.filter("confirmed").select(c("product_id").alias("ware_id"), c("mapping_id").alias("rule_id"), title_if_upper(wording(c("observed"), c("name"))).alias("text"), *span)
    seen = seen.filter(F.trim("text") != "").join(names.select("ware_id", "text"), ["ware_id", "text"], "left_anti")
    return names.unionByName(seen)


def read_vectors(texts: DataFrame, own: DataFrame, shipped: DataFrame, model: str, width: int, encode: Callable | None = None) -> DataFrame:
    """(text, vec) of distinct texts: from the own store, else the shipped one, else encode(DataFrame of texts).

    Stores: (model, text, vec). Vectors of other models or another width do not count. Texts without one are left out.
    """
    c = F.col
    sound = lambda df, name: df.filter((c("model") == model) & (F.size("vec") == width)).groupBy("text").agg(F.first("vec").alias(name))
    met = texts.select("text").distinct().join(sound(own, "_own"), "text", "left").join(sound(shipped, "_shipped"), "text", "left")
    met = met.withColumn("vec", F.coalesce("_own", "_shipped")).select("text", "vec")
    known = met.filter("vec is not null")
    return known if encode is None else known.unionByName(encode(met.filter("vec is null").select("text")).select("text", "vec"))


def new_vectors(vectors: DataFrame, own: DataFrame, model: str) -> DataFrame:
    """Rows to append to the own store: vectors of texts that it does not hold for this model."""
    held = own.filter(F.col("model") == model).select("text")
    return vectors.join(held, "text", "left_anti").select(F.lit(model).alias("model"), "text", "vec")


def queries_of(lines: DataFrame) -> DataFrame:
    """lines with text (title case for names in capitals) and held, the packages that they name."""
    return lines.withColumns({"text": title_if_upper(F.col("name")), "held": containers(F.col("name"), F.col("unit_code"))})


def auto_map(lines: DataFrame, mappings: DataFrame, suggested: DataFrame, prefix: str = "own.") -> tuple[DataFrame, DataFrame]:
    """Mappings that a case makes of its best suggestions, and the lines matched with them.

    lines: open and mapped ones of cases. suggested: (LINE…, product_id, confidence), the best per line. From a confidence
    of LEAST on a line without mapping makes one: by supplier and article number where it has one, else by name. Lines
    of one key make one mapping, that of the first line; later lines find it as any other mapping.
    """
    c = F.col
    matched = stored(match_mapping(lines, mappings), "matched-lines")
    open_ = matched.filter("match_id is null").drop("match_id", "product_id", "match_factor")
    full = lambda x: F.coalesce(c(x), F.lit("")) != ""
    by_article = full("supplier_name") & full("seller_article_id")
    key = F.when(by_article, F.concat(F.lit("a:"), "supplier_name", F.lit("\x1f"), "seller_article_id")).otherwise(F.concat(F.lit("n:"), canonical_name(c("name"))))
    sure = suggested.filter(c("confidence") >= LEAST).select(*LINE, c("product_id").alias("_ware"))
    asked = open_.join(sure, LINE).withColumn("_key", key).filter("_key <> 'n:'")
    first = F.row_number().over(Window.partitionBy("case_id", "_key").orderBy("invoice_id", "ord"))
    made = asked.withColumn("_n", first).filter("_n = 1")
    none = F.lit(None)
    own = made.select(
        "case_id", F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", "case_id", "_key"), 256), 1, 16)).alias("mapping_id"),
        F.when(by_article, c("supplier_name")).alias("supplier_name"), F.when(by_article, c("seller_article_id")).alias("seller_article_id"), none.cast("string").alias("gtin"),
        F.when(~by_article, c("name")).alias("name"), F.when(full("unit_code"), c("unit_code")).alias("unit_code"), c("_ware").alias("product_id"), none.cast("bigint").alias("factor"),
        F.lit(False).alias("confirmed"), none.cast("date").alias("valid_from"), none.cast("date").alias("valid_to"),
    )
    own = stored(own, "own-mappings")
    # a case's own mapping holds for its lines only
    apart = lambda df, name: df.withColumn(name, F.concat_ws("\x1f", "case_id", name))
    again = match_mapping(apart(open_.withColumn("_as_printed", c("supplier_name")).withColumn("_name_printed", c("name")), "supplier_name").withColumn("name", F.concat_ws(" ", "case_id", "name")), apart(own, "supplier_name").withColumn("name", F.when(c("name").isNotNull(), F.concat_ws(" ", "case_id", "name"))))
    told = again.select(*[x for x in lines.columns if x not in ("supplier_name", "name")], c("_as_printed").alias("supplier_name"), c("_name_printed").alias("name"), "match_id", "product_id", "match_factor")
    return own, matched.filter("match_id is not null").unionByName(told.select(*matched.columns))


def piece_weight_flags(purchases: DataFrame, products: DataFrame) -> DataFrame:
    """(case_id, product_id, n, text): products with lines converted by the weight of a piece, and what that was."""
    met = purchases.filter("n_by_piece > 0").join(products.select("product_id", "name", "piece_amount", "piece_unit"), "product_id")
    text = F.concat("name", F.lit(": "), F.col("n_by_piece").cast("string"), F.lit(" × 1 Stk ≈ "), F.col("piece_amount").cast("string"), F.lit(" "), "piece_unit")
    return met.select("case_id", "product_id", F.col("n_by_piece").alias("n"), text.alias("text"))


def group_search_text(groups: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """groups (… supplier_name, identity, state, product_id) with search, all that a search for a group looks through."""
    named = products.select("product_id", F.col("name").alias("_name"), "category_id").join(categories.select("category_id", F.col("name").alias("_category")), "category_id", "left").drop("category_id")
    met = groups.join(named, "product_id", "left")
    return met.withColumn("search", F.lower(F.concat_ws(" ", "supplier_name", "identity", "state", "_name", "_category"))).drop("_name", "_category")


def group_order(state: Column) -> Column:
    """Open groups first, then automatic, then manual ones."""
    return F.when(state == "pending", 0).when(state == "automatic", 1).otherwise(2)
