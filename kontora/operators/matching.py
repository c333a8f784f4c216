"""Which mapping a line belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_name
from ..shared import stored

LINE = ["case_id", "invoice_id", "ord"]
SEP = "\x1f"


def valid_on(valid_from: Column, valid_to: Column, date: Column) -> Column:
    """Whether a date lies in [from, to); open ends and a missing date are valid."""
    return date.isNull() | ((valid_from.isNull() | (date >= valid_from)) & (valid_to.isNull() | (date < valid_to)))


def usable(m_unit: Column, m_from: Column, m_to: Column, unit_code: Column, date: Column) -> Column:
    """Valid on the date, and the mapping's unit blank, the line's unit blank or both equal ignoring case."""
    blank = F.coalesce(m_unit, F.lit("")) == ""
    return valid_on(m_from, m_to, date) & (blank | (F.coalesce(unit_code, F.lit("")) == "") | (F.lower(m_unit) == F.lower(unit_code)))


def _full(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def _hits(mappings: DataFrame) -> DataFrame:
    """(tier, key, hits): the mappings that each key names, by id. Tiers: own id, supplier and article, GTIN, name.

    Of mappings that apply to the same unit and dates only the first can win, so that a key holds no more of them than it
    has units and periods.
    """
    c = F.col
    both = F.when(_full(c("supplier_name")).isNotNull() & _full(c("seller_article_id")).isNotNull(), F.concat("supplier_name", F.lit(SEP), "seller_article_id"))
    keys = [_full(c("mapping_id")), both, _full(c("gtin")), _full(canonical_name(c("name")))]
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), k.alias("key")) for i, k in enumerate(keys)]))
    rows = mappings.select(keyed.alias("k"), F.struct("mapping_id", "product_id", "factor", "unit_code", "valid_from", "valid_to").alias("hit")).filter("k.key is not null")
    first = rows.groupBy("k.tier", "k.key", F.lower(F.coalesce("hit.unit_code", F.lit(""))).alias("_unit"), "hit.valid_from", "hit.valid_to").agg(F.min("hit").alias("hit"))
    return first.groupBy("tier", "key").agg(F.sort_array(F.collect_list("hit")).alias("hits"))


def mapping_keys(mappings: DataFrame) -> DataFrame:
    """The mappings that each key names, written, so that Spark knows its size when it chooses how to join; for match_keys."""
    return stored(_hits(mappings), "mapping-keys")


def match_mapping(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """lines with match_id, product_id and match_factor of the mapping that applies, null without one.

    The id that a line carries wins outright, even if expired; then supplier and article number, GTIN and canonical name,
    each among usable mappings, the smallest id first. The mappings of a key are put together in one table, which is
    written; lines meet it once per tier and never go back to themselves.
    """
    return match_keys(lines, mapping_keys(mappings))


def match_keys(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """match_mapping with a table of mapping_keys, for lines that come in batches.

    A tier's key is made when its turn comes, and of its mappings only the one that applies goes on to the next.
    """
    c = F.col
    both = F.when(_full(c("supplier_name")).isNotNull() & _full(c("seller_article_id")).isNotNull(), F.concat("supplier_name", F.lit(SEP), "seller_article_id"))
    fits = lambda h: usable(h.unit_code, h.valid_from, h.valid_to, c("unit_code"), c("date"))
    won = lambda h: F.when(h.isNotNull(), F.struct(*[h[x].alias(x) for x in ("mapping_id", "product_id", "factor")]))
    met = lines
    for k, key in enumerate([_full(c("mapping_id")), both, _full(c("gtin")), _full(canonical_name(c("name")))]):
        tier = hits.filter(c("tier") == k).select(c("key").alias("_tier_key"), c("hits").alias("_hits"))
        met = met.withColumn("_key", key).join(tier, c("_key") == c("_tier_key"), "left")
        best = won(F.get(F.filter("_hits", fits) if k else c("_hits"), F.lit(0)))
        met = met.select(*lines.columns, (F.coalesce("_best", best) if k else best).alias("_best"))
    return met.select(*lines.columns, c("_best.mapping_id").alias("match_id"), c("_best.product_id").alias("product_id"), c("_best.factor").alias("match_factor"))


def mapping_still_fits(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """lines whose mapping_id is taken away where its mapping is gone, unusable or fits none of the line's keys."""
    c = F.col
    m = mappings.select(*[c(x).alias(f"m_{x}") for x in ("mapping_id", "supplier_name", "seller_article_id", "gtin", "name", "unit_code", "valid_from", "valid_to")])
    same = lambda a, b: (F.coalesce(a, F.lit("")) != "") & (a == b)
    fits = usable(c("m_unit_code"), c("m_valid_from"), c("m_valid_to"), c("unit_code"), c("date")) & (
        (same(c("supplier_name"), c("m_supplier_name")) & same(c("seller_article_id"), c("m_seller_article_id"))) | same(c("gtin"), c("m_gtin")) | same(canonical_name(c("name")), canonical_name(c("m_name")))
    )
    kept = F.when(c("m_mapping_id").isNotNull() & fits, c("mapping_id"))
    return lines.join(m, c("mapping_id") == c("m_mapping_id"), "left").withColumn("mapping_id", kept).select(*lines.columns)


def overlay_mappings(rules: DataFrame, own: DataFrame, products: DataFrame) -> DataFrame:
    """The rules' mappings and those of a case's own whose id is new and whose product exists."""
    fresh = own.join(rules.select("mapping_id"), "mapping_id", "left_anti").join(products.select("product_id"), "product_id", "left_semi")
    return rules.unionByName(fresh.select(*rules.columns))

