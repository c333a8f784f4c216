"""Yearly guideline markups against what was calculated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def guideline_asof(cases: DataFrame, guideline: DataFrame) -> DataFrame:
    """(case_id, year): the guideline of the last year of the period, else the latest before; no row without one."""
    years = guideline.select("year").distinct()  # one row per published year
    met = cases.select("case_id", F.year("period_to").alias("at")).join(F.broadcast(years), F.col("year") <= F.col("at"))
    return met.groupBy("case_id").agg(F.max("year").cast("bigint").alias("year"))


def class_of(cases: DataFrame, guideline: DataFrame) -> DataFrame:
    """(case_id, year, class_ord, class_name): the one class with a code that equals or starts with the case's code.

    More than one class, or a blank code, gives none. Prefixes of the class codes make it an equal join.
    """
    codes = guideline.select("year", "class_ord", "class_name", "code").distinct()
    prefixes = codes.withColumn("gewerbe", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda i: F.substring(F.col("code"), F.lit(1), i))))
    met = cases.select("case_id", "gewerbe").join(guideline_asof(cases, guideline), "case_id").filter("gewerbe <> ''").join(prefixes, ["year", "gewerbe"])
    return met.groupBy("case_id", "year").agg(F.count_distinct("class_ord").alias("n"), F.min("class_ord").alias("class_ord"), F.min("class_name").alias("class_name")).filter("n = 1").drop("n")


def band_of(cases: DataFrame, guideline: DataFrame, revenue: DataFrame) -> DataFrame:
    """(case_id, year, class_ord, band, rate_from, rate_to, rate_mean): first band in order with above < revenue <= upto that carries a rate."""
    c = F.col
    known = class_of(cases, guideline).join(revenue.select("case_id", "revenue"), "case_id")
    bands = guideline.select("year", "class_ord", "band", "above", "upto", "rate_from", "rate_to", "rate_mean").filter("rate_mean is not null or rate_from is not null")
    inside = (c("above").isNull() | (c("above") < c("revenue"))) & (c("upto").isNull() | (c("revenue") <= c("upto")))
    met = known.join(bands, ["year", "class_ord"]).filter(inside)
    first = Window.partitionBy("case_id").orderBy("band")
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def compare_guideline(cases: DataFrame, guideline: DataFrame, totals: DataFrame) -> DataFrame:
    """(case_id, year, class_name, band, low, high, markup, verdict): below, within or above the frame of the band.

    totals: (case_id, revenue, markup). A frame without a range is its mean.
    """
    c = F.col
    low, high = F.coalesce("rate_from", "rate_mean"), F.coalesce("rate_to", "rate_mean")
    met = band_of(cases, guideline, totals).join(totals.select("case_id", "markup"), "case_id").withColumns({"low": low, "high": high})
    verdict = F.when(c("markup") < c("low"), "below").when(c("markup") > c("high"), "above").otherwise("within")
    return met.select("case_id", "year", "class_name", "band", "low", "high", "markup", verdict.alias("verdict"))


def gewerbe_names(guideline: DataFrame) -> DataFrame:
    """(code, names): class names of the latest year that has the code, in class order."""
    rows = guideline.select("code", "year", "class_ord", "class_name").distinct()
    latest = rows.withColumn("_y", F.max("year").over(Window.partitionBy("code"))).filter("year = _y")
    names = F.transform(F.array_sort(F.collect_set(F.struct("class_ord", "class_name"))), lambda x: x.class_name)
    return latest.groupBy("code").agg(F.array_join(names, " / ").alias("names"))


def guideline_infos(guideline: DataFrame) -> DataFrame:
    """(year, n_classes)."""
    return guideline.groupBy("year").agg(F.count_distinct("class_ord").alias("n_classes"))
