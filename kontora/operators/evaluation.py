"""How good readings and labels are: lines against expected lines, words against known words, shares against floors."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import fold_german, score_norm

HEADER = ("number", "date", "supplier_name", "net_total", "gross_total")
LINE = ("name", "quantity", "unit_code", "unit_price", "line_net", "vat")
THRESHOLD = 0.55


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching stretches of two texts, popular characters of long texts left out of the search."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def match_lines(got: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, got, want, score): lines put together best first, one to one.

    Score is the ratio of the names, and half a point for equal nets that are not 0; from THRESHOLD on. Ties go by place.
    Both: (keys…, ord, name, line_net). All pairs of one document are scored; taking them in order is a fold over its
    pairs, which are as many as a document has lines squared at most.
    """
    c = F.col
    a = got.select(*keys, c("ord").alias("got"), score_norm(F.coalesce("name", F.lit(""))).alias("_x"), c("line_net").alias("_p"))
    b = want.select(*keys, c("ord").alias("want"), score_norm(F.coalesce("name", F.lit(""))).alias("_y"), c("line_net").alias("_q"))
    pairs = a.join(b, keys)
    ratio = F.when(c("_x") == c("_y"), F.lit(1.0)).otherwise(c("_ratio"))
    texts = pairs.filter("_x <> _y").select("_x", "_y").distinct().withColumn("_ratio", sequence_ratio("_x", "_y"))
    scored = pairs.join(texts, ["_x", "_y"], "left").withColumn("score", ratio + F.when((c("_p") != 0) & (c("_p") == c("_q")), 0.5).otherwise(0.0)).filter(c("score") >= THRESHOLD)
    lists = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-c("score")).alias("s"), "got", "want"))).alias("pairs"))
    empty = F.array().cast("array<struct<s:double,got:bigint,want:bigint>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y.got == x.got) | (y.want == x.want))
    as_row = lambda x: F.array(F.struct(x.s.alias("s"), x.got.cast("bigint").alias("got"), x.want.cast("bigint").alias("want")))
    taken = F.aggregate("pairs", empty, lambda acc, x: F.when(free(acc, x), F.concat(acc, as_row(x))).otherwise(acc))
    return lists.select(*keys, F.inline(taken)).select(*keys, "got", "want", (-c("s")).alias("score"))


def score_documents(got: DataFrame, want: DataFrame, got_lines: DataFrame, want_lines: DataFrame, keys: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Per document: which header cells agree, numbers of lines, and wrong and all cells.

    got, want: (keys…, HEADER…); lines: (keys…, ord, LINE…). An expected line that nothing matches has all cells wrong.
    """
    c = F.col
    text = lambda x: score_norm(F.coalesce(x.cast("string"), F.lit("")))
    plain = ("number", "supplier_name", "name", "unit_code")
    same = lambda a, b, f: text(a) == text(b) if f in plain else a.eqNullSafe(b)
    heads = want.select(*keys, *[c(f).alias(f"_w_{f}") for f in HEADER]).join(got.select(*keys, *[c(f).alias(f"_g_{f}") for f in HEADER]), keys, "left")
    heads = heads.select(*keys, *[same(c(f"_g_{f}"), c(f"_w_{f}"), f).alias(f"ok_{f}") for f in HEADER])
    pairs = match_lines(got_lines, want_lines, keys) if pairs is None else pairs
    met = pairs.join(got_lines.select(*keys, c("ord").alias("got"), *[c(f).alias(f"_g_{f}") for f in LINE]), [*keys, "got"])
    met = met.join(want_lines.select(*keys, c("ord").alias("want"), *[c(f).alias(f"_w_{f}") for f in LINE]), [*keys, "want"])
    hits = met.groupBy(*keys).agg(F.count("*").alias("n_matched"), *[F.count_if(same(c(f"_g_{f}"), c(f"_w_{f}"), f)).alias(f"hit_{f}") for f in LINE])
    counts = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = heads.join(counts(got_lines, "n_got"), keys, "left").join(counts(want_lines, "n_want"), keys, "left").join(hits, keys, "left")
    out = out.na.fill(0, ["n_got", "n_want", "n_matched", *[f"hit_{f}" for f in LINE]])
    right = lambda names: sum((c(x) for x in names[1:]), c(names[0]))
    head = right([f"_{f}" for f in HEADER])
    out = out.withColumns({f"_{f}": c(f"ok_{f}").cast("int") for f in HEADER})
    total = F.lit(len(HEADER)) + c("n_want") * len(LINE)
    return out.withColumns({"n_cells": total, "n_wrong": total - head - right([f"hit_{f}" for f in LINE])}).drop(*[f"_{f}" for f in HEADER])


def score_report(documents: DataFrame) -> DataFrame:
    """(measure, value): clean rate, line precision and recall, mean and 90th percentile of wrong cells, header and field rates."""
    c = F.col
    n = F.count("*")
    rate = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    parts = [("clean", F.count_if(c("n_wrong") == 0) / n), ("line_precision", rate(c("n_matched"), c("n_got"))), ("line_recall", rate(c("n_matched"), c("n_want"))), ("mean_wrong", F.avg("n_wrong"))]
    parts += [(f"header_{f}", F.count_if(c(f"ok_{f}")) / n) for f in HEADER] + [(f"line_{f}", rate(c(f"hit_{f}"), c("n_matched"))) for f in LINE]
    wide = documents.agg(*[v.alias(k) for k, v in parts])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), c(k).cast("double").alias("value")) for k, _ in parts])))
    # the order statistic from counts per value, so that no task sorts all documents
    counts = documents.groupBy("n_wrong").agg(F.count("*").alias("n"))
    upto = Window.orderBy("n_wrong").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = F.bround(F.lit(0.9) * (c("all") - 1), 0)
    p90 = ranked.filter(c("upto") > at).agg(F.min("n_wrong").cast("double").alias("value")).select(F.lit("p90_wrong").alias("measure"), "value")
    return long.unionByName(p90)


def score_detail(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(line): one tab-separated row per document: key, wrong and all cells, lines, header bits."""
    bits = F.concat(*[F.when(F.col(f"ok_{f}"), "1").otherwise("0") for f in HEADER])
    return documents.select(F.concat_ws("\t", *keys, *[F.col(x).cast("string") for x in ("n_wrong", "n_cells", "n_matched", "n_got", "n_want")], bits).alias("line"))


def parity_report(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(field, n, same): in how many words two labelings of the same words agree, per field."""
    met = a.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields]).join(b.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields]), keys)
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")).alias("same")) for f in fields]))
    return met.select(each).groupBy("field").agg(F.count("*").alias("n"), F.count_if("same").alias("same"))


def structure_score(words: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, role_right, n_words, column_right, start_hit, start_said, start_true) over words with labels and guesses.

    words: (keys…, row, role, role_guess, col, col_guess, cell_start, start_guess). A row's guess is what most of its
    words say; a column is right where the guess most words of the true column share is the word's own.
    """
    c = F.col
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    votes = words.groupBy(*keys, "row", "role", "role_guess").agg(F.count("*").alias("n"))
    rows = votes.groupBy(*keys, "row", "role").agg(F.max_by("role_guess", F.struct("n", "role_guess")).alias("said"))
    by_row = rows.agg(F.count("*").alias("n_rows"), count(c("role") == c("said")).alias("role_right"))
    named = words.groupBy(*keys, "col", "col_guess").agg(F.count("*").alias("n"))
    modal = named.groupBy(*keys, "col").agg(F.max_by("col_guess", F.struct("n", "col_guess")).alias("modal"))
    met = words.join(modal, [*keys, "col"])
    by_word = met.agg(
        F.count("*").alias("n_words"), count(c("col_guess") == c("modal")).alias("column_right"), count(c("cell_start") & c("start_guess")).alias("start_hit"),
        count(c("start_guess")).alias("start_said"), count(c("cell_start")).alias("start_true"),
    )
    return by_row.crossJoin(by_word)  # one row each


def class_by_format(words: DataFrame, classes: DataFrame, known_gaps: DataFrame | None = None) -> DataFrame:
    """(format, class, n_words, n_pages, per_page): words per page of every class and page format, zeros too but known gaps.

    words: (page_id, format, class); classes: (class). known_gaps: (format, class).
    """
    pages = words.groupBy("format").agg(F.count_distinct("page_id").alias("n_pages"))
    counts = words.groupBy("format", "class").agg(F.count("*").alias("n_words"))
    every = pages.crossJoin(F.broadcast(classes))  # a handful of formats and of classes
    if known_gaps is not None:
        every = every.join(known_gaps, ["format", "class"], "left_anti")
    out = every.join(counts, ["format", "class"], "left").na.fill(0, ["n_words"])
    return out.withColumn("per_page", F.col("n_words") / F.col("n_pages"))


def page_shares(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(class, n_words, n_pages, share, target, met): share of pages that hold a class, against a target."""
    total = words.agg(F.count_distinct("page_id").alias("all"))
    of = words.groupBy("class").agg(F.count("*").alias("n_words"), F.count_distinct("page_id").alias("n_pages")).crossJoin(F.broadcast(total))
    out = targets.join(of, "class", "left").na.fill(0, ["n_words", "n_pages"]).withColumn("share", F.coalesce(F.col("n_pages") / F.col("all"), F.lit(0.0)))
    return out.select("class", "n_words", "n_pages", "share", "target", (F.col("share") >= F.col("target")).alias("met"))


def axis_floors(rows: DataFrame, axes: list[str], floors: DataFrame) -> DataFrame:
    """(axis, value, n, share, floor, met): shares of the values of each axis against their floors; missing values are 0."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])))
    counts = long.groupBy("axis", "value").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("all"))
    out = floors.join(counts, ["axis", "value"], "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))
    return out.select("axis", "value", "n", (F.col("n") / F.col("all")).alias("share"), "floor", (F.col("n") / F.col("all") >= F.col("floor")).alias("met"))


def column_swap_probe(words: DataFrame, keys: list[str], vintage: str = r"^(?:19|20)\d{2}$", code: str = r"^[A-Z]*\d{4,}$") -> DataFrame:
    """(keys…, row, kept): rows where the vintage stands in the column of most name words and no article code does.

    words: (keys…, row, text, field, col).
    """
    c = F.col
    votes = words.filter("field = 'name'").groupBy(*keys, "row", "col").agg(F.count("*").alias("n"))
    modal = votes.groupBy(*keys, "row").agg(F.max_by("col", F.struct("n", (-c("col")).alias("t"))).alias("modal"))
    met = words.join(modal, [*keys, "row"]).filter(c("text").rlike(vintage) | c("text").rlike(code))
    year = c("text").rlike(vintage)
    return met.groupBy(*keys, "row").agg(F.bool_and(F.when(year, c("col") == c("modal")).otherwise(c("col") != c("modal"))).alias("kept"))


def vat_exempt(lines: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, exempt): no line printed a rate and the expected lines have more than one rate that is not 0."""
    printed = lines.groupBy(*keys).agg(F.bool_or(F.coalesce("vat_printed", F.lit(False))).alias("printed"))
    rates = truth.filter("vat <> 0").groupBy(*keys).agg(F.count_distinct("vat").alias("rates"))
    return printed.join(rates, keys, "left").select(*keys, (~F.col("printed") & (F.coalesce("rates", F.lit(0)) > 1)).alias("exempt"))


def expectations(labels: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label, product_id): products whose name or alias folds to the labelled name; labels of no product give none."""
    names = products.select("product_id", fold_german(F.col("name")).alias("_key")).unionByName(aliases.select("product_id", fold_german(F.col("alias")).alias("_key")))
    return labels.select("label", fold_german(F.col("label")).alias("_key")).filter("_key <> ''").distinct().join(names, "_key").select("label", "product_id").distinct()


def prefer_expected(files: DataFrame) -> DataFrame:
    """(document, kind, path): one expected file per document, the PDF's before the XML's, then by path."""
    rank = F.when(F.col("kind") == "pdf", 0).otherwise(1)
    order = Window.partitionBy("document").orderBy(rank, "path")
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def validate_corpus(invoices: DataFrame, lines: DataFrame, words: DataFrame, charges: DataFrame) -> DataFrame:
    """(doc_id, code): documents whose sums, boxes, numbers or names do not hold together.

    invoices: (doc_id, number, supplier, buyer, net_total, width, height); lines: (doc_id, no, name, gtin, line_net);
    words: (doc_id, x, y, w, h); charges: (doc_id, amount).
    """
    c = F.col
    net = lines.groupBy("doc_id").agg(F.sum("line_net").alias("lines"), F.min("no").alias("low"), F.max("no").alias("high"), F.count_distinct("no").alias("n"))
    more = charges.groupBy("doc_id").agg(F.sum("amount").alias("more"))
    met = invoices.join(net, "doc_id", "left").join(more, "doc_id", "left").na.fill(0, ["lines", "more"])
    flag = lambda df, code: df.select("doc_id", F.lit(code).alias("code"))
    page = words.join(invoices.select("doc_id", "width", "height"), "doc_id")
    outside = (c("x") < 0) | (c("y") < 0) | (c("x") + c("w") > c("width")) | (c("y") + c("h") > c("height"))
    parts = [
        flag(met.filter("lines + more <> net_total"), "sum"), flag(met.filter("low <> 1 or high <> n"), "numbers"), flag(met.filter("buyer = supplier"), "parties"),
        flag(page.filter(outside).select("doc_id").distinct(), "box"), flag(lines.filter((F.coalesce("gtin", F.lit("")) != "") & F.contains("name", "gtin")).select("doc_id").distinct(), "gtin"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Characters that a reader confuses.
CONFUSABLE = {"0": "O", "O": "0", "1": "l", "l": "1", "I": "1", ",": ".", ".": ",", "5": "S", "S": "5", "8": "B", "B": "8"}


def augment_words(words: DataFrame, keys: list[str], seed: int = 0, drop: float = 0.015, jitter: float = 0.01, confuse: float = 0.02, cut: float = 0.005) -> DataFrame:
    """words (keys…, row, ord, text, x, y, w, h) as a worse scan would have them, the same for the same seed.

    A share is lost; boxes move by at most `jitter` of the page's height; in a share one character is confused; a share of
    words of four and more characters falls into two, and a share of neighbours in a row runs together. What each word
    suffers depends on its keys and place alone. part is 0, or 1 for the second half of a word that fell apart.
    """
    c = F.col
    draw = lambda salt: F.pmod(F.xxhash64(*keys, "ord", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    page = Window.partitionBy(*keys)
    reach = F.max(c("y") + c("h")).over(page) * jitter
    moved = lambda at, salt: c(at) + (draw(salt) * 2 - 1) * c("_reach")
    table = F.create_map(*[F.lit(x) for kv in CONFUSABLE.items() for x in kv])
    place = F.floor(draw(4) * F.length("text")).cast("int")
    other = F.coalesce(F.try_element_at(table, F.substring("text", c("_at") + 1, F.lit(1))), F.substring("text", c("_at") + 1, F.lit(1)))
    wrong = F.concat(F.substring("text", F.lit(1), c("_at")), other, F.substring("text", c("_at") + 2, F.length("text")))
    kept = words.withColumn("_reach", reach).filter(draw(1) >= drop).withColumns({"x": moved("x", 2), "y": moved("y", 3), "_at": place})
    kept = kept.withColumn("text", F.when((F.length("text") > 1) & (draw(5) < confuse), wrong).otherwise(c("text"))).drop("_reach", "_at")
    kept = kept.withColumn("_cut", (F.length("text") > 3) & (draw(6) < cut))
    order = Window.partitionBy(*keys, "row").orderBy("ord")
    # a word takes the next one in if neither falls apart, and that one is not taken in by it or takes another
    kept = kept.withColumn("_glue", ~c("_cut") & (draw(7) < cut) & ~F.lead("_cut", 1, True).over(order))
    run = F.sum(F.when(F.coalesce(F.lag("_glue").over(order), F.lit(False)), 0).otherwise(1)).over(order)
    kept = kept.withColumn("_run", run)
    word = F.struct("ord", "text", *[c(b).cast("double").alias(b) for b in ("x", "y", "w", "h")])
    place_in = F.row_number().over(Window.partitionBy(*keys, "row", "_run").orderBy("ord")) - 1
    kept = kept.withColumn("_pair", F.floor(place_in / 2))  # three in a row: two run together, the third stays
    glued = kept.groupBy(*keys, "row", "_run", "_pair").agg(F.array_sort(F.collect_list(word)).alias("ws"), F.bool_or("_cut").alias("_cut"))
    first = lambda f: F.get(c("ws"), F.lit(0))[f]
    over = lambda f: F.transform("ws", f)
    left, top = F.array_min(over(lambda w: w.x)), F.array_min(over(lambda w: w.y))
    one = glued.select(*keys, "row", first("ord").alias("ord"), F.array_join(over(lambda w: w.text), "").alias("text"), left.alias("x"), top.alias("y"), (F.array_max(over(lambda w: w.x + w.w)) - left).alias("w"), F.array_max(over(lambda w: w.h)).alias("h"), "_cut")
    at = (1 + F.floor(draw(8) * (F.length("text") - 1))).cast("int")
    one = one.withColumn("_k", at).withColumn("_w", c("w") * c("_k") / F.length("text"))
    half = lambda part, text, x, w: F.struct(F.lit(part).alias("part"), text.alias("text"), x.alias("x"), w.alias("w"))
    parts = F.when(c("_cut"), F.array(half(0, F.substring("text", F.lit(1), c("_k")), c("x"), c("_w")), half(1, F.substring("text", c("_k") + 1, F.length("text")), c("x") + c("_w"), c("w") - c("_w")))).otherwise(F.array(half(0, c("text"), c("x"), c("w"))))
    return one.withColumn("p", F.explode(parts)).select(*keys, "row", "ord", "p.part", "p.text", "p.x", "y", "p.w", "h")
