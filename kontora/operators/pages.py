"""Rows, cells and items of read pages, and labels carried from known words to read ones.

Words have a box (x, y, w, h in pixels). Everything is keyed by document and page; a page is small, so that what has to be
done in order is a fold over the words of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 1.5
SEEN, ACCEPTED = 0.1, 0.3


def overlap_1d(a: Column, la: Column, b: Column, lb: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a + la, b + lb) - F.greatest(a, b))


def iou(a, b) -> Column:
    """Shared area of two boxes as a share of their union."""
    inter = overlap_1d(a.x, a.w, b.x, b.w) * overlap_1d(a.y, a.h, b.y, b.h)
    union = a.w * a.h + b.w * b.h - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def same_line(ay: Column, ah: Column, by: Column, bh: Column) -> Column:
    """Whether the middle of one box lies within the height of the other."""
    ca, cb = ay + F.floor(ah / 2), by + F.floor(bh / 2)
    return ((ca >= by) & (ca < by + bh)) | ((cb >= ay) & (cb < ay + ah))


def union_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, x, y, w, h): the box around all boxes of a key."""
    out = df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"))
    return out.select(*keys, "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))


def group_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys…, ord, text, x, y, w, h) with row and place in the row; blank words are left out.

    Words from top to bottom join the first row whose first word is on their line, else open a row. Rows count from the
    top, words in them from the left.
    """
    c = F.col
    page = words.filter(F.trim("text") != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "ord", "x", "w", "h", "text"))).alias("words"))
    anchor = "struct<y:bigint,h:bigint>"
    start = F.struct(F.array().cast(f"array<{anchor}>").alias("rows"), F.array().cast("array<int>").alias("at"))

    def put(s: Column, w: Column) -> Column:
        hit = F.array_position(F.transform(s.rows, lambda r: same_line(r.y, r.h, w.y, w.h)), True)
        mine = F.array(F.struct(w.y.cast("bigint").alias("y"), w.h.cast("bigint").alias("h")))
        return F.when(hit > 0, F.struct(s.rows.alias("rows"), F.concat(s.at, F.array((hit - 1).cast("int"))).alias("at"))).otherwise(
            F.struct(F.concat(s.rows, mine).alias("rows"), F.concat(s.at, F.array(F.size(s.rows))).alias("at"))
        )

    folded = page.withColumn("_at", F.aggregate("words", start, put, lambda s: s.at))
    rows = folded.select(*keys, F.posexplode("words").alias("_i", "_w"), "_at").select(*keys, "_w.*", F.get("_at", c("_i")).alias("_row"))
    tops = rows.groupBy(*keys, "_row").agg(F.min("y").alias("_top"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_top", "_row")) - 1
    place = F.row_number().over(Window.partitionBy(*keys, "row").orderBy("x", "ord")) - 1
    return rows.join(tops.withColumn("row", number), [*keys, "_row"]).drop("_row", "_top").withColumn("place", place)


def cells(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, row, cell, col, text, n): cells of each row; a new one at every cell start and at the start of the row.

    words: (keys…, row, x, ord, text, col, cell_start). A cell's column is the one most of its words name, the least of
    equal ones.
    """
    c = F.col
    order = Window.partitionBy(*keys, "row").orderBy("x", "ord")
    first = F.row_number().over(order) == 1
    numbered = words.withColumn("cell", F.sum(F.when(first | c("cell_start"), 1).otherwise(0)).over(order) - 1)
    votes = numbered.groupBy(*keys, "row", "cell", "col").agg(F.count("*").alias("n"))
    best = votes.groupBy(*keys, "row", "cell").agg(F.max_by("col", F.struct("n", (-c("col")).alias("c"))).alias("col"))
    texts = numbered.groupBy(*keys, "row", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda w: w.text), " ").alias("text"), F.count("*").alias("n"))
    return texts.join(best, [*keys, "row", "cell"])


def mark_cell_starts(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys…, row, x, ord, cell) with cell_start: the first word of each cell in its row; words without cell start none."""
    first = F.row_number().over(Window.partitionBy(*keys, "row", "cell").orderBy("x", "ord")) == 1
    return words.withColumn("cell_start", first & F.col("cell").isNotNull())


def segments(words: DataFrame, keys: list[str]) -> DataFrame:
    """words of one field (keys…, row, x, w, h, ord) with segment: a new one where the gap is wider than GAP heights."""
    order = Window.partitionBy(*keys, "row").orderBy("x", "ord")
    before = lambda x: F.lag(x).over(order)
    gap = F.col("x") - (before("x") + before("w"))
    wide = before("x").isNull() | (gap > F.lit(GAP) * F.greatest(F.col("h"), before("h")))
    return words.withColumn("_new", F.when(wide, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(order) - 1).drop("_new")


def items(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys…, row, role) with item: a line-item row opens one, wrap rows after it belong to it, others close it."""
    c = F.col
    order = Window.partitionBy(*keys).orderBy("row")
    wraps = c("role").isin("line-wrap", "continuation")
    count = F.sum(F.when(c("role") == "line-item", 1).otherwise(0)).over(order) - 1
    last = F.last(F.when(~wraps, c("role")), ignorenulls=True).over(order)
    return rows.withColumn("item", F.when((c("role") == "line-item") | (wraps & (last == "line-item")), count))


def wrap_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys…, row, role, item): the second and later rows of an item are 'line-wrap'."""
    later = F.row_number().over(Window.partitionBy(*keys, "item").orderBy("row")) > 1
    return rows.withColumn("role", F.when(F.col("item").isNotNull() & (F.col("role") == "line-item") & later, "line-wrap").otherwise(F.col("role")))


def inherit_columns(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys…, page, columns): a page without columns of its own takes those of the page before it."""
    order = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("columns", F.last("columns", ignorenulls=True).over(order))


def sequential(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, sequential): whether a column (keys…, row, text) holds whole numbers, each one more than the row before."""
    order = Window.partitionBy(*keys).orderBy("row")
    n = F.when(F.col("text").rlike(r"^\d{1,9}$"), F.col("text").try_cast("bigint"))
    good = n.isNotNull() & (F.lag(n).over(order).isNull() | (n == F.lag(n).over(order) + 1))
    marked = texts.withColumn("_good", good & (F.lag(F.lit(1)).over(order).isNull() | F.lag(n).over(order).isNotNull()))
    return marked.groupBy(*keys).agg((F.bool_and("_good") & (F.count("*") > 1)).alias("sequential"))


def windows(tokens: DataFrame, keys: list[str], size: int = 510, step: int = 382) -> DataFrame:
    """(keys…, window, start, stop) over documents of n tokens: overlapping windows until the end is covered."""
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - size) / F.lit(step)).cast("int") + 1)
    k = F.explode(F.sequence(F.lit(0), count - 1)).alias("window")
    return tokens.select(*keys, "n", k).select(*keys, "window", (F.col("window") * step).alias("start"), F.least(F.col("n"), F.col("window") * step + size).cast("int").alias("stop"))


def stitch(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, at, label, score): mean of what the windows say at each place. scores: (keys…, window, at, label, score)."""
    return scores.groupBy(*keys, "at", "label").agg(F.avg("score").alias("score"))


def _pairs(read: DataFrame, known: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Pairs of boxes of a page that share a tile, each once, with their overlap."""
    box = F.struct("x", "y", "w", "h")
    span = lambda a, la: F.sequence(F.floor(a / tile).cast("int"), F.floor((a + F.greatest(la, F.lit(1)) - 1) / tile).cast("int"))

    def tiled(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*keys, F.col("ord").alias(name), box.alias(f"_{name}"))
        rows = rows.withColumn("_tx", F.explode(span(F.col(f"_{name}.x"), F.col(f"_{name}.w"))))
        return rows.withColumn("_ty", F.explode(span(F.col(f"_{name}.y"), F.col(f"_{name}.h"))))

    met = tiled(read, "a").join(tiled(known, "b"), [*keys, "_tx", "_ty"]).dropDuplicates([*keys, "a", "b"])
    return met.select(*keys, "a", "b", iou(F.col("_a"), F.col("_b")).alias("iou")).filter("iou > 0")


def label_words(read: DataFrame, known: DataFrame, keys: list[str], tile: int = 64) -> DataFrame:
    """read words (keys…, ord, box) with the known word (ord, label) of the largest overlap.

    A word counts as seen from an overlap of SEEN and takes the label from ACCEPTED on; ties go to the first known word.
    """
    c = F.col
    best = _pairs(read, known, keys, tile).filter(c("iou") >= SEEN).groupBy(*keys, "a").agg(F.max_by(F.struct("b", "iou"), F.struct("iou", (-c("b")).alias("t"))).alias("hit"))
    met = read.join(best.withColumnRenamed("a", "ord"), [*keys, "ord"], "left")
    met = met.withColumn("_b", c("hit.b")).join(known.select(*keys, c("ord").alias("_b"), "label"), [*keys, "_b"], "left")
    return met.select(*read.columns, c("_b").alias("known"), F.when(c("hit.iou") >= ACCEPTED, c("label")).alias("label"))


def truth_coverage(known: DataFrame, read: DataFrame, keys: list[str], tile: int = 64) -> DataFrame:
    """known words (keys…, ord, text, box) with seen (some read word overlaps) and verbatim (one that reads the same)."""
    c = F.col
    met = _pairs(known, read, keys, tile).filter(c("iou") >= SEEN).join(read.select(*keys, c("ord").alias("b"), c("text").alias("_text")), [*keys, "b"])
    texts = met.join(known.select(*keys, c("ord").alias("a"), "text"), [*keys, "a"]).groupBy(*keys, "a").agg(F.bool_or(F.trim("text") == F.trim("_text")).alias("verbatim"))
    out = known.join(texts.withColumnRenamed("a", "ord"), [*keys, "ord"], "left")
    return out.withColumn("seen", c("verbatim").isNotNull()).withColumn("verbatim", F.coalesce("verbatim", F.lit(False)))


def ocr_ceiling(covered: DataFrame, field: str, profile: str) -> DataFrame:
    """(field, profile, n, unseen, misread, recoverable) over all known words, per field and per profile."""
    share = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    seen, verbatim = F.col("seen"), F.col("verbatim")
    sets = covered.groupingSets([(), (F.col(field),), (F.col(profile),)], F.col(field), F.col(profile))
    return sets.agg(F.count("*").alias("n"), share(~seen).alias("unseen"), share(seen & ~verbatim).alias("misread"), share(verbatim).alias("recoverable"))


def item_of(words: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys…, ord, box) with item, the first line-item region (keys…, region, box) that holds the word's middle."""
    c = F.col
    r = regions.select(*keys, "region", *[c(k).alias(f"_{k}") for k in "xywh"])
    cx, cy = c("x") + c("w") / 2, c("y") + c("h") / 2
    inside = (cx >= c("_x")) & (cx < c("_x") + c("_w")) & (cy >= c("_y")) & (cy < c("_y") + c("_h"))
    hit = words.select(*keys, "ord", *"xywh").join(r, keys).filter(inside).groupBy(*keys, "ord").agg(F.min("region").alias("item"))
    return words.join(hit, [*keys, "ord"], "left")


def row_roles(rows: DataFrame, regions: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """rows (keys…, row, y, h) with role, that of the region (keys…, region, role, y, h) covering most of it; else 'header'.

    A region counts if it covers `least` of the row's height.
    """
    c = F.col
    r = regions.select(*keys, "region", c("role").alias("_role"), c("y").alias("_y"), c("h").alias("_h"))
    share = overlap_1d(c("y"), c("h"), c("_y"), c("_h")) / c("h")
    met = rows.select(*keys, "row", "y", "h").join(r, keys).withColumn("share", share).filter(c("share") >= least)
    best = met.groupBy(*keys, "row").agg(F.max_by("_role", F.struct("share", (-c("region")).alias("t"))).alias("role"))
    return rows.join(best, [*keys, "row"], "left").withColumn("role", F.coalesce("role", F.lit("header")))


def vote_row_item(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, row, item): the item that most words of a row name, the least of equal ones; null items do not vote."""
    votes = words.filter("item is not null").groupBy(*keys, "row", "item").agg(F.count("*").alias("n"))
    return votes.groupBy(*keys, "row").agg(F.max_by("item", F.struct("n", (-F.col("item")).alias("t"))).alias("item"))


def mean_labels(logits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, label, mean): the place of the largest mean over windows, the first of equal ones. logits: (keys…, window, values).

    As roles of rows come from all windows that a row lies in, and labels of words from theirs. Windows without values
    do not count; a row without any has no label.
    """
    each = logits.select(*keys, F.posexplode("values").alias("label", "value"))
    means = each.groupBy(*keys, "label").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    best = F.max(F.struct("mean", (-F.col("label")).alias("label")))
    return means.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.label")).alias("label"), F.col("b.mean").alias("mean"))
