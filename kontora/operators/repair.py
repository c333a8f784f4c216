"""Readings of invoice lines put right where quantity, price and net of a row leave one way only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_div, wide
from ..functions.reading import parse_number, unit_code
from . import ordered

#: Pairs of digits that a worn scan takes for each other, and the shape of a grouped number.
CONFUSED = "08 06 09 17 38 56 58 68 69 27 49 39".split()
GROUPED = r"^\d{1,3}[.,\s]\d{3}$"
STEP_QUANTITY, STEP_PRICE = 10, 10_000


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs() -> dict[str, str]:
    """Digit to what it may be, from the pairs of shapes."""
    return {d: "".join(x.replace(d, "", 1) for x in CONFUSED if d in x) for d in "0123456789"}


def adds(quantity: Column, price: Column, base: Column, net: Column) -> Column:
    """Whether quantity times price, rounded to cents, is the net: twice the product lies within one cent of twice the net."""
    whole = F.when(base > 0, base).otherwise(F.lit(1000)) * 10_000
    product, target = wide(quantity) * wide(price), wide(net) * wide(whole)
    far = F.abs(product - target) * 2
    return F.when(product >= 0, (far < whole) | ((far == whole) & (product < target))).otherwise((far < whole) | ((far == whole) & (product > target)))


def regroup_quantity(quantity: Column, price: Column, base: Column, net: Column, text: Column) -> Column:
    """A quantity printed as '5,450' and read as thousands, in thousandths where only then the row adds up."""
    asked = (net != 0) & (price != 0) & (base != 0) & (quantity % 1000 == 0) & F.trim(text).rlike(GROUPED)
    smaller = F.floor(quantity / 1000).cast("bigint")
    return F.when(asked & ~adds(quantity, price, base, net) & adds(smaller, price, base, net), smaller).otherwise(quantity)


def may_add(quantity: Column, price: Column, base: Column, net: Column) -> Column:
    """Whether a row may add up, in floating point: true for all rows that do, and cheap where most do not."""
    real = lambda x: x.cast("double")
    whole = real(F.when(base > 0, base).otherwise(F.lit(1000))) * 10_000.0
    product, target = real(quantity) * real(price), real(net) * whole
    return F.abs(product - target) * 2 <= whole + (F.abs(product) + F.abs(target)) * 1e-12


def confusions(value: Column) -> Column:
    """Numbers that differ from a value in one digit of a shape like it; a leading digit does not become 0."""
    positive = F.abs(value).cast("bigint")
    digits = positive.cast("string")
    sign = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    shapes = F.array(*[F.array(*[F.lit(int(x)).cast("bigint") for x in others]) for _, others in sorted(_pairs().items())])
    steps = F.array(*[F.lit(10**k).cast("bigint") for k in range(19)])
    at = F.sequence(F.lit(1), F.length(digits))

    def swaps(i: Column) -> Column:
        digit, step = F.substring(digits, i, F.lit(1)).cast("int"), F.get(steps, F.length(digits) - i)
        others = F.filter(F.get(shapes, digit), lambda d: ~((i == 1) & (d == 0) & (F.length(digits) > 1)))
        return F.transform(others, lambda d: sign * (positive + (d - digit) * step))

    return F.array_distinct(F.flatten(F.transform(at, swaps)))


def strays(text: Column, minus: Column) -> Column:
    """Texts without a stray minus, without their first digit, and without their last one, where each can be one."""
    def without(t: Column) -> Column:
        first = F.regexp_instr(t, F.lit("[0-9]"))
        rest = F.regexp_replace(F.regexp_extract(t, r"[0-9](.*)$", 1), r"^[. ](?=[0-9])", "")
        head = lambda r: F.when(r.rlike("^[0-9]") & ~r.rlike("^0[0-9]"), F.concat(F.substring(t, F.lit(1), first - 1), r))
        tail = F.when(t.rlike(r"[0-9].*[0-9]"), F.regexp_replace(t, r"[0-9]([^0-9]*)$", "$1"))
        sign = F.when(minus & F.startswith(t, F.lit("-")), F.substring(t, F.lit(2), F.length(t)))
        return F.array_compact(F.array(sign, _let(rest, head), tail))

    return _let(F.trim(F.coalesce(text, F.lit(""))), without)


def _readings(value: Column, text: Column, scale: int, lone: Column) -> Column:
    edits = F.transform(strays(text, lone & (value < 0)), lambda e: parse_number(e, scale))
    return F.array_distinct(F.filter(F.concat(confusions(value), edits), lambda v: (v != 0) & (v != value)))


def _exact(net: Column, base: Column, by: Column, step: int) -> Column:
    value = round_div(wide(net) * wide(base) * 10_000, by)
    return F.when((value != 0) & (value % step == 0), value)


def restore_cells(lines: DataFrame) -> DataFrame:
    """lines with a lost quantity or price put back where the division by the other is exact, and restored.

    A price may also come of the one digit confusion of the quantity that divides out.
    """
    c = F.col
    base = F.when(c("price_base_qty") > 0, c("price_base_qty")).otherwise(F.lit(1000))
    q = _exact(c("line_net"), base, c("unit_price"), STEP_QUANTITY)
    q = F.when(adds(q, c("unit_price"), base, c("line_net")), q)
    price_of = lambda x: _exact(c("line_net"), base, x, STEP_PRICE)
    p = F.when(adds(c("quantity"), price_of(c("quantity")), base, c("line_net")), price_of(c("quantity")))
    other = F.filter(F.transform(confusions(c("quantity")), lambda x: F.struct(x.alias("q"), price_of(x).alias("p"))), lambda y: y.p.isNotNull() & adds(y.q, y.p, base, c("line_net")))
    one = F.when(F.size(other) == 1, F.get(other, F.lit(0)))
    no_q = (c("line_net") != 0) & (c("quantity") == 0) & (c("unit_price") != 0)
    no_p = (c("line_net") != 0) & (c("unit_price") == 0) & (c("quantity") != 0)
    fix = F.when(no_q & q.isNotNull(), F.struct(q.alias("q"), c("unit_price").alias("p"))).when(no_p & p.isNotNull(), F.struct(c("quantity").alias("q"), p.alias("p"))).when(no_p & one.isNotNull(), F.struct(one.q.alias("q"), one.p.alias("p")))
    met = lines.withColumn("_fix", fix)
    return met.withColumns({"quantity": F.coalesce("_fix.q", "quantity"), "unit_price": F.coalesce("_fix.p", "unit_price"), "restored": c("_fix").isNotNull()}).drop("_fix")


def repair_lines(lines: DataFrame) -> DataFrame:
    """lines (… quantity_text, price_text, net_text) with one cell put right, and repaired, the name of that cell.

    All edits of one digit of one cell are tried: a shape like it, a stray digit before or after it, a lone minus. Only
    where exactly one of them makes the row add up it is taken.
    """
    c = F.col
    q, p, b, n = c("quantity"), c("unit_price"), c("price_base_qty"), c("line_net")
    negative = lambda x: F.when(x < 0, 1).otherwise(0)
    lone = negative(q) + negative(p) + negative(n) == 1
    hit = lambda name, values, test: F.transform(F.filter(values, test), lambda v: F.struct(F.lit(name).alias("cell"), v.alias("value")))
    found = F.concat(
        hit("quantity", _readings(q, c("quantity_text"), 3, lone), lambda v: may_add(v, p, b, n) & adds(v, p, b, n)),
        hit("unit_price", _readings(p, c("price_text"), 6, lone), lambda v: may_add(q, v, b, n) & adds(q, v, b, n)),
        hit("line_net", _readings(n, c("net_text"), 2, lone), lambda v: may_add(q, p, b, v) & adds(q, p, b, v)),
    )
    asked = (q != 0) & (p != 0) & (n != 0) & ~adds(q, p, b, n)
    only = F.element_at(F.transform(F.array(found), lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0)))), 1)
    met = lines.withColumn("_one", F.when(asked, only))
    new = {x: F.when(c("_one.cell") == x, c("_one.value")).otherwise(c(x)) for x in ("quantity", "unit_price", "line_net")}
    return met.withColumns({**new, "repaired": c("_one.cell")}).drop("_one")


def accept_rereads(lines: DataFrame, rereads: DataFrame, keys: list[str]) -> DataFrame:
    """lines with amounts read again (keys…, quantity, unit_price, line_net; null where not) only where the row then adds up."""
    c = F.col
    names = ("quantity", "unit_price", "line_net")
    met = lines.join(rereads.select(*keys, *[c(x).alias(f"_{x}") for x in names]), keys, "left")
    new = {x: F.coalesce(f"_{x}", x) for x in names}
    good = adds(new["quantity"], new["unit_price"], c("price_base_qty"), new["line_net"])
    return met.select(*[F.when(good, new[x]).otherwise(c(x)).alias(x) if x in names else c(x) for x in lines.columns], F.coalesce(good & F.coalesce(*[c(f"_{x}") for x in names]).isNotNull(), F.lit(False)).alias("reread"))


def complete_units(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys…, ord, unit_text) with a unit cut short completed, where one printed unit of the invoice begins with it."""
    c = F.col
    code = unit_code(c("unit_text"))
    printed = lines.filter((code != "") & (F.length("unit_text") > 1)).groupBy(*keys, code.alias("_code")).agg(F.min("unit_text").alias("_text"))
    short = lines.filter(F.length("unit_text") == 1).select(*keys, F.lower("unit_text").alias("_short")).distinct()
    met = short.join(printed, keys).filter(F.startswith(F.lower("_text"), c("_short"))).groupBy(*keys, "_short").agg(F.count("*").alias("_n"), F.min("_text").alias("_full")).filter("_n = 1").drop("_n")
    out = lines.withColumn("_short", F.lower("unit_text")).join(met, [*keys, "_short"], "left")
    return out.withColumn("unit_text", F.coalesce("_full", "unit_text")).drop("_short", "_full")


def infer_vat(lines: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """lines whose rate of 0 is filled with the one rate that the totals state. rates: (keys…, rate, labelled).

    Where totals state several rates, those beside a label count alone.
    """
    c = F.col
    known = rates.filter("rate <> 0").groupBy(*keys).agg(F.collect_set("rate").alias("_all"), F.collect_set(F.when(c("labelled"), c("rate"))).alias("_said"))
    one = F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).when(F.size("_said") == 1, F.get("_said", F.lit(0)))
    return lines.join(known.select(*keys, one.alias("_rate")), keys, "left").withColumn("vat", F.when(c("vat") == 0, F.coalesce("_rate", "vat")).otherwise(c("vat"))).drop("_rate")


def distribute_flags(flags: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """flags (keys…, code, line_no) with page and row: those of the line, else the document's first page (row null)."""
    c = F.col
    lines = rows.filter("no <> 0").select(*keys, c("no").alias("line_no"), "page", "row")
    first = rows.groupBy(*keys).agg(F.min("page").alias("_first"))
    met = flags.join(lines, [*keys, "line_no"], "left").join(first, keys, "left")
    return met.select(*keys, "code", "line_no", F.coalesce("page", "_first").alias("page"), "row")


def source_row(lines: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys…, ord, name) with row: the reading row of the same place if its name agrees, else the first of that name, else the place.

    rows: (keys…, row, name).
    """
    c = F.col
    same = rows.select(*keys, c("row").alias("ord"), c("name").alias("_there"))
    named = rows.groupBy(*keys, "name").agg(F.min("row").alias("_first"))
    met = lines.join(same, [*keys, "ord"], "left").join(named, [*keys, "name"], "left")
    return met.select(*lines.columns, F.when(c("_there") == c("name"), c("ord")).otherwise(F.coalesce("_first", "ord")).alias("row"))


def apply_discounts(lines: DataFrame) -> DataFrame:
    """lines with line_net after a discount in basis points, rounded half away from zero."""
    return lines.withColumn("line_net", (F.col("line_net") - round_div(wide(F.col("line_net")) * wide(F.col("discount")), 10_000)).cast("bigint"))


def add_charges(totals: DataFrame, charges: DataFrame, keys: list[str]) -> DataFrame:
    """totals per rate (keys…, vat, net) with charges (keys…, vat, amount) added and the tax rounded anew."""
    added = charges.groupBy(*keys, "vat").agg(F.sum("amount").alias("_more"))
    both = totals.join(added, [*keys, "vat"], "full_outer").na.fill(0, ["net", "_more"])
    net = (F.col("net") + F.col("_more")).cast("bigint")
    return both.select(*keys, "vat", net.alias("net"), round_div(wide(net) * wide(F.col("vat")), 10_000).alias("tax"))


def piece_weight_audit(first: DataFrame, second: DataFrame, overrides: DataFrame, low: int = 1, high: int = 5000, spread: int = 25) -> DataFrame:
    """(product_id, amount, unit, verdict) from two answers per product (product_id, amount, unit); overrides win.

    Verdicts: override, missing, range, unit, null, spread (beyond `spread` percent of the larger), agreed.
    """
    c = F.col
    both = first.select("product_id", c("amount").alias("a"), c("unit").alias("ua"), F.lit(True).alias("_a")).join(second.select("product_id", c("amount").alias("b"), c("unit").alias("ub"), F.lit(True).alias("_b")), "product_id", "full_outer")
    both = both.join(overrides.select("product_id", c("amount").alias("o"), c("unit").alias("uo")), "product_id", "left")
    out = lambda x: x.isNotNull() & ~x.between(low, high)
    far = F.abs(c("a") - c("b")) * 100 > F.greatest("a", "b") * spread
    verdict = (
        F.when(c("o").isNotNull(), "override").when(c("_a").isNull() | c("_b").isNull(), "missing").when(out(c("a")) | out(c("b")), "range")
        .when(c("a").isNull() != c("b").isNull(), "null").when(c("ua") != c("ub"), "unit").when(far, "spread").otherwise("agreed")
    )
    mean = round_div(wide(c("a") + c("b")), 2)
    told = both.withColumn("verdict", verdict)
    good = c("verdict") == "agreed"
    return told.select("product_id", F.coalesce("o", F.when(good, mean)).alias("amount"), F.coalesce("uo", F.when(good, c("ua"))).alias("unit"), "verdict")


def cluster_1d(points: DataFrame, keys: list[str], gap: float = 2.0) -> DataFrame:
    """points (keys…, at) with cluster: a new one where the distance to the point before is more than gap."""
    return ordered.clusters(points, keys, "at", gap)


#: The least width of a gutter between two printed pages, and how far from the middle it may lie, in sheet widths.
GUTTER, OFF_MIDDLE = 8.0, 0.125


def gutters(spans: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, middle): where a landscape sheet with two printed pages is divided. spans: (keys…, x0, x1); sheets: (keys…, width, height).

    The widest gap that no span reaches into, the first of equal ones, if it is wide enough and near the middle.
    """
    c = F.col
    before = Window.partitionBy(*keys).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("x1").over(before), F.lit(0.0))
    gaps = spans.withColumn("_reach", reach).filter("_reach > 0").select(*keys, (c("x0") - c("_reach")).alias("gap"), ((c("x0") + c("_reach")) / 2).alias("at"))
    best = gaps.filter("gap > 0").groupBy(*keys).agg(F.max(F.struct("gap", (-c("at")).alias("at"))).alias("b")).select(*keys, "b.gap", (-c("b.at")).alias("middle"))
    met = best.join(sheets.select(*keys, "width", "height"), keys)
    near = F.abs(c("middle") - c("width") / 2) < c("width") * OFF_MIDDLE
    return met.filter((c("width") > c("height")) & (c("gap") >= GUTTER) & near).select(*keys, "middle")


def split_halves(words: DataFrame, spans: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys…, x0, x1) with half: 0 left of the sheet's gutter by their middle, else 1; 0 on sheets that are one page."""
    middle = (F.col("x0") + F.col("x1")) / 2
    met = words.join(gutters(spans, sheets, keys), keys, "left")
    return met.withColumn("half", F.when(F.col("middle").isNotNull() & (middle >= F.col("middle")), 1).otherwise(0)).drop("middle")


def slot(points: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys…, pos) with slot: the first interval between neighbouring bounds (keys…, bound) that holds it, else -1."""
    c = F.col
    order = Window.partitionBy(*keys).orderBy("bound")
    spans = bounds.withColumns({"_to": F.lead("bound").over(order), "_n": F.row_number().over(order) - 1}).filter("_to IS NOT NULL AND _to > bound")
    lists = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", c("bound").alias("_from"), "_to"))).alias("_slots"))
    inside = F.filter("_slots", lambda s: (s["_from"] <= c("pos")) & (c("pos") < s["_to"]))
    return points.join(lists, keys, "left").withColumn("slot", F.coalesce(F.get(inside, F.lit(0))["_n"], F.lit(-1))).drop("_slots")
