"""Keeping rules and cases: changes as new rows of a log, differences, three-way amendments and what they refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import base_unit
from .matching import valid_on


def rules_date(*tables: DataFrame) -> DataFrame:
    """(changed_at): the last change of any entry."""
    out = tables[0].select("changed_at")
    for t in tables[1:]:
        out = out.unionByName(t.select("changed_at"))
    return out.agg(F.max("changed_at").alias("changed_at"))


def change_conflicts(put: DataFrame, delete: DataFrame) -> DataFrame:
    """(kind, id, why): entries of a change that refuse it: written and deleted at once, or a mapping nobody confirmed."""
    both = put.select("kind", "id").join(delete.select("kind", "id"), ["kind", "id"], "left_semi").withColumn("why", F.lit("put and delete"))
    open_ = put.filter("kind = 'mapping' and not confirmed").select("kind", "id").withColumn("why", F.lit("unconfirmed"))
    return both.unionByName(open_).distinct()


def change_rules(log: DataFrame, put: DataFrame, delete: DataFrame, now: int, by: str) -> DataFrame:
    """The rows that a change adds to the log, all or none; nothing where change_conflicts has rows.

    log: (kind, id, rev, content, confirmed, changed_by, deleted_at). The revision is one more than the last, or the time
    in milliseconds if that is more. A deleted entry keeps its content and revision and gets deleted_at.
    """
    c = F.col
    bad = change_conflicts(put, delete).agg(F.count("*").alias("bad"))  # one row
    last = log.agg(F.greatest(F.coalesce(F.max("rev"), F.lit(0)) + 1, F.lit(now)).cast("bigint").alias("version"))  # one row
    none = F.lit(None).cast("bigint")
    written = put.select("kind", "id", "content", "confirmed").crossJoin(F.broadcast(last)).select("kind", "id", c("version").alias("rev"), "content", "confirmed", F.lit(by).alias("changed_by"), none.alias("deleted_at"))
    newest = F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("rev"), c("deleted_at").isNotNull().desc()))
    current = log.withColumn("_n", newest).filter("_n = 1 and deleted_at is null").drop("_n")
    gone = current.join(delete.select("kind", "id").distinct(), ["kind", "id"]).select("kind", "id", "rev", "content", "confirmed", F.lit(by).alias("changed_by"), F.lit(now).cast("bigint").alias("deleted_at"))
    return written.unionByName(gone).crossJoin(F.broadcast(bad)).filter("bad = 0").drop("bad")


def rescale_guard(before: DataFrame, after: DataFrame, mappings: DataFrame, recipes: DataFrame, written: DataFrame) -> DataFrame:
    """(product_id, user): what still counts in the old unit of products whose unit changed and was not written with it.

    written: (id) of all entries of the change. Users are mapping ids and products whose recipe holds the product.
    """
    c = F.col
    ids = written.select(c("id").alias("user"))
    changed = before.select("product_id", c("unit").alias("was")).join(after.select("product_id", "unit"), "product_id").filter("was <> unit")
    changed = changed.join(written.select(c("id").alias("product_id")), "product_id", "left_semi").select("product_id")
    by_mapping = mappings.select("product_id", c("mapping_id").alias("user"))
    by_recipe = recipes.filter("part_id <> product_id").select(c("part_id").alias("product_id"), c("product_id").alias("user"))
    return changed.join(by_mapping.unionByName(by_recipe), "product_id").join(ids, "user", "left_anti").select("product_id", "user").distinct()


def seed_rules(store: DataFrame, seed: DataFrame, key: str, follow: list[str], fill: list[str]) -> DataFrame:
    """store after a delivery of seed rows: missing ids come in (deleted ones stay deleted), untouched rows follow.

    store has rev and deleted_at. Rows of revision 0 take the columns of `follow` from the seed; columns of `fill` are
    taken where they are null.
    """
    c = F.col
    s = seed.select(c(key).alias("_key"), *[c(x).alias(f"_s_{x}") for x in {*follow, *fill}])
    met = store.join(s, c(key) == c("_key"), "left")
    untouched = (c("rev") == 0) & c("deleted_at").isNull() & c("_key").isNotNull()
    new = {x: F.when(untouched, c(f"_s_{x}")).otherwise(c(x)) for x in follow}
    new |= {x: F.when(c("_key").isNotNull(), F.coalesce(c(x), c(f"_s_{x}"))).otherwise(c(x)) for x in fill}
    kept = met.withColumns(new).select(*store.columns)
    missing = seed.join(store.select(key), key, "left_anti").withColumns({"rev": F.lit(0).cast("bigint"), "deleted_at": F.lit(None).cast(store.schema["deleted_at"].dataType)})
    return kept.unionByName(missing.select(*store.columns))


def diff_parts(was: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """(key…, before, after): entries that differ, as JSON of all other columns; null where there is no entry."""
    rest = [x for x in was.columns if x not in key]
    content = lambda df, name: df.select(*key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(name))
    both = content(was, "before").join(content(now, "after"), key, "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def apply_parts(state: DataFrame, diff: DataFrame, key: list[str]) -> DataFrame:
    """state with the entries of a difference as they are after it."""
    rest = [x for x in state.columns if x not in key]
    schema = ", ".join(f"`{x}` {state.schema[x].dataType.simpleString()}" for x in rest)
    put = diff.filter("after is not null").select(*key, F.from_json("after", schema).alias("_e")).select(*key, *[F.col(f"_e.{x}").alias(x) for x in rest])
    return state.join(diff.select(*key), key, "left_anti").unionByName(put.select(*state.columns))


def compose_diffs(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two differences in a row as one: the first's before, the second's after; entries that come back drop out."""
    c = F.col
    a = first.select(*key, c("before").alias("b1"), c("after").alias("a1"), F.lit(True).alias("_one"))
    b = second.select(*key, c("before").alias("b2"), c("after").alias("a2"), F.lit(True).alias("_two"))
    both = a.join(b, key, "full_outer")
    before = F.when(c("_one"), c("b1")).otherwise(c("b2"))
    after = F.when(c("_two"), c("a2")).otherwise(c("a1"))
    return both.select(*key, before.alias("before"), after.alias("after")).filter(~c("before").eqNullSafe(c("after")))


def amend(stored_lines: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
    """stored lines with the mapping that a long operation found, where nothing changed the line since it was loaded.

    All three: (case_id, invoice_id, ord, supplier_name, date, name, …, mapping_id). Lines stored meanwhile stay as they
    are; amended tells which took the new mapping.
    """
    c = F.col
    key = ["case_id", "invoice_id", "ord"]
    rest = [x for x in was.columns if x not in (*key, "mapping_id")]
    as_one = lambda df, name: df.select(*key, F.struct(*rest).alias(f"_{name}"), c("mapping_id").alias(f"_{name}_id"))
    asked = as_one(was, "was").join(as_one(now, "now"), key)
    met = stored_lines.join(asked, key, "left")
    changed = ~c("_was_id").eqNullSafe(c("_now_id")) & c("_was").isNotNull()
    same = F.struct(*rest).eqNullSafe(c("_now")) & c("mapping_id").eqNullSafe(c("_was_id"))
    take = F.coalesce(changed & same, F.lit(False))
    return met.withColumn("_take", take).select(*key, *rest, F.when(c("_take"), c("_now_id")).otherwise(c("mapping_id")).alias("mapping_id"), c("_take").alias("amended"))


def only_asked(stored_lines: DataFrame, asked: DataFrame) -> DataFrame:
    """(case_id, mapped): whether every line that is still open was among those asked about, unchanged."""
    key = [x for x in asked.columns if x != "mapping_id"]
    blank = F.coalesce("mapping_id", F.lit("")) == ""
    told = asked.filter(blank).select(*key).distinct().withColumn("_asked", F.lit(True))
    same = None
    open_ = stored_lines.filter(blank)
    for x in key:
        test = open_[x].eqNullSafe(told[x])
        same = test if same is None else same & test
    left = open_.join(told, same, "left_anti").select(open_["case_id"]).distinct().withColumn("_left", F.lit(True))
    return stored_lines.select("case_id").distinct().join(left, "case_id", "left").select("case_id", F.col("_left").isNull().alias("mapped"))


def purge(invoices: DataFrame, lines: DataFrame, documents: DataFrame, own_mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents of invoices that are there, and own mappings that a line still names."""
    kept = documents.join(invoices.select("case_id", "invoice_id"), ["case_id", "invoice_id"], "left_semi")
    named = lines.filter("mapping_id is not null").select("case_id", "mapping_id")
    return kept, own_mappings.join(named, ["case_id", "mapping_id"], "left_semi")


def recipe_basis(products: DataFrame, recipes: DataFrame) -> DataFrame:
    """(product_id, basis): a number that changes with the batch or any line of a recipe: eight bytes of SHA-256."""
    line = F.concat_ws("\t", "part_id", F.col("amount").cast("string"), "unit")
    text = recipes.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: F.concat(x.line, F.lit("\n"))), "").alias("text"))
    both = products.select("product_id", "batch").join(text, "product_id")
    hexed = F.sha2(F.concat(F.col("batch").cast("string"), F.lit("\n"), F.col("text")).cast("binary"), 256)
    turned = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.substring(hexed, 2 * i + 1, F.lit(2))), "")
    return both.select("product_id", F.conv(turned, 16, -10).cast("bigint").alias("basis"))


def stale_recipes(own: DataFrame, basis: DataFrame) -> DataFrame:
    """(case_id, product_id) of a case's own recipes whose catalogue recipe changed since. own: (case_id, product_id, recipe_basis)."""
    met = own.join(basis, "product_id")
    return met.filter(~F.col("basis").eqNullSafe(F.col("recipe_basis"))).select("case_id", "product_id").distinct()


def needs_mapping(cases: DataFrame, store: str, version: Column) -> DataFrame:
    """cases mapped against another rule store or version, or never. cases: (case_id, mapped_store, mapped_at)."""
    same = F.col("mapped_store").eqNullSafe(F.lit(store)) & (F.col("mapped_at") == version)
    return cases.filter(~F.coalesce(same, F.lit(False))).select("case_id")


def placed(stored_: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with ord, its place among the stored invoices of its case: a known one's own, new ones come at the end, by id."""
    c = F.col
    key = ["case_id", "invoice_id"]
    place = stored_.select(*key, c("ord").alias("_place"))
    last = stored_.groupBy("case_id").agg(F.max("ord").alias("_last"))
    met = incoming.drop("ord").join(place, key, "left").join(last, "case_id", "left")
    fresh = F.row_number().over(Window.partitionBy("case_id", c("_place").isNull()).orderBy("invoice_id")) - 1
    return met.withColumn("ord", F.coalesce("_place", F.coalesce(c("_last") + 1, F.lit(0)) + fresh).cast("bigint")).drop("_place", "_last")


def upsert_invoices(stored_: DataFrame, incoming: DataFrame) -> DataFrame:
    """Invoices of cases after new ones came: a replaced one keeps its place, new ones come at the end, by id."""
    new = placed(stored_, incoming)
    return stored_.join(incoming.select("case_id", "invoice_id"), ["case_id", "invoice_id"], "left_anti").unionByName(new.select(*stored_.columns))


def unseat_default(rows: DataFrame, target: list[str]) -> DataFrame:
    """rows where of several defaults of one target only the one of the highest revision stays one."""
    newest = F.row_number().over(Window.partitionBy(*target, "is_default").orderBy(F.desc("rev"), "rule_id"))
    return rows.withColumn("is_default", F.col("is_default") & (newest == 1))


def yield_options(touched: DataFrame, products: DataFrame, rules: DataFrame, choices: DataFrame) -> DataFrame:
    """(case_id, target, rule_id, deduction, chosen): the yield rules that a case can choose from, and those that hold.

    touched: (case_id, product_id) of the stocks. Targets are products with rules of their own and categories; chosen is
    the case's choice for the target (its last), else the default.
    """
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    target = F.when(~blank("product_id"), F.concat(F.lit("p:"), "product_id")).otherwise(F.concat(F.lit("c:"), "category_id"))
    known = rules.select(target.alias("target"), "rule_id", "deduction", "is_default")
    mine = touched.join(products.select("product_id", "category_id"), "product_id")
    targets = mine.select("case_id", F.explode(F.array_compact(F.array(F.concat(F.lit("p:"), "product_id"), F.concat(F.lit("c:"), "category_id")))).alias("target")).distinct()
    last = choices.select("case_id", "ord", target.alias("target"), "rule_id").groupBy("case_id", "target").agg(F.max_by(F.struct(c("rule_id").alias("picked")), "ord").alias("choice"))
    met = targets.join(known, "target").join(last, ["case_id", "target"], "left")
    chosen = F.when(c("choice").isNotNull(), c("choice.picked").eqNullSafe(c("rule_id"))).otherwise(c("is_default"))
    return met.select("case_id", "target", "rule_id", "deduction", F.coalesce(chosen, F.lit(False)).alias("chosen"))


def promote_mapping(own: DataFrame, mappings: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A case's confirmed choices as rules: mappings replaced under the same id, and piece weights learned from factors.

    own: (mapping_id, product_id, factor, unit_code, …) as mappings. The factor of a mapping by the piece, without a
    package, becomes the weight of a piece of its product where that has none.
    """
    c = F.col
    rules = mappings.join(own.select("mapping_id"), "mapping_id", "left_anti").unionByName(own.withColumn("confirmed", F.lit(True)).select(*mappings.columns))
    by_piece = own.filter((F.upper("unit_code") == "H87") & (c("factor") > 0)).groupBy("product_id").agg(F.min("factor").alias("_weight"))
    counted = base_unit(c("unit"))
    met = products.join(by_piece, "product_id", "left")
    learn = c("_weight").isNotNull() & c("piece_amount").isNull() & counted.isin("g", "ml")
    weighed = met.withColumns({"piece_amount": F.when(learn, c("_weight")).otherwise(c("piece_amount")), "piece_unit": F.when(learn, counted).otherwise(c("piece_unit"))})
    return rules, weighed.select(*products.columns)


def drop_promoted_recipes(own: DataFrame, recipes: DataFrame) -> DataFrame:
    """own recipe lines of cases without recipes that equal the catalogue's line for line."""
    lines = lambda df, by, name: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part_id", "amount", "unit"))), lambda x: F.struct(x.part_id, x.amount, x.unit)).alias(name))
    both = lines(own, ["case_id", "product_id"], "mine").join(lines(recipes, ["product_id"], "theirs"), "product_id").filter("mine = theirs")
    return own.join(both.select("case_id", "product_id"), ["case_id", "product_id"], "left_anti")


def users_of(products: DataFrame, recipes: DataFrame, mappings: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, id, user): entries that would point nowhere if a category or product were deleted."""
    c = F.col
    of = lambda df, kind, id_, user: df.filter(c(id_).isNotNull()).select(F.lit(kind).alias("kind"), c(id_).alias("id"), user.alias("user"))
    named = lambda what, x: F.concat(F.lit(what + " "), c(x))
    parts = [
        of(products, "category", "category_id", named("product", "product_id")), of(rules, "category", "category_id", named("yield", "rule_id")),
        of(mappings, "product", "product_id", named("mapping", "mapping_id")), of(recipes.filter("part_id <> product_id"), "product", "part_id", named("product", "product_id")),
        of(rules, "product", "product_id", named("yield", "rule_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def verified_only(invoices: DataFrame) -> DataFrame:
    """Invoices that somebody looked at, or that the check accepted."""
    return invoices.filter("verified_at is not null")


def period_filter(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows whose date lies in their case's period, both ends included; rows without a date stay."""
    met = rows.join(cases.select("case_id", "period_from", "period_to"), "case_id")
    inside = F.col("date").isNull() | F.col("date").between(F.col("period_from"), F.col("period_to"))
    return met.filter(inside).select(*rows.columns)


def valid_products(products: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, product_id) of products valid at the end of the case's period."""
    both = cases.select("case_id", "period_to").crossJoin(products.select("product_id", "valid_from", "valid_to"))
    return both.filter(valid_on(F.col("valid_from"), F.col("valid_to"), F.col("period_to"))).select("case_id", "product_id")
