"""Column functions against small tables of values."""


from pyspark.sql import functions as F

from kontora.functions import numbers as n
from kontora.functions import text as t
from kontora.functions import units as u


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_division_rounds_as_money_does(spark):
    a, b = F.col("a"), F.col("b")
    rows = [(7, 2), (-7, 2), (7, -2), (5, 10), (-5, 10), (4, 10), (1, 0), (9223372036854775807, 1)]
    got = one(spark, "a long, b long", rows, n.trunc_div(a, b).cast("long"), n.round_div(a, b))
    assert got == [(3, 4), (-3, -4), (-3, -4), (0, 1), (0, -1), (0, 0), (None, None), (9223372036854775807, 9223372036854775807)]


def test_line_net_and_markup(spark):
    assert one(spark, "q long, p long, b long", [(12000, 92500000, 1000), (1000, 5000, 0), (None, 1, 1)], n.line_net(F.col("q"), F.col("p"), F.col("b"))) == [(111000,), (1,), (None,)]
    assert one(spark, "r long, c long", [(735335, 145391), (1, 0)], n.markup(F.col("r"), F.col("c"))) == [(40576,), (0,)]


def test_parse_scaled(spark):
    rows = [("1.5",), ("-0.07",), ("1.239",), ("12",), ("x",), ("",), (None,), (".5",), ("1.500",)]
    assert [r[0] for r in one(spark, "s string", rows, n.parse_scaled(F.col("s"), 2))] == [150, -7, None, 1200, None, None, None, 50, 150]
    assert [r[0] for r in one(spark, "s string", [("1.235",), ("-1.235",)], n.parse_scaled(F.col("s"), 2, rounding=True))] == [124, -124]


def test_gcd(spark):
    assert one(spark, "a long, b long", [(12, 18), (0, 5), (7, 0), (9223372036854775806, 4)], n.gcd(F.col("a"), F.col("b"))) == [(6,), (5,), (7,), (2,)]


PACKS = [
    ("Kiste Pils 20 x 0,5 l", (20, 500, "ml")), ("Cola PET 24x0,33", (24, 330, None)), ("Pils Fass 50 l", (1, 50000, "ml")), ("6er 0,5 l Bier", (6, 500, "ml")),
    ("Mehl 20 Stk", (20, 1000, "piece")), ("0,7 l 12 Stk", (12, 700, "ml")), ("Mehl Type 550", None), ("Karton 5 kg", (1, 5000, "g")), ("2001 x 1 l", None), (None, None),
]
FACTORS = [
    ("ml", None, "XCS", "24 x 0,33 l", None, 1000, (7920, 1, "pack", 7920)), ("g", None, "KGM", "x", None, 2000, (0, 1, "table", 2000)), ("ml", None, "XKG", "x", 50000, 12000, (50000, 1, "manual", 600000)),
    ("piece", (400, "g"), "KGM", "Gurke", None, 1000, (1000, 400, "piece", 3)), ("piece", (400, "g"), "KGM", "Gurke", None, -2500, (1000, 400, "piece", -6)), ("piece", None, "XCS", "6 x 0,33 l", None, 1000, None),
    ("g", (150, "g"), "H87", "Zwiebel", None, 2000, (150, 1, "piece", 300)), ("g", (150, "g"), "XCT", "20 Stk", None, 1000, (3000, 1, "piece", 3000)), (None, None, "KGM", "x", 5, 1000, None),
]


def test_pack_size(spark):
    got = {r.s: r.p for r in spark.createDataFrame([(s,) for s, _ in PACKS], "s string").select("s", u.pack_size(F.col("s")).alias("p")).collect()}
    assert {s: None if p is None else (p["count"], p["size"], p["base"]) for s, p in got.items()} == dict(PACKS)


def test_factor(spark):
    rows = [(i, *f[:6]) for i, f in enumerate(FACTORS)]
    df = spark.createDataFrame(rows, "i int, c string, p struct<amount:long,unit:string>, u string, n string, m long, q long").withColumn("pack", u.pack_size(F.col("n")))
    df = df.withColumn("f", u.factor(F.col("c"), F.col("p"), F.col("u"), F.col("pack"), F.col("m"))).withColumn("out", u.converted_quantity(F.col("q"), F.col("u"), F.col("f")))
    got = {r.i: None if r.f is None else (r.f.factor, r.f.per, r.f.source, r.out) for r in df.collect()}
    assert got == {i: f[6] for i, f in enumerate(FACTORS)}


def test_text_keys(spark):
    c = F.col("s")
    got = one(spark, "s string", [("  Pils, 0,5 L! GmbH",), (None,)], t.canonical_name(c), t.supplier_key(c))
    assert got == [("pils, 0,5 l gmbh", "pils05lgmbh"), ("", None)]
    assert one(spark, "s string", [("ÄPFEL groß",)], t.fold_german(c)) == [("aepfelgross",)]
    assert one(spark, "s string", [("WEIN-GUT SOMMER",), ("Wein",)], t.title_if_upper(c)) == [("Wein-Gut Sommer",), ("Wein",)]
    assert one(spark, "s string", [("a.b",), ("a..b",), ("",)], t.valid_id(c)) == [(True,), (False,), (False,)]


def test_units(spark):
    c = F.col("s")
    got = one(spark, "s string", [(" kg. ",), ("XCS",), ("Flaschen",), ("?",), (None,)], u.unit(c)["code"], u.base_unit(c))
    assert got == [("KGM", "g"), ("XCS", None), ("XBO", None), (None, None), (None, None)]


def test_names_and_labels(spark):
    from kontora.functions import reading

    df = spark.createDataFrame([(["Pils 0,5", "pils", "Korn"], [0.0, 2.0, 1.0]), (["a", "A"], [5.0])], "p array<string>, l array<double>")
    got = df.select(reading.undouble_name(F.col("p")).alias("n"), reading.label_conf(F.col("l")).alias("c")).collect()
    assert [(r.n, r.c.label, r.c.conf) for r in got] == [("Pils 0,5 Korn", 1, 0.665), ("a", 0, 1.0)]
