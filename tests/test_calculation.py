"""The golden bar case, and the accounting identities on the driver's tables."""

import datetime as dt

import pytest

from kontora.plans.calculate import Cases, Rules, calculate

D = dt.date
PRODUCT = "product_id string, name string, unit string, batch long, category_id string, piece_amount long, piece_unit string, valid_from date, valid_to date"


def tables(spark):
    c = "case.bar.2024"
    make = spark.createDataFrame
    product = lambda i, unit="H87", cat=None: (i, i, unit, 1, cat, None, None, None, None)
    wares = [product("prod.bier.fass", "MLT", "cat.fass"), product("prod.bier.flasche", "MLT", "cat.flasche"), product("prod.korn", "MLT", "cat.spirituosen")]
    sold = [("pils.03", 320, "prod.bier.fass", 300), ("pils.05", 450, "prod.bier.fass", 500), ("pils.flasche", 350, "prod.bier.flasche", 330), ("korn.2cl", 180, "prod.korn", 20), ("korn.4cl", 320, "prod.korn", 40)]
    lines = [
        (1, "Pils Fass 50 l", "31090", 12000, "XKG", 92500000, 111000, "map.fass50"),
        (2, "Pils 24 x 0,33 l Kiste", "31210", 30000, "XCS", 13200000, 39600, "map.kiste24x033"),
        (3, "Doppelkorn 0,7 l 38% vol", "55120", 20000, "XBO", 9200000, 18400, "map.korn07"),
    ]
    mapping = lambda i, p, f, u: (i, None, None, None, None, u, p, f, True, None, None)
    return Cases(
        cases=make([(c, "Bar", D(2024, 1, 1), D(2024, 12, 31), "")], "case_id string, label string, period_from date, period_to date, gewerbe string"),
        lines=make([(c, "inv.bar.1", n, n, "Getränke", "1", D(2024, 3, 15), name, art, None, q, u, p, 1000, net, 1900, m) for n, name, art, q, u, p, net, m in lines],
                   "case_id string, invoice_id string, ord long, no long, supplier_name string, number string, date date, name string, seller_article_id string, gtin string, quantity long, unit_code string, unit_price long, price_base_qty long, line_net long, vat long, mapping_id string"),
        case_products=make([(c, p, k, g, 1900) for k, (p, g, _, _) in enumerate(sold)], "case_id string, product_id string, ord long, gross_price long, vat long"),
        inventory=make([(c, "prod.bier.fass", 1, 50000, 100000, "MLT"), (c, "prod.bier.flasche", 2, 0, 39600, "MLT"), (c, "prod.korn", 3, 1400, 2800, "MLT")], "case_id string, product_id string, ord long, opening long, closing long, unit string"),
        no_revenue=make([], "case_id string, product_id string"),
        yield_choices=make([], "case_id string, ord long, product_id string, category_id string, rule_id string"),
        pinned=make([], "case_id string, product_id string, portions long"),
        declared=make([(c, 1900, 500000)], "case_id string, vat long, net long"),
    ), Rules(
        products=make(wares + [product(p) for p, *_ in sold], PRODUCT),
        categories=make([("cat.fass", "Fass", "getraenke"), ("cat.flasche", "Flasche", "getraenke"), ("cat.spirituosen", "Spirituosen", "getraenke")], "category_id string, name string, division string"),
        recipes=make([(p, 1, part, a, "MLT") for p, _, part, a in sold], "product_id string, ord long, part_id string, amount long, unit string"),
        mappings=make([mapping("map.fass50", "prod.bier.fass", 50000, "XKG"), mapping("map.kiste24x033", "prod.bier.flasche", 7920, "XCS"), mapping("map.korn07", "prod.korn", 700, "XBO")],
                      "mapping_id string, supplier_name string, seller_article_id string, gtin string, name string, unit_code string, product_id string, factor long, confirmed boolean, valid_from date, valid_to date"),
        yield_rules=make([("y.fass", "cat.fass", None, 500, True), ("y.flasche", "cat.flasche", None, 100, True), ("y.sp", "cat.spirituosen", None, 300, True)], "rule_id string, category_id string, product_id string, deduction long, is_default boolean"),
    )


@pytest.fixture(scope="module")
def report(spark):
    return calculate(*tables(spark))


def test_stock(report):
    got = {r.product_id: (r.bought, r.used, r.used_cost, r.sellable) for r in report.stock.collect()}
    assert got == {"prod.bier.fass": (600000, 550000, 101750, 522500), "prod.bier.flasche": (237600, 198000, 33000, 196020), "prod.korn": (14000, 12600, 16560, 12222)}


def test_portions(report):
    got = {r.node: r.n for r in report.allocation.filter("kind = 'column'").collect()}
    assert got == {"pils.03": 1740, "pils.05": 1, "pils.flasche": 594, "korn.2cl": 611, "korn.4cl": 0}


def test_totals(report):
    t = report.totals.first()
    want = {"purchases": 169000, "cost_of_goods": 151310, "stock_change": 17690, "revenue": 735335, "markup": 40576, "shrinkage_cost": 5915, "unallocated_cost": 4, "allocated_cost": 145391, "portions": 2946}
    assert {k: t[k] for k in want} == want


def test_identities(report):
    t = report.totals.first()
    assert t.purchases == t.cost_of_goods + t.stock_change


def test_vat_rows(report):
    rows = [(r.vat, r.declared, r.calculated, r.total) for r in report.vat.orderBy("place").collect()]
    assert rows[0] == (1900, 500000, rows[0][2], False) and rows[-1][3] and rows[-1][2] >= 735335


def test_two_ways_to_a_dish(spark):
    """Bought fries and made ones: 40 dishes with the bought, 60 with those from potatoes."""
    from kontora.operators import allocation

    make = spark.createDataFrame
    wares = [("pork", "GRM"), ("potato", "GRM"), ("oil", "MLT"), ("schnitzel", "H87"), ("fries", "H87"), ("dish", "H87")]
    products = make([(p, p, u, 1, None, None, None, None, None) for p, u in wares], PRODUCT)
    lines = [("schnitzel", 1, "pork", 180, "GRM"), ("fries", 1, "potato", 250, "GRM"), ("fries", 2, "oil", 20, "MLT"), ("dish", 1, "schnitzel", 1, "H87"), ("dish", 2, "fries", 1, "H87")]
    recipes = make(lines, "product_id string, ord long, part_id string, amount long, unit string")
    # base amounts: grams, millilitres, pieces
    amounts = {"pork": (18000, 18000), "potato": (15000, 1500), "oil": (2000, 600), "fries": (40, 2000)}
    stock = make([("c", p, q, cost, q) for p, (q, cost) in amounts.items()], "case_id string, product_id string, bought long, cost long, sellable long")
    sold = make([("c", "dish")], "case_id string, product_id string")
    none = make([], "product_id string, part_id string, amount long")
    ways = allocation.routes(sold, recipes, products, stock, none)
    got = {}
    for r in ways.collect():
        got.setdefault(r.route, {})[r.part_id] = r.amount
    assert set(got[0]) == {"pork", "fries"} and set(got[1]) == {"pork", "potato", "oil"}
    taken = allocation.allocate(ways, stock, make([], "case_id string, product_id string, portions long"))
    portions = {r.route: r.n for r in taken.filter("kind = 'column'").collect()}
    assert portions == {0: 40, 1: 60}
    pins = make([("c", "dish", 70)], "case_id string, product_id string, portions long")
    fixed = {r.route: (r.n, r.flag) for r in allocation.allocate(ways, stock, pins).filter("kind = 'column'").collect()}
    assert fixed == {0: (40, True), 1: (30, True)}


def test_ranked_choices():
    import itertools

    from kontora.operators.allocation import ranked_choices

    for sizes, room in (([2, 3], 6), ([3, 3, 3, 3], 64), ([2] * 7, 63), ([5, 9, 4], 20), ([64, 64], 64), ([1, 70], 64)):
        got, cut = ranked_choices(sizes, room)
        every = list(itertools.product(*map(range, sizes)))
        rows = [tuple(x) for x in got.tolist()]
        assert cut == (len(every) > room) and len(set(rows)) == len(rows) == min(room, len(every))
        assert rows[0] == every[0] and rows[-1] == every[-1]
        if cut:
            first, last = every[0], every[-1]
            differs = lambda way, end: [x for i, (a, b) in enumerate(zip(way, end, strict=True)) if a != b for x in (i, a)]
            rank = {w: min((len(differs(w, e)), side, differs(w, e)) for side, e in enumerate((first, last))) for w in every}  # noqa: B023
            assert rows[1:-1] == sorted((w for w in every if w not in (first, last)), key=rank.get)[: room - 2]


def test_packing_is_best():
    import itertools
    import random

    import numpy as np

    from kontora.operators.allocation import _best_counts

    rng = random.Random(1)
    for _ in range(40):
        room = np.array([rng.randrange(1, 12) for _ in range(rng.randrange(1, 3))])
        weights = np.array([[rng.randrange(0, 4) for _ in room] for _ in range(rng.randrange(1, 4))])
        weights[(weights == 0).all(axis=1)] = 1
        value = [rng.randrange(1, 20) for _ in weights]
        bound = [rng.choice([None, 2, 5]) for _ in weights]
        counts = _best_counts(room, weights, bound, value)
        fits = lambda c: (np.array(c) @ weights <= room).all() and all(b is None or x <= b for x, b in zip(c, bound, strict=True))  # noqa: E731, B023
        assert fits(counts.tolist())
        best = max(sum(x * v for x, v in zip(c, value, strict=True)) for c in itertools.product(range(13), repeat=len(value)) if fits(c))
        assert sum(x * v for x, v in zip(counts.tolist(), value, strict=True)) == best


def test_calculation_over_tables_writes_the_columns_it_needs(spark, sf, monkeypatch):
    """Routed lines are written without what no list of the report is made of."""
    from kontora.operators import stock
    from kontora.plans import audit_queries, calculate

    wrote = {}
    real = audit_queries.stored
    monkeypatch.setattr(audit_queries, "stored", lambda df, what: wrote.setdefault(what, df.columns) and real(df, what))
    audit_queries.Audit(spark, sf).balance()
    assert "routed" not in wrote  # read once
    audit_queries.Audit(spark, sf).routed(kept=stock.BALANCED)
    assert tuple(wrote["routed"]) == stock.BALANCED and set(calculate.REPORTED) >= set(stock.BALANCED)


def test_supply_is_worked_out_once(spark, sf, monkeypatch):
    """Supply rows and suggestions take what is left from the stock that they have."""
    from kontora.plans import rule_queries
    from kontora.plans.audit_queries import Audit

    calls, real = [], Audit.sellable
    monkeypatch.setattr(Audit, "sellable", lambda a: calls.append(1) or real(a))
    rule_queries._supply(Audit(spark, sf))
    assert len(calls) == 1
