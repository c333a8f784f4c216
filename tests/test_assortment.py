"""Suggestions against a plain loop."""

import random

from kontora.operators import assortment


def test_suggestions_take_from_what_is_left(spark):
    rng = random.Random(5)
    parts = [f"s{i}" for i in range(8)]
    cases = ["c1", "c2"]
    supply = [(c, p, rng.randrange(0, 4000), 1000, rng.randrange(1000, 90000)) for c in cases for p in parts]
    amounts = [(c, f"p{k:02}", p, rng.randrange(1, 60)) for c in cases for k in range(12) for p in rng.sample(parts, rng.randrange(1, 4))]
    amounts.append(("c1", "gone", "nowhere", 5))
    divisions = [(p, "a" if i % 2 else "b") for i, p in enumerate(parts)]
    markups, overall = [("c1", "a", 12000)], [("c1", 4000), ("c2", 0)]
    make = spark.createDataFrame
    got = assortment.suggest(
        make(amounts, "case_id string, product_id string, part_id string, amount long"), make(supply, "case_id string, part_id string, left long, used long, used_cost long"),
        make(divisions, "part_id string, division string"), make(markups, "case_id string, division string, markup long"), make(overall, "case_id string, markup long"),
    )
    want = set()
    for case in cases:
        left = {p: q for c, p, q, _, _ in supply if c == case}
        micro = {p: cost * 1_000_000 // used for c, p, _, used, cost in supply if c == case}
        needs = {}
        for c, k, p, a in amounts:
            if c == case:
                needs.setdefault(k, {})[p] = a
        needs = {k: n for k, n in needs.items() if set(n) <= set(left)}
        main = {k: max(n, key=lambda p: n[p] * micro[p]) for k, n in needs.items()}
        least = {}
        for k, p in main.items():
            least[p] = min(least.get(p, 10**9), needs[k][p])
        rate = lambda p: next((m for c, d, m in markups if c == case and d == dict(divisions)[p]), dict(overall)[case])  # noqa: B023, E731
        weight = {k: (1 + (len(n) - 1) / 2) * (least[main[k]] / n[main[k]]) ** 0.5 * (10000 + max(rate(main[k]), 0)) / 10000 for k, n in needs.items()}
        for place in range(1, 6):
            fit = {k: min(left[p] // a for p, a in n.items()) for k, n in needs.items() if k in weight}
            score = {k: x * sum(a * micro[p] for p, a in needs[k].items()) / 1_000_000 * weight[k] for k, x in fit.items() if x > 0}
            if not score:
                break
            best = min(score, key=lambda k: (-score[k], k))
            for p, a in needs[best].items():
                left[p] -= a * fit[best]
            del weight[best]
            want.add((case, best, place))
    assert {(r.case_id, r.product_id, r.place) for r in got.collect()} == want


def test_suggestions_of_a_bar(spark):
    """Sold portions are pinned in a second calculation; wares are offered as bought only if nothing is made of them."""
    from dataclasses import replace

    from kontora.plans.calculate import suggest_assortment
    from tests.test_calculation import PRODUCT, tables

    cases, rules = tables(spark)
    make, c = spark.createDataFrame, "case.bar.2024"
    ware = lambda i, cat, unit="H87": (i, i, unit, 1, cat, None, None, None, None)
    wares = [ware("soap", "cat.none"), ware("cigarettes", "cat.tobacco"), ware("tobacco", "cat.tobacco"), ware("cigar", None), ware("korn.1cl", None), ware("gone", None)]
    line = lambda n, i: (c, "inv.bar.1", n, n, "Getränke", "1", None, i, i, None, 10000, "H87", 5_000_000, 1000, 50_000, 1900, "map." + i)
    mapping = lambda i: ("map." + i, None, None, None, None, None, i, None, True, None, None)
    new = [(n + 10, i) for n, i in enumerate(("soap", "cigarettes", "tobacco"))]
    cases = replace(cases, lines=cases.lines.unionByName(make([line(n, i) for n, i in new], cases.lines.schema)))
    rules = replace(
        rules,
        products=rules.products.unionByName(make(wares, PRODUCT)),
        categories=rules.categories.unionByName(make([("cat.none", "none", "unbestimmt"), ("cat.tobacco", "tobacco", "handelsware")], rules.categories.schema)),
        recipes=rules.recipes.unionByName(make([("cigar", 1, "tobacco", 1, "H87"), ("korn.1cl", 1, "prod.korn", 10, "MLT"), ("gone", 1, "nowhere", 5, "MLT")], rules.recipes.schema)),
        mappings=rules.mappings.unionByName(make([mapping(i) for _, i in new], rules.mappings.schema)),
    )
    codes = make([("cat.fass", "56")], "category_id string, code string")
    none = make([], "case_id string, product_id string")
    got = [(r.product_id, r.place) for r in suggest_assortment(cases, rules, codes, none).orderBy("place").collect()]
    # ten packets and ten cigars at 500 each; what korn is left after the portions sold makes no centilitre of worth
    assert {p for p, _ in got} >= {"cigarettes", "cigar"} and not {p for p, _ in got} & {"soap", "tobacco", "gone"}
    assert [k for _, k in got] == list(range(1, len(got) + 1))
    assert got[0][0] in ("cigar", "cigarettes") and sorted(p for p, _ in got[:2]) == ["cigar", "cigarettes"]
    fewer = suggest_assortment(cases, rules, codes, make([(c, "cigar")], "case_id string, product_id string"))
    assert "cigar" not in {r.product_id for r in fewer.collect()}


def test_query_offers_what_only_the_second_calculation_stocks(sf):
    """Wares that nothing listed contains are in stock once they are offered, in the query's SQL as in the calculation."""
    import duckdb

    from kontora import registry, views

    con = duckdb.connect()
    for t in views.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = set(con.execute(registry.ORACLES["suggest_assortment"]).fetchall())
    reached = set(con.execute(registry.ORACLES["reachable"]).fetchall())
    assert {(c, p) for c, p, _ in got if p.startswith("prod.")} - reached and {place for _, _, place in got} == set(range(1, 6))


def test_query_hands_given_portions_to_the_calculation(spark, sf, monkeypatch):
    from kontora.plans import rule_queries

    monkeypatch.setattr(rule_queries, "suggest_assortment", lambda cases, rules, codes, dismissed: (cases, rules, codes, dismissed))
    cases, rules, codes, dismissed = rule_queries._suggest(rule_queries.Audit(spark, sf))
    menus = {(r.case_id, r.product_id) for r in cases.case_products.collect()}
    given = {(r.case_id, r.product_id): r.portions for r in cases.pinned.collect()}
    assert given and all(n > 0 and (c, p) in menus and (c, p.replace("sold.a", "sold.b")) in menus for (c, p), n in given.items())
    assert rules.products.count() > 0 and codes.count() > 0 and dismissed.count() > 0
