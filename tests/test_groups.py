"""Spellings of suppliers: all that meet in chunks, compared with plain Python."""

import pytest

from kontora.operators import groups


def near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    short = min(len(a), len(b))
    return (len(a) >= 4 and len(b) > len(a) and a in b) or (short >= 6 and row[-1] <= short // 6)


@pytest.mark.parametrize("words", [1, 64])
def test_spellings_that_differ_in_digits_meet_in_chunks(spark, words):
    """F8, F9: few masks leave items to the lists of partners; the best partner is found without ranking the others."""
    sold = [(f"c{s % 2}", f"Mustermann & Co #{s * 37:06}", str((s * s + 3 * i) % 150), f"ware {(s + i) % 90}") for s in range(60) for i in range(1 + s % 9)]
    lines = spark.createDataFrame([(c, f"inv.{k}", k, s, a, None, n) for k, (c, s, a, n) in enumerate(sold)], "case_id string, invoice_id string, ord int, supplier_name string, seller_article_id string, gtin string, name string").repartition(3)
    held = {}
    for c, s, a, n in sold:
        held.setdefault((c, "".join(x for x in s.lower() if x.isalnum())), set()).update((f"a:{a}", f"n:{n}"))
    want = {(c, a, b, len(held[c, a] & held[d, b])) for c, a in held for d, b in held if c == d and a != b and near(a, b) and held[c, a] & held[d, b]}
    assert groups._alike(lines.selectExpr("regexp_replace(lower(supplier_name), '[^a-z0-9]', '') as k").distinct()) and len(want) > 100
    got = groups.supplier_pairs(lines, chunk=7, words=words).collect()
    assert {(r.case_id, r.a, r.b, r.shared) for r in got} == want and len(got) == len(want)
    order = {}
    for c, a, b, n in sorted(want, key=lambda w: (w[0], w[1], -w[3], w[2])):
        order.setdefault((c, a), []).append(b)
    assert all(order[r.case_id, r.a][r.rank - 1] == r.b for r in got)
    best = groups.best_partners(lines, chunk=7, words=words).collect()
    assert {(r.case_id, r.a): r.b for r in best} == {k: v[0] for k, v in order.items()} and len(best) == len(order)


@pytest.mark.parametrize("name", ["verify_invoices", "confirm_invoices", "auto_map"])
def test_lines_are_written_once(spark, sf, name):
    """lines are put together once, with the columns that are read."""
    from kontora import registry

    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "price_base_qty" not in plan if name == "auto_map" else "l_orderkey" not in plan and "seller_article_id" not in plan
