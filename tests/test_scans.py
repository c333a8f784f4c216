"""Invoices read from tagged words: many small sheets, each a document of one frame."""

import pytest
from pyspark.sql import functions as F

from kontora.operators import scans

HEAD = ("column-header", [(50, "Pos"), (100, "Menge"), (200, "Einheit"), (300, "Bezeichnung"), (700, "Einzelpreis"), (900, "Gesamt")])
WORDS = "doc string, page int, ord long, text string, x long, y long, w long, h long, row int, role string, field string, col int, cell_start boolean, conf float"


def item(*cells):
    return ("line-item", list(cells))


def words(doc, *sheets):
    """Rows of (role, [(x, text[, field[, conf]])]): a cell for each text, its words ten pixels a letter, rows of 30 pixels."""
    out = []
    for page, rows in enumerate(sheets):
        for r, (role, cells) in enumerate(rows):
            for k, (x, text, *more) in enumerate(cells):
                field, conf = (more + [None, 0.9])[:2] if len(more) < 2 else more
                for i, w in enumerate(text.split(" ")):
                    out.append((doc, page, len(out), w, x, 30 * r, 10 * len(w) - 2, 20, r, role, field, k, i == 0, conf))
                    x += 10 * (len(w) + 1)
    return out


SHEETS = {
    "headed": [[HEAD, item((50, "1"), (100, "2"), (200, "kg"), (300, "Birnen gelb"), (700, "2,50"), (900, "5,00")), item((50, "2"), (100, "12"), (200, "Stk"), (300, "Brezel"), (700, "0,50"), (900, "6,00"))]],
    "swapped": [[item((50, "1"), (100, "2"), (200, "kg"), (300, "Birnen gelb"), (700, "5,00"), (900, "2,50")), item((50, "2"), (100, "12"), (200, "Stk"), (300, "Brezel"), (700, "6,00"), (900, "0,50"))]],
    "counting": [[item((100, "1"), (300, "Birnen"), (700, "2,50"), (900, "2,50")), item((100, "2"), (300, "Brezel"), (700, "0,50"), (900, "1,00")), item((100, "3"), (300, "Lauch"), (700, "0,80"), (900, "2,40"))]],
    "position": [[item((50, "1"), (100, "2"), (300, "Birnen"), (700, "2,50"), (900, "5,00")), item((50, "2"), (100, "4"), (300, "Brezel"), (700, "0,50"), (900, "2,00"))]],
    "no sum": [[item((100, "2"), (300, "Birnen"), (700, "3,00"), (900, "8,88"))]],
    "rate": [[item((100, "2"), (300, "Birnen"), (500, "7 %"), (700, "2,50"), (900, "5,00"))]],
    "apart": [[("column-header", [(100, "Menge"), (300, "Bezeichnung"), (700, "Einzelpreis"), (850, "Gesamt")]), item((100, "2"), (300, "Birnen"), (700, "2,50"), (920, "8,88"))]],
    "dropped": [[("column-header", [(100, "Lieferdatum"), (300, "Bezeichnung")]), item((100, "12.03."), (300, "Birnen"))]],
    "codes": [[("column-header", [(100, "Artikel"), (300, "Bezeichnung"), (900, "Betrag")]), item((100, "55512"), (300, "Birnen"), (900, "7,00")), item((100, "55513"), (300, "Lauch"), (900, "3,00"))]],
    "code left": [[item((100, "K-5551"), (300, "Birnen gelb"), (900, "7,00")), item((100, "K-5552"), (300, "Lauch"), (900, "3,00"))]],
    "code in name": [[HEAD, item((300, "55512"), (360, "Birnen"), (900, "7,00"))]],
    "wraps": [[HEAD, item((100, "2"), (300, "Birnen gelb"), (700, "2,50"), (900, "5,00")), ("line-wrap", [(200, "kg"), (300, "sehr fein")]), ("continuation", [(300, "Klasse II"), (900, "8,00")])]],
    "note": [[HEAD, item((100, "2"), (300, "Birnen"), (900, "5,00")), ("line-wrap", [(300, "Schema der Artikelkennung: 0160"), (700, "Charge 7")])]],
    "no item": [[HEAD, ("line-wrap", [(300, "Übertrag")]), item((300, "Birnen"), (900, "5,00")), ("total", [(300, "Summe")]), ("line-wrap", [(300, "Pfand")])]],
    "beside": [[HEAD, item((300, "Birnen"), (900, "5,00")), ("line-wrap", [(1100, "Bio"), (50, "7")])]],
    "split number": [[HEAD, item((100, "3."), (125, ",250"), (300, "Lauch"), (900, "5,00"))]],
    "unit inside": [[HEAD, item((100, "15 Stk"), (300, "Birnen"), (900, "5,00")), item((200, "6 kg"), (300, "Lauch"), (900, "5,00")), item((100, "15 Birnen"), (300, "Birnen"), (900, "5,00"))]],
    "unit cut": [[HEAD, item((100, "17F"), (300, "Riesling"), (900, "99,00")), item((100, "12"), (200, "Fl"), (300, "Silvaner"), (900, "90,00")), item((100, "6"), (200, "F1"), (300, "Traminer"), (900, "45,00"))]],
    "unit open": [[HEAD, item((100, "17F"), (300, "Riesling"), (900, "99,00")), item((100, "12"), (200, "Fl"), (300, "Silvaner"), (900, "90,00")), item((100, "1"), (200, "Fass"), (300, "Bier"), (900, "60,00"))]],
    "goes on": [[("column-header", [(100, "Menge"), (300, "Bezeichnung"), (700, "Gesamt"), (900, "Einzelpreis")]), item((100, "2"), (300, "Birnen"), (700, "5,00"), (900, "2,50"))], [item((100, "3"), (300, "Lauch"), (700, "8,88"), (900, "1,00"))], [HEAD, item((100, "3"), (300, "Lauch"), (700, "1,00"), (900, "8,88"))], [item((300, "Kohl"), (700, "1,10"), (900, "7,77"))]],
    "key ends": [[HEAD, item((300, "• Birnen GTIN 4001234567890"), (900, "5,00")), item((300, "Lauch Art.-Nr.: 12 -"), (900, "5,00"))]],
    "headings": [[("column-header", [(100, "Merge"), (200, "Eirheit"), (300, "Bezeichnung"), (600, "MwSt")]), item((100, "x"), (200, "y"), (300, "Birnen"), (600, "z"))]],
    "none": [[("header", [(50, "Rechnung")])]],
}
F_ = {"q": "quantity", "u": "unit", "n": "name", "p": "unit_price", "s": "line_net", "a": "article_id", "v": "vat"}
WANT = {
    "headed": {(0, 0): dict(q="2", u="kg", n="Birnen gelb", p="2,50", s="5,00"), (0, 1): dict(q="12", u="Stk", n="Brezel", p="0,50", s="6,00")},
    "swapped": {(0, 0): dict(q="2", u="kg", n="Birnen gelb", p="2,50", s="5,00"), (0, 1): dict(q="12", u="Stk", n="Brezel", p="0,50", s="6,00")},
    "counting": {(0, 0): dict(q="1", n="Birnen", p="2,50", s="2,50"), (0, 1): dict(q="2", n="Brezel", p="0,50", s="1,00"), (0, 2): dict(q="3", n="Lauch", p="0,80", s="2,40")},
    "position": {(0, 0): dict(q="2", n="Birnen", p="2,50", s="5,00"), (0, 1): dict(q="4", n="Brezel", p="0,50", s="2,00")},
    "no sum": {(0, 0): dict(q="2", n="Birnen", p="3,00", s="8,88")},
    "rate": {(0, 0): dict(q="2", n="Birnen", v="7 %", p="2,50", s="5,00")},
    "apart": {(0, 0): dict(q="2", n="Birnen", p="2,50", s="8,88")},
    "dropped": {(0, 0): dict(n="Birnen")},
    "codes": {(0, 0): dict(a="55512", n="Birnen", s="7,00"), (0, 1): dict(a="55513", n="Lauch", s="3,00")},
    "code left": {(0, 0): dict(a="K-5551", n="Birnen gelb", s="7,00"), (0, 1): dict(a="K-5552", n="Lauch", s="3,00")},
    "code in name": {(0, 0): dict(a="55512", n="Birnen", s="7,00")},
    "wraps": {(0, 0): dict(q="2", u="kg", n="Birnen gelb sehr fein Klasse II", p="2,50", s="5,00")},
    "note": {(0, 0): dict(q="2", n="Birnen", s="5,00")},
    "no item": {(0, 0): dict(n="Birnen", s="5,00")},
    "beside": {(0, 0): dict(n="Birnen Bio", s="5,00")},
    "split number": {(0, 0): dict(q="3,250", n="Lauch", s="5,00")},
    "unit inside": {(0, 0): dict(q="15", u="Stk", n="Birnen", s="5,00"), (0, 1): dict(q="6", u="kg", n="Lauch", s="5,00"), (0, 2): dict(q="15 Birnen", n="Birnen", s="5,00")},
    "unit cut": {(0, 0): dict(q="17", u="Fl", n="Riesling", s="99,00"), (0, 1): dict(q="12", u="Fl", n="Silvaner", s="90,00"), (0, 2): dict(q="6", u="F1", n="Traminer", s="45,00")},
    "unit open": {(0, 0): dict(q="17", n="Riesling", s="99,00"), (0, 1): dict(q="12", u="Fl", n="Silvaner", s="90,00"), (0, 2): dict(q="1", u="Fass", n="Bier", s="60,00")},
    "goes on": {(0, 0): dict(q="2", n="Birnen", p="2,50", s="5,00"), (1, 0): dict(q="3", n="Lauch", p="1,00", s="8,88"), (2, 0): dict(q="3", n="Lauch", p="1,00", s="8,88"), (3, 0): dict(n="Kohl", p="1,10", s="7,77")},
    "key ends": {(0, 0): dict(n="Birnen", s="5,00"), (0, 1): dict(n="Lauch", s="5,00")},
    "headings": {(0, 0): dict(q="x", u="y", n="Birnen", v="z")},
    "none": {},
}


@pytest.fixture(scope="module")
def fields(spark):
    rows = [w for doc, sheets in SHEETS.items() for w in words(doc, *sheets)]
    return scans.read_tables(spark.createDataFrame(rows, WORDS).repartition(3), ["doc"]).collect()


@pytest.mark.parametrize("doc", SHEETS)
def test_tables(fields, doc):
    got = {}
    for r in fields:
        if r.doc == doc:
            got.setdefault((r.page, r.item), {})[r.field] = r.text
    assert got == {k: {F_[f]: t for f, t in v.items()} for k, v in WANT[doc].items()}


def test_boxes_of_fields(fields):
    box = {(r.doc, r.item, r.field): (r.x, r.y, r.w, r.h) for r in fields}
    assert box["headed", 0, "name"] == (300, 30, 108, 20)
    assert box["wraps", 0, "name"] == (300, 30, 108, 80)
    q, u = box["unit inside", 0, "quantity"], box["unit inside", 0, "unit"]
    assert q[0] == 100 and q[0] + q[2] <= u[0] and u[0] + u[2] == 158
    assert box["unit cut", 0, "quantity"][2] <= 20


NUMBERS = {
    "beside": [[("header", [(50, "Rechnungsnummer", "number_label"), (250, "A-1", "number", 0.5), (600, "B-2", "number", 0.9)])]],
    "surest": [[("header", [(250, "A-1", "number", 0.5), (600, "B-2", "number", 0.9)])]],
    "later page": [[("header", [(50, "Z-9", "number", 0.9)])], [("header", [(50, "Nr", "number_label"), (250, "A-1", "number", 0.4)])]],
    "first page": [[("header", [(50, "Z-9", "number", 0.3)])], [("header", [(50, "A-1", "number", 0.9)])]],
    "beneath": [[("header", [(50, "Nummer", "number_label")]), ("header", [(60, "A-1", "number", 0.3), (900, "B-2", "number", 0.9)])]],
    "role": [[("header", [(50, "A-1", "number", 0.3)]), ("footer", [(50, "x", None), (500, "B-2", "number", 0.9)])]],
}
SUPPLIERS = {
    "Muster Handel GmbH": [[("header", [(50, "Muster Handel", "supplier")]), ("header", [(50, "GmbH", "supplier")])]],
    "Muster OG": [[("header", [(50, "Muster Muster OG", "supplier")])]],
    "Langer Name KG": [[("header", [(50, "Kurz", "supplier")]), ("header", [(700, "Langer Name KG", "supplier")])]],
}
DATES = {
    "08.11.2025": [[("header", [(50, "Datum", "date_label"), (250, "08.11.", "date"), (400, "2025", "date")])]],
    "01.11.2025": [[("header", [(50, "Datum", "date_label"), (250, "01.11.2025", "date"), (500, "02.11.2025", "date")])]],
}


def test_header_values(spark):
    docs = {**{f"n.{k}": v for k, v in NUMBERS.items()}, **{f"s.{k}": v for k, v in SUPPLIERS.items()}, **{f"d.{k}": v for k, v in DATES.items()}}
    rows = [w for doc, sheets in docs.items() for w in words(doc, *sheets)]
    got = {r.doc: r.text for r in scans.pick_header_values(spark.createDataFrame(rows, WORDS).repartition(3), ["doc"]).collect()}
    assert {k[2:]: v for k, v in got.items() if k[0] == "n"} == {"beside": "A-1", "surest": "B-2", "later page": "A-1", "first page": "Z-9", "beneath": "A-1", "role": "A-1"}
    assert {k[2:]: v for k, v in got.items() if k[0] == "s"} == {k: k for k in SUPPLIERS}
    assert [v.replace(" ", "") for k, v in sorted(got.items()) if k[0] == "d"] == ["01.11.2025", "08.11.2025"]


def test_invoice_from_words(spark):
    top = [("header", [(50, "Muster OG", "supplier")]), ("header", [(50, "Rechnungsnummer", "number_label"), (250, "RE-7", "number")]), ("header", [(50, "Datum", "date_label"), (250, "08.11.2025", "date")])]
    end = [("total", [(50, "Netto", "net_label"), (900, "11,00", "net_total")]), ("total", [(50, "MwSt", "vat_label"), (300, "7 %", "vat"), (900, "0,77")]), ("total", [(50, "Brutto", "gross_label"), (900, "11,77", "gross_total")])]
    good = [*top, HEAD, item((50, "1"), (100, "2"), (200, "kg"), (300, "Birnen gelb"), (700, "2,50"), (900, "5,00")), item((50, "2"), (100, "12"), (200, "Stk"), (300, "Brezel"), (700, "0,50"), (900, "6,00")), *end]
    # a quantity read as thousands, a digit read wrong, a lost price, a note
    bad = [HEAD, item((100, "5,450"), (200, "kg"), (300, "Rind"), (700, "10,00"), (900, "54,50")), item((100, "3"), (200, "Stk"), (300, "Brezel"), (700, "0,50"), (900, "4,00")), item((100, "4"), (300, "Lauch"), (900, "8,00")), item((300, "Danke"))]
    df = spark.createDataFrame([*words("good", good), *words("bad", bad), *words("none", [("header", [(50, "Hallo")])])], WORDS).repartition(3)
    invoices, lines = scans.assemble_invoices(df, ["doc"])
    assert sorted((r.doc, r.supplier_name, r.number, str(r.date), r.stated_net, r.stated_gross) for r in invoices.collect()) == [("bad", "", "", "None", None, None), ("good", "Muster OG", "RE-7", "2025-11-08", 1100, 1177), ("none", "", "", "None", None, None)]
    got = sorted(tuple(r) for r in lines.select("doc", "no", "name", "quantity", "unit_code", "unit_price", "line_net", "vat").collect())
    assert got == [
        ("bad", 1, "Rind", 5450, "KGM", 10_000_000, 5450, 0), ("bad", 2, "Brezel", 8000, "H87", 500_000, 400, 0), ("bad", 3, "Lauch", 4000, "", 2_000_000, 800, 0),
        ("good", 1, "Birnen gelb", 2000, "KGM", 2_500_000, 500, 700), ("good", 2, "Brezel", 12000, "H87", 500_000, 600, 700),
    ]
    invoices, lines = scans.assemble_invoices(df.limit(0), ["doc"])
    assert invoices.count() == 0 and lines.count() == 0


def test_gap_boxes(spark):
    def row(doc, line, **x):
        return [(doc, line, f, at, 40 * line, w, 20) for f, (at, w) in x.items()]

    full = dict(quantity=(100, 30), name=(300, 100), unit_price=(700, 40), line_net=(900, 40))
    rows = [*row("a", 0, **full), *row("a", 1, **{k: v for k, v in full.items() if k != "unit_price"}), *row("a", 2, **full)]
    rows += [*row("b", 0, **full), *row("b", 1, name=(300, 100), unit_price=(700, 40)), *row("c", 0, name=(300, 100)), *row("c", 1, **full)]
    rows += [*row("d", 0, **full), *row("d", 1, quantity=(100, 30), name=(300, 420), line_net=(900, 40)), *row("d", 2, **full)]
    got = scans.estimate_gap_boxes(spark.createDataFrame(rows, "doc string, line int, field string, x long, y long, w long, h long"), ["doc"]).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "unit_price", 660, 35, 100, 30)]


def test_gap_boxes_as_worked_out_line_by_line(spark):
    """Random lines, some next to none, with cells that overlap or are set higher, against the rule line by line."""
    import random

    rng, fields, docs = random.Random(5), ("quantity", "unit", "unit_price", "line_net"), {}
    for doc in range(150):
        for line in rng.sample(range(8), rng.randrange(1, 8)):
            there = [(f, 150 * i) for i, f in enumerate(["quantity", "unit", "name", "unit_price", "line_net"]) if rng.random() < 0.7]
            docs.setdefault(doc, {})[line] = {f: (x + rng.randrange(30), 40 * line + rng.choice([0, 0, 3, 25]), rng.choice([30, 60, 170]), 20 + rng.randrange(3)) for f, x in there}

    def union(a, b):
        if not a or not b:
            return a or b
        x, y = min(a[0], b[0]), min(a[1], b[1])
        return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y

    def gap(lines, line, f):
        above, below = lines.get(line - 1, {}).get(f), lines.get(line + 1, {}).get(f)
        k, row = union(above, below), lines[line].values()
        if not k or any(b[0] < k[0] + k[2] and k[0] < b[0] + b[2] for b in row):
            return None
        left = max((b for b in row if b[0] + b[2] <= k[0]), key=lambda b: (b[0] + b[2], b), default=None)
        right = min((b for b in row if b[0] >= k[0] + k[2]), default=None)
        if sum(b is not None for b in (above, below, left, right)) < 3:
            return None
        _, y, _, h = union(left, right)
        if above and above[1] + above[3] > y + h // 2 or below and below[1] < y + h // 2:
            return None
        x0, x1 = max(left[0] + left[2] if left else 0, k[0] - k[2]), min(right[0] if right else (1 << 31) - 1, k[0] + k[2] + h)
        return x0, y - h // 4, x1 - x0, h + 2 * (h // 4)

    want = sorted((d, n, f, *b) for d, lines in docs.items() for n, m in lines.items() for f in fields if m and f not in m and (b := gap({n: m for n, m in lines.items() if m}, n, f)))
    cells = spark.createDataFrame([(d, n, f, *b) for d, lines in docs.items() for n, m in lines.items() for f, b in m.items()], "doc int, line int, field string, x long, y long, w long, h long")
    got = sorted(tuple(r) for r in scans.estimate_gap_boxes(cells, ["doc"]).collect())
    assert got == want and len(want) > 30


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_placed_cells_are_not_joined_back(spark, sf):
    """F7, F16, F4: cells go through the fold over their page, so that words are dealt once."""
    from kontora.plans import scan_queries
    from kontora.plans.audit_queries import Audit

    columns, cells = scans.place_columns(scan_queries._first_page(Audit(spark, sf)), ["doc"])
    assert "Join" not in _plan(cells) and "lineitem" not in _plan(columns)


@pytest.mark.parametrize("name", ["assemble_headers", "pick_header_value"])
def test_headers_read_words_that_are_printed_once(spark, sf, name):
    """words are written before they are read for values, labels and extents."""
    from kontora import registry

    assert "lineitem" not in _plan(registry.QUERIES[name](spark, sf))


def test_gaps_look_at_their_neighbours_once(spark):
    """no filter works neighbours out again, and lines are dealt once."""
    cells = spark.createDataFrame([], "doc string, line int, field string, x long, y long, w long, h long")
    plan = _plan(scans.estimate_gap_boxes(cells, ["doc"]))
    assert "element_at" in plan and not [p for p in plan.splitlines() if "Filter" in p and ("element_at" in p or "array_m" in p)]
    assert scans.estimate_gap_boxes(cells, ["doc"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_names_with_words_that_begin_alike(spark):
    """Words that all begin otherwise are printed once; others are looked at as a whole."""
    rows = [([["green", "ring", "GmbH"]],), ([["a", "b"], ["A", "B"]],), ([["Bar", "Ross"], ["Wein", "Bar", "Roß"]],), ([["x", ""]],)]
    got = spark.createDataFrame(rows, "t array<array<string>>").select(scans._undoubled(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [["green", "ring", "GmbH"], ["a", "b"], ["Wein", "Bar", "Roß"], ["x"]]


def test_edits_of_digits_and_rows_that_may_add_up(spark):
    """Confusions by arithmetic are those of the printed digits, and no row that adds up is kept from the exact test."""
    import random

    from pyspark.sql import functions as F

    from kontora.operators import repair

    rng = random.Random(3)
    values = [0, 8, -8, 10, 80, -1234567, 9, 1000000007, 123456789012345678, *[rng.randrange(-(10 ** rng.randrange(1, 18)), 10 ** rng.randrange(1, 18)) for _ in range(200)]]
    shapes = repair._pairs()

    def want(v):
        t = str(abs(v))
        out = [t[:i] + d + t[i + 1 :] for i, x in enumerate(t) for d in shapes[x] if not (i == 0 and d == "0" and len(t) > 1)]
        return [int(x) * (-1 if v < 0 else 1) for x in out]

    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", repair.confusions(F.col("v")).alias("got")).collect():
        assert r.got == list(dict.fromkeys(want(r.v)))
    rows = []
    for _ in range(400):
        q, p, b = rng.randrange(-(10**7), 10**7), rng.randrange(-(10**9), 10**9), rng.choice([1000, 1, 0, -5, 12000])
        whole = (b if b > 0 else 1000) * 10_000
        rows += [(q, p, b, q * p // whole + d) for d in (-1, 0, 1)]
    rows += [(1, 5000, 1, n) for n in (0, 1)] + [(-1, 5000, 1, n) for n in (0, -1)]
    c = F.col
    both = spark.createDataFrame(rows, "q long, p long, b long, n long").select(repair.adds(c("q"), c("p"), c("b"), c("n")).alias("adds"), repair.may_add(c("q"), c("p"), c("b"), c("n")).alias("may"))
    assert both.filter("adds").count() > 400 and not both.filter("adds AND NOT may").count()


def test_columns_of_a_page_of_plain_cells():
    """A heading joins the cells of its number beside it, a wide cell the narrowest column, a wrapped one only what is there."""
    heads = [(0, 50, 28, 0), (0, 200, 40, 2)]
    rows = [(1, 55, 20, 0), (1, 100, 40, 1), (1, 250, 60, 2), (1, 56, 80, 1)]
    columns, places = scans._read_page([*heads, *rows, (2, 255, 10, 2), (2, 900, 10, 2), (3, 50, 10, 0)], [])
    assert [(k.x0, k.x1, k.ids) for k in columns] == [(50, 78, [0]), (56, 140, [2]), (200, 310, [3, 1])]
    assert places == [0, 2, 0, 1, 2, 1, 2, None, None]
    columns, places = scans._read_page([(1, 60, 10, 0), (1, 400, 10, 1)], [(50, 80), (300, 350)])
    assert [(k.x0, k.x1, k.ids) for k in columns] == [(50, 80, [0]), (300, 350, [1]), (400, 410, [2])] and places == [0, 2]


def test_units_are_known_without_looking_them_up(spark):
    from kontora.functions.units import UNITS, is_unit, unit

    texts = [x for u in UNITS for x in (u[0], u[0].lower(), *u[5], *(f" {a.upper()}." for a in u[5]))] + ["", " ", "12,50", "kg kg", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_unit(F.col("t")).alias("known"), unit(F.col("t")).isNotNull().alias("found")).collect()
    assert [r.t for r in rows if r.known != r.found] == [] and sum(r.known for r in rows) == len(texts) - 5


def test_plain_numbers_read_as_others_do(spark):
    from kontora.functions import reading

    texts = ["7", "0", "007", "1234567", "1,5", "1,2345678", "1,005", "1,999995", "12.345,60", "1.234", "1.234.567,89", "123456789012,999999", "12,50\n", "1234.567,8", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for scale in (2, 3, 6):
        both = rows.select("t", reading.parse_number(F.col("t"), scale).alias("a"), reading.parse_number(F.concat(F.col("t"), F.lit(" €")), scale).alias("b")).collect()
        assert [r.t for r in both if r.a != r.b] == []
