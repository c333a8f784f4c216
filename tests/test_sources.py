"""Round trips of the sources."""

import json

import pytest

from kontora.sources import documents as d
from kontora.sources import tables as s


def test_expected_and_ruleset(spark, tmp_path):
    line = {"no": 1, "name": "Pils", "quantity": 1000, "unitCode": "XKG", "unitPrice": 1, "priceBaseQty": 1000, "lineNet": 5, "vat": 1900, "expectedProductId": "p", "expectedFactor": 3}
    (tmp_path / "a.expected.json").write_text(json.dumps({"source": "ubl", "number": "7", "date": "2025-01-08", "netTotal": 5, "lines": [line, {**line, "no": 2}]}))
    invoices, lines = s.read_expected(spark, str(tmp_path))
    assert invoices.count() == 1 and [(r.ord, r.no, r.lineNet) for r in lines.orderBy("ord").collect()] == [(1, 1, 5), (2, 2, 5)]
    (tmp_path / "rules.json").write_text(json.dumps({"products": {"p": {"name": "Pils", "unit": "MLT", "meta": {"validTo": "2025-01-01"}}}, "categories": {}}))
    rules = s.read_ruleset(spark, str(tmp_path / "rules.json"))
    p = rules["products"].first()
    assert (p.id, p.name, str(p.valid_to), p.rev) == ("p", "Pils", "2025-01-01", 0) and p.changed_at is not None and rules["categories"].count() == 0


def test_cases_replace_only_what_is_written(spark, tmp_path):
    make = lambda rows: {"cases": spark.createDataFrame(rows, "case_id string, label string")}
    s.save_cases(make([("a", "1"), ("b", "2")]), str(tmp_path / "c"))
    s.save_cases(make([("b", "3")]), str(tmp_path / "c"))
    assert sorted((r.case_id, r.label) for r in s.load_cases(spark, str(tmp_path / "c"), ["cases"])["cases"].collect()) == [("a", "1"), ("b", "3")]
    assert s.load_cases(spark, str(tmp_path / "c"), ["cases"], ["a"])["cases"].count() == 1


def test_readings(spark, tmp_path):
    docs = spark.createDataFrame([("x", "r1"), ("x", "r1"), ("y", "r2")], "content string, reading string")
    s.keep_readings(docs.filter("content = 'x'"), "v1", str(tmp_path / "r"))
    known, unknown = s.find_readings(docs.select("content"), "v1", spark.read.parquet(str(tmp_path / "r")))
    assert known.count() == 2 and [r.content for r in unknown.collect()] == ["y"]
    assert s.find_readings(docs.select("content"), "v2", spark.read.parquet(str(tmp_path / "r")))[0].count() == 0


def test_assortment(spark, tmp_path):
    df = spark.createDataFrame([("p1", "Bier; hell", 450, 1900), ("p2", "Apfel", 0, 700)], "product_id string, name string, gross_price long, vat long")
    s.write_assortment_csv(df, str(tmp_path / "out"))
    got = sorted((r.given_id, r.name, r.gross_price, r.vat) for r in s.read_assortment_csv(spark, str(tmp_path / "out")).collect())
    assert got == [("p1", "Bier; hell", 450, 1900), ("p2", "Apfel", 0, 700)]
    files = [p.read_bytes() for p in sorted((tmp_path / "out").glob("*.csv"))]
    assert all(f.startswith("\ufeffProdukt;Bruttopreis;USt;Produkt-ID\r\n".encode()) for f in files)
    assert b"".join(f.split(b"\r\n", 1)[1] for f in files) == 'Apfel;;7 %;p2\r\n"Bier; hell";4,50 €;19 %;p1\r\n'.encode()
    (tmp_path / "bad.csv").write_text("preis\n1\n")
    with pytest.raises(ValueError):
        s.read_assortment_csv(spark, str(tmp_path / "bad.csv"))


def test_assortment_of_other_programs(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes('ust,PRODUKT,bruttopreis\r\n7,"Käse, ""alt""",1.50\r\n ,, \r\n,Brötchen,\r\n'.encode("latin-1"))
    got = sorted((r.name, r.given_id, r.gross_price, r.vat) for r in s.read_assortment_csv(spark, str(tmp_path / "latin.csv")).collect())
    assert got == [("Brötchen", None, 0, 1900), ('Käse, "alt"', None, 150, 700)]


def test_invoice_csv(spark, tmp_path):
    head = spark.createDataFrame([("i1", "Bar", "a.pdf", "ubl", 'Meier; "Söhne"', "7", None, 123456, -5, None)], "invoice_id string, case_label string, file_name string, source string, supplier_name string, number string, date date, net_total long, gross_total long, verified string")
    rows = [("i1", 1, 1, "Pils\n0,5 l", None, "40", 1500, "XCS", 1250000, 187, 1900, "Bier"), ("i1", 2, 2, "Rest", "9", None, 1000, None, 1000000, 100, 700, None)]
    lines = spark.createDataFrame(rows[::-1], "invoice_id string, ord long, no long, name string, seller_article_id string, gtin string, quantity long, unit_code string, unit_price long, line_net long, vat long, product string")
    d.write_invoice_csv(head, lines, str(tmp_path / "i"))
    (file,) = (tmp_path / "i" / "invoice_id=i1").glob("*.txt")
    want = ["\ufeffPrüfung;Bar", "Datei;a.pdf", "Quelle;ubl", 'Lieferant;"Meier; ""Söhne"""', "Rechnungsnummer;7", "Datum;", "Netto;1.234,56 €", "Brutto;-0,05 €", "Durchsicht;", ""]
    want += ["Zeile;Position;Artikelnummer;GTIN;Menge;Einzelpreis;Netto;USt;Zuordnung", '1;"Pils\n0,5 l";;40;1,5 XCS;1,25 €;1,87 €;19 %;Bier', "2;Rest;9;;1;1,00 €;1,00 €;7 %;ungeklärt", ""]
    assert file.read_bytes().decode() == "\r\n".join(want)


def test_guideline(spark, tmp_path):
    satz = {"aufschlag": {"von": 150, "bis": 300, "mittel": 220}, "rohgewinnI": {"mittel": 60}}
    klasse = {"name": "Schankwirtschaft", "kennzahlen": ["5610", "5630"], "staffeln": [{"bis": 100, "sätze": satz}, {"von": 100, "sätze": {}}]}
    amount = {"von": "2024-01-01", "bis": "2024-06-30", "gewerbezweig": "Bäckerei", "ermäßigt": 100, "voll": 20, "gesamt": 120}
    (tmp_path / "g.json").write_text(json.dumps({"year": 2024, "klassen": [klasse], "synonyme": [{"begriff": "Bar", "klasse": "Schankwirtschaft"}], "pauschbeträge": [amount]}))
    t = d.read_guideline(spark, str(tmp_path / "g.json"))
    assert sorted((r.code, r.band, r.above, r.upto, r.rate_from, r.rate_to, r.rate_mean) for r in t["bands"].collect()) == [(k, b, *x) for k in ("5610", "5630") for b, x in ((0, (None, 100, 15000, 30000, 22000)), (1, (100, None, None, None, None)))]
    assert sorted((r.band, r.kind, r.rate_from, r.rate_mean) for r in t["rates"].collect()) == [(0, "aufschlag", 15000, 22000), (0, "rohgewinnI", None, 6000)]
    assert [tuple(r) for r in t["synonyms"].collect()] == [(2024, 0, "Bar", "Schankwirtschaft")]
    (r,) = t["flat_amounts"].collect()
    assert (str(r.valid_from), str(r.valid_to), r.trade, r.reduced, r.full, r.total) == ("2024-01-01", "2024-06-30", "Bäckerei", 100, 20, 120)


def test_units(spark):
    assert s.read_units(spark).select("code").distinct().count() == 25


def test_written_invoices_lie_in_few_files(spark, sf):
    """Files grow with the lines, 20 000 to a file, not with the invoices; each has one root."""
    import glob

    from kontora.plans.audit_queries import Audit
    from kontora.plans.corpus_queries import ubl_files

    a = Audit(spark, sf)
    lines, path = a.v.table("lineitem").count(), ubl_files(a)
    files = glob.glob(f"{path.removeprefix('file://')}/file=*/part-*")
    assert len(files) == 1 + lines // 20_000
    for f in files:
        text = open(f, encoding="utf-8").read().split("\n")
        assert text[0] == "<All>" and [x for x in text if x][-1] == "</All>" and text.count("</All>") == 1
    assert d.read_ubl(spark, path)[1].count() == a.v.lines.count()
