"""Every registered query runs on the small tables and gives the columns its SQL names."""

import pytest

from kontora import registry, views


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def _shown(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


#: Queries that take more than some seconds on the smallest tables; run with -m slow, or all with -m "slow or not slow".
SLOW = """allocation product_rows calculated_totals revenue_by_rate suggest_assortment supply_rows used_by binding_names assemble_invoices
assemble_headers pick_header_value type_columns place_columns stock_balance stock_unit_flags resolve_yield sellable_stock report_data
warnings included_lines suggestion_candidates recipe_leaves stream_upsert stream_case_totals stream_map stream_invoices unify_suppliers
shared_articles auto_map group_exclusions line_groups""".split()


@pytest.mark.parametrize("name", [pytest.param(n, marks=pytest.mark.slow) if n in SLOW else n for n in registry.ORACLES])
def test_against_duckdb(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in views.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = sorted(map(repr, ([*map(_shown, r)] for r in want.fetchall())))
    got = sorted(map(repr, ([*map(_shown, r)] for r in registry.QUERIES[name](spark, sf).select(*columns).collect())))
    assert got == rows


@pytest.mark.slow
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_runs(spark, sf, name):
    """Queries without SQL; what they give is tested elsewhere."""
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_allocation_on_driver_tables_keeps_the_identities(spark, sf):
    from kontora.plans.review_queries import whole

    report = whole(spark, sf)
    for t in report.totals.collect():
        assert t.purchases - t.unmapped_cost - t.unused_cost - t.no_revenue_cost == t.cost_of_goods + t.stock_change
    used = report.allocation.filter("kind = 'stock' and n < 0").count()
    assert used == 0


def test_display_units_of_large_keys(spark, tmp_path):
    """Keys above those of the small tables give what the SQL gives."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(7,), (99_999,), (100_000,), (1_234_567,)], "l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(registry.ORACLES["display_units"])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in registry.QUERIES["display_units"](spark, str(tmp_path)).select(*columns).collect()) == sorted(want.fetchall())


def test_included_lines_are_numbered_by_what_orders_them(spark, sf, monkeypatch):
    """Names and amounts of lines are not written to number them."""
    from kontora.operators import stock

    seen = []
    monkeypatch.setattr(stock, "included_lines", lambda lines, excluded: seen.append(lines.columns) or lines.withColumn("place", lines["ord"]))
    registry.QUERIES["included_lines"](spark, sf)
    assert seen == [["case_id", "invoice_id", "ord", "no", "number", "date"]]


def test_packed_invoice_files_say_the_same(spark, sf):
    """Files are packed and hold every invoice closed, in one root, with its lines in order."""
    import gzip
    from pathlib import Path

    from kontora.plans.audit_queries import Audit
    from kontora.plans.corpus_queries import ubl_files

    packed, plain = (Path(ubl_files(Audit(spark, sf), codec=k).removeprefix("file:")) for k in ("gzip", "none"))
    files = sorted(packed.rglob("part-*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    texts = sorted(gzip.decompress(f.read_bytes()).decode() for f in files)
    assert texts == sorted(f.read_text() for f in plain.rglob("part-*"))
    for t in texts:
        assert t.startswith("<All>") and t.rstrip().endswith("</All>") and t.count("<Invoice ") == t.count("</Invoice>") > 0
        assert all(part.count("<cac:InvoiceLine>") >= 1 for part in t.split("</Invoice>")[:-1])


def test_scores_read_lines_that_are_written_once(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(views, "stored", lambda df, what, real=views.stored: made.append((what, len(df.columns))) or real(df, what))
    registry.QUERIES["score_report"](spark, sf)
    assert made == [("lines", 12)]
