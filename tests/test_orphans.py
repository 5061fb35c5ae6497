from datetime import datetime

from ledgerlens.operators.orphans import find_orphans, orphan_report

INV = "invoice_id long, po_number string, delivery_number string, loaded_at timestamp, voided_at timestamp, key string"
BOL = "bol_id long, po_number string, bol_number string, loaded_at timestamp, voided_at timestamp, ref int"
POD = "pod_id long, referenced_bol string, referenced_po string, loaded_at timestamp"
D = lambda d: datetime(2024, 1, d)


def tables(spark, inv=(), bol=(), pod=()):
    return {"invoices": spark.createDataFrame(list(inv), INV), "bols": spark.createDataFrame(list(bol), BOL), "pods": spark.createDataFrame(list(pod), POD)}


def test_kinds(spark):
    t = tables(
        spark,
        inv=[(1, "PO#045", "BOL 7", D(5), None, "x"), (2, "45", None, D(1), D(9), "x"), (3, "TBD", "000", D(5), None, None), (4, "99", "8", D(5), None, "x"), (4, "99", "8", D(5), None, "x")],
        bol=[(1, "4-5", "007.", D(3), None, 1), (2, None, "8", D(1), D(2), 1)],
    )
    got = sorted(tuple(r) for r in find_orphans(t).collect())
    assert got == sorted([
        ("invoices", "po_number", 2, "late", "2024-01"),
        ("invoices", "po_number", 4, "missing", "2024-01"), ("invoices", "po_number", 4, "missing", "2024-01"),
        ("invoices", "delivery_number", 4, "deleted", "2024-01"), ("invoices", "delivery_number", 4, "deleted", "2024-01"),
    ])
    assert {tuple(r) for r in orphan_report(find_orphans(t)).collect()} >= {("invoices", "po_number", "late", "2024-01", 1)}


def test_ties_nulls_and_empty_tables(spark):
    assert find_orphans(tables(spark)).count() == 0
    t = tables(spark, bol=[(1, None, "5", D(2), None, 1), (2, None, "6", None, None, 1)], pod=[(1, "5", None, D(2)), (2, "5", None, None), (3, "6", "x" * 100_000, D(3)), (4, "", " ", D(3))])
    got = sorted((r.src_id, r.orphan_kind, r.ref_month) for r in find_orphans(t).collect())
    # loaded at the same time is no orphan; a row without loaded_at is before every parent; a parent without is never loaded
    assert got == [(2, "late", None), (3, "missing", "2024-01")]


def test_months_are_utc_in_any_session(spark):
    from datetime import timezone

    from ledgerlens.operators.orphans import utc_clock

    at = datetime(2024, 2, 1, 1, 30, tzinfo=timezone.utc)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            from pyspark.sql import functions as F

            df = spark.createDataFrame([(int(at.timestamp()),)], "s long").select(F.date_format(utc_clock(F.timestamp_seconds("s")), "yyyy-MM").alias("m"))
            assert df.first().m == "2024-02"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
