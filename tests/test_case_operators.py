import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.extract import text as X
from ledgerlens.extract import tiers
from ledgerlens.functions import exprs as E
from ledgerlens.operators import classify, match, receiving, report


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("$ 1,234.50", 1234.5), ("(-) $ 2.40-", -2.4), ("-$3.00", -3.0), ("($ 4.00", -4.0), ("none", None), (None, None), ("5", None)])
def test_parse_amount(spark, text, want):
    assert one(spark, E.parse_amount(F.col("a")), a=text) == want


@pytest.mark.parametrize("text, want", [("2.40-", -2.4), ("12", 12.0), ("-7.5", -7.5), ("x", None), ("", None), (None, None), ("1,000.001", 1000.001)])
def test_trailing_minus(spark, text, want):
    assert one(spark, E.parse_trailing_minus(F.col("a")), a=text) == want


@pytest.mark.parametrize("upc, material, want", [("1004157005278", "05278", "suffix5"), ("1004157005278", "5278", "suffix5"), ("100415701070", "11070", "suffix4"), ("1", "05278", None), (None, "05278", None), ("123", None, None), ("", "", None), ("9991234567", "1234567", "suffix5")])
def test_upc_suffix(spark, upc, material, want):
    assert one(spark, E.upc_suffix(F.col("u"), F.col("m")), u=upc, m=material) == want


def test_small_expressions(spark):
    assert one(spark, E.iso_date(F.col("a")), a=" 20240131 ") == "2024-01-31" and one(spark, E.iso_date(F.col("a")), a="01/02/24") == "01/02/24"
    assert one(spark, E.readable_chars(F.col("a")), a="a \t b c\x07") == 3 and one(spark, E.readable_chars(F.col("a")), a=None) == 0
    assert one(spark, E.says_no_shortage(F.col("a")), a="Over/Short: 0") and not one(spark, E.says_no_shortage(F.col("a")), a=None)
    assert one(spark, E.plausible_cases(F.col("a")), a="19999") and not one(spark, E.plausible_cases(F.col("a")), a="20000") and not one(spark, E.plausible_cases(F.col("a")), a="x")
    assert one(spark, E.net_unit_price(F.col("p"), F.col("q"), F.col("o")), p=67.02, q=627.0, o=-376.2) == pytest.approx(66.42)
    assert one(spark, E.net_unit_price(F.col("p"), F.col("q"), F.col("o")), p=5.0, q=0.0, o=-1.0) == 5.0
    assert one(spark, E.description_tokens(F.col("a")), a=" nut-thins, alm/low  ALM ") == ["NUT", "THINS", "ALM", "LOW"]


def test_documents_are_classified_by_the_strongest_then_the_first_rule(spark):
    c = lambda t, n=None: one(spark, classify.classify_document(F.col("t"), F.col("n")), t=t, n=n)
    assert c("straight bill of lading\nPOD").doc_type == "bill_of_lading" and c("x", "case/bol_page1.png").confidence == pytest.approx(0.72)
    assert c("REMITTANCE INFORMATION straight bill of lading").doc_type == "bill_of_lading"  # a tie
    assert tuple(c(None))[:2] == ("unknown", 0.2) == tuple(c("", ""))[:2] and c("pod").doc_type == "unknown" and c("POD -CM").rules == [4, 7]


def test_claims_are_classified_by_code_then_words(spark):
    c = lambda code, reason, d=None: tuple(one(spark, classify.classify_claim(F.col("c"), F.col("r"), F.col("d")), c=code, r=reason, d=d))
    assert c("6", "late delivery") == ("shortage", 0.92) and c(None, "OTIF fine") == ("compliance", 0.82) and c("99", None, "expired") == ("unsaleables", 0.75)
    assert c(None, None) == ("unknown", 0.0) and c(None, "misc") == ("unknown", 0.15)


def test_decision_table(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, n int")
    cols = classify.decision_table([(F.col("n") > 10, {"k": F.lit("big")}), (F.col("n") > 1, {"k": F.lit("mid")})], ["k"])
    assert [r.k for r in df.select("id", *cols).orderBy("id").collect()] == [None, "mid", "big"]


CLAIMS = "claim_line_id long, case_id long, upc string, unit_price double, description string, claim_invoice_number string, adj_amount double"
LINES = "invoice_line_id long, case_id long, material_number string, unit_price double, quantity double, off_invoice_promo double, description string"


def test_best_invoice_line(spark):
    claims = spark.createDataFrame([(1, 1, "1004157005278", 30.72, "NUT THINS ALM", None, None), (2, 1, "999", 31.44, None, None, None), (3, None, "1004157005278", 1.0, None, None, None), (4, 1, None, 10.0, None, None, None), (1, 1, "1004157005278", 30.72, "NUT THINS ALM", None, None)], CLAIMS)
    lines = spark.createDataFrame([(10, 1, "05278", 31.44, 66.0, -47.52, "NUT THINS"), (9, 1, "05278", 99.0, 1.0, None, None), (11, 1, "05278", 31.44, 66.0, -47.52, "NUT THINS"), (12, 2, "05278", 30.72, 1.0, None, None), (13, 1, None, 10.0, 1.0, None, None)], LINES)
    got = sorted(tuple(r) for r in match.best_invoice_lines(claims, lines).collect())
    assert got == [(1, 10, 1.0)]
    assert match.best_invoice_lines(claims.limit(0), lines).count() == 0
    ship = spark.createDataFrame([(5, 1, "05278", 3.0, True), (6, 1, "05278", 4.0, False), (7, 1, None, 4.0, True), (8, 1, "5278", None, True)], "shipped_line_id long, case_id long, material_number string, cases double, belongs_to_primary_shipment boolean")
    hit = match.shipped_for_claims(claims.where("claim_line_id = 1").limit(1), match.best_invoice_lines(claims, lines), lines, ship).collect()
    assert [tuple(r) for r in hit] == [(1, [5, 8], 3.0)]


def test_credit_memos(spark):
    claims = spark.createDataFrame([(1, 1, None, None, None, "90193", -5.0), (2, 1, None, None, None, "777", -5.0), (3, 1, None, None, None, None, -9.0), (4, 1, None, None, None, "", None)], CLAIMS)
    cm = spark.createDataFrame([(1, 3, "0090193-CM", True, -1.0), (1, 2, "ADJ-CM", True, -5.0), (1, 1, "0090193", False, 8.0)], "case_id long, pos int, seller_invoice_num string, is_credit_memo boolean, invoice_amount double")
    assert sorted(tuple(r) for r in match.credit_memos(claims, cm).collect()) == [(1, 3, -1.0, "number"), (2, 2, -5.0, "amount")]


REC = "k long, o int, stamp boolean, notes string, shipped double, received double, shortage boolean, exceptions array<string>"


def test_receiving_fold(spark):
    rows = [(1, 2, True, "short 10", 500000.0, 4200.0, False, ["b", "a"]), (1, 1, False, "ok", None, None, False, ["a"]), (1, 3, None, "ok", 4210.0, 1.0, None, None), (2, 1, None, None, 500000.0, None, None, None)]
    got = {r.k: r for r in receiving.fold_receiving(spark.createDataFrame(rows, REC), "k", "o").collect()}
    assert tuple(got[1]) == (1, 3, True, "ok; short 10", 4210.0, 4200.0, True, ["a", "b"])
    assert got[2].shipped == 500000.0 and got[2].n_records == 1
    assert receiving.fold_receiving(spark.createDataFrame([], REC), "k", "o").count() == 0


def test_stamp_geometry(spark):
    ocr = spark.createDataFrame([(1, 1, "RECEIVING STAMP", 100.0, 200.0, 300.0, 220.0, 1700, 2200, 0.9), (1, 2, "4200", 150.0, 260.0, 200.0, 280.0, 1700, 2200, 0.5), (1, 3, "far", 1.0, 2100.0, 20.0, 2120.0, 1700, 2200, 0.1), (2, 1, None, None, None, None, None, 1700, 2200, None)],
                                "page_id long, line_no int, text string, x1 double, y1 double, x2 double, y2 double, page_w int, page_h int, confidence double")
    box = receiving.stamp_regions(ocr)
    assert [tuple(r) for r in box.collect()] == [(1, 20, 160, 460, 440, 1)]
    assert [(r.n_lines, r.text) for r in receiving.lines_in_region(ocr, box).collect()] == [(2, "RECEIVING STAMP\n4200")]


def test_other_shipments(spark):
    rows = [(1, 1, "B1", None, " Dock  a"), (1, 2, "b1", "P9", "DOCK A"), (1, 3, "B2", None, None), (1, 4, None, "P1", None), (1, 5, None, None, None), (2, 1, None, None, None), (2, 2, "X", None, None)]
    got = receiving.other_shipment_pages(spark.createDataFrame(rows, "doc_id long, page_number int, bol_number string, po_number string, ship_to string")).collect()
    assert sorted((r.doc_id, r.page_number) for r in got if r.is_other) == [(1, 3), (1, 4)]


def test_invoice_text(spark):
    t = """[page 1]
Document Number 90403395
10  11023 RSTD SLTD LOW SOD 12/12-1.5 OZ TUBE  4 EA  115.20  460.80 USD
Off Invoice Pro Qty  46.08- USD
20 11069WHOLENAT6-25OZSBAG 80EA 58.26 4,660.80 USD
Off Invoice Pro Qty 0.00- USD
Off Invoice Pro Qty 9.00- USD
Subtotal 5,121.60"""
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "x" * 200_000)], "doc_id long, text string")
    rows = [tuple(r)[2:] for r in X.invoice_rows(df).orderBy("pos").collect()]
    assert rows == [("10", "11023", "RSTD SLTD LOW SOD 12/12-1.5 OZ TUBE", 4.0, 115.2, 460.8, -46.08), ("20", "11069", "WHOLENAT6-25OZSBAG", 80.0, 58.26, 4660.8, None)]
    head = {r.doc_id: r for r in X.invoice_headers(df).collect()}
    assert head[1].invoice_number == "90403395" and head[1].subtotal == 5121.6 and head[1].carrier is None and head[2].invoice_number is None


def test_pod_and_remittance_text(spark):
    df = spark.createDataFrame([(1, "Total # of Cases on BOL 4210\nTOTAL # Of Cases RECVD 4200\nShort: 10"), (2, "nothing 12"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in X.pod_totals(df).collect()] == [(1, 4210, 4200, 10, None, "Cases on BOL: 4210; Cases received: 4200; Short: 10", True)]
    r = spark.createDataFrame([(1, "00001 7001 $1,000.00 $990.00 D\n00002 7001-CM $20.00- $20.00-\nSELLER INVOICE NUM: 7001\nTERMS DISC AMT: $5.00\nSELLER INVOICE NUM: 7001\nTERMS DISC AMT: $10.00")], "doc_id long, text string")
    assert [tuple(x)[1:] for x in X.remittance_rows(r).orderBy("pos").collect()] == [(1, "7001", False, 1000.0, 990.0, 10.0), (2, "7001-CM", True, -20.0, -20.0, None)]


def test_claim_text(spark):
    t = "Associated Deductions\n\nNUT THINS\n1004157005278\n66 $ 30.72 6\n(-) $ 2,027.52\nshortage\n1004157005278 again shortage\n\n\n\n\n\n\n\n\n\n\n\n99999999999 no reason near"
    got = X.claim_rows(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")).collect()
    assert [(r.upc, r.description, r.adj_qty, r.unit_price, r.adj_amount, r.reason_code, r.reason_text) for r in got] == [("1004157005278", "NUT THINS", 66.0, 30.72, -2027.52, "6", "shortage")]


def test_promotion_text(spark):
    t = "$ 9.00 $ 9.00\nAssociated Promotions\n$ 1.00 $ 2.00 " + "x" * 80 + "\nfee ORAD  LATE; 21371\n$ 500.00 $ 400.00"
    df = spark.createDataFrame([(1, t), (2, "Associated Promotions coupon $ 1.00 $ 2.00"), (3, None), (4, "orad late $ 1.00 $ 2.00")], "doc_id long, text string")
    assert [tuple(r) for r in X.promotion_rows(df).collect()] == [(1, -500.0, "fee ORAD LATE; 21371")]
    assert X.promotion_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("said, kind", [('{"k": 1}', "1"), ('```json\n{"k": 2}\n```', "2"), ('"k": 3,', "3"), ('so: {"k": 4} ok', "4"), ("no", None), (None, None), ("", None)])
def test_json_repair(spark, said, kind):
    assert one(spark, F.get_json_object(X.repair_json(F.col("a")), "$.k"), a=said) == kind


def test_ladder_runs_dear_tiers_on_the_rest_only(spark):
    seen = []

    def dear(x):
        seen.append(x.count())
        return x.select("doc_id", F.lit(2).alias("n"))

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    got = tiers.ladder(df, "doc_id", [tiers.Tier("cheap", lambda x: x.where("text = 'a'").select("doc_id", F.lit(1).alias("n")), 0.9), tiers.Tier("dear", dear, 0.5)])
    assert sorted((r.doc_id, r.n, r.extraction_method) for r in got.collect()) == [(1, 1, "cheap"), (2, 2, "dear"), (3, 2, "dear")] and seen == [2]


def test_roll_ups(spark):
    d = spark.createDataFrame([(1, "sales_invoice", "a"), (1, "sales_invoice", "a"), (1, "proof_of_delivery", None)], "case_id long, doc_type string, path string")
    assert [tuple(r) for r in report.case_documents(d).collect()] == [(1, ["proof_of_delivery", "sales_invoice :: a"], ["bill_of_lading", "deduction_claim", "remittance_advice"], 3)]
    s = lambda a, b: one(spark, report.receiving_status(F.col("a").cast("double"), F.col("b").cast("double")), a=a, b=b)
    assert [s("1", "1"), s("2", "1"), s("1", "2"), s(None, "1"), s(None, None)] == ["full", "short", "over", "partial", "unread"]


@settings(deadline=None, max_examples=20)
@given(st.integers(0, 10**9))
def test_amounts_print_and_parse_back(cents):
    from pyspark.sql import SparkSession

    from ledgerlens.plans.case_texts import amount

    spark = SparkSession.getActiveSession()
    assert one(spark, E.parse_amount(amount(F.col("a"))), a=cents / 100) == pytest.approx(cents / 100, abs=0.005)


def test_stored_tables_are_discarded(spark):
    import os

    from ledgerlens.session import discard_stored, shared_folder, stored

    df = stored(spark.range(10).selectExpr("id", "id % 3 as part"), "part")
    assert df.where("part = 1").count() == 3 and df.columns == ["id", "part"]
    folder = shared_folder(spark).removeprefix("file:")
    assert any(n.startswith("table-") for n in os.listdir(folder))
    discard_stored(spark)
    assert not any(n.startswith("table-") for n in os.listdir(folder))
