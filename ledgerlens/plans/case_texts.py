"""Case documents printed as text from the trade tables, in the layouts that the extractors read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import digits
from ledgerlens.session import table


def cents(c: Column) -> Column:
    return F.floor(F.abs(c) * 100 + F.lit(0.5)).cast("bigint")


def money(c: Column) -> Column:
    """Two decimals, without sign, cut from whole cents."""
    n = cents(c)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def amount(c: Column) -> Column:
    """``money`` with separators of thousands."""
    n = cents(c)
    return F.concat(F.regexp_replace(F.floor(n / 100).cast("string"), r"(\d)(?=(\d{3})+$)", "$1,"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _material(c: Column) -> Column:
    d = F.regexp_replace(digits(F.coalesce(c, F.lit(""))), "^0+", "")
    return F.when(F.length(d) < 5, F.lpad(d, 5, "0")).otherwise(d)


def invoice_texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (invoice_id), text."""
    inv, il = table(spark, sf, "invoices"), table(spark, sf, "invoice_lines")
    promo = F.when(F.col("off_invoice_promo") != 0, F.concat(F.lit("\nOff Invoice Pro Qty "), amount(F.col("off_invoice_promo")), F.lit("- USD"))).otherwise("")
    row = F.concat(
        F.lpad((F.col("pos") * 10).cast("string"), 4, "0"), F.lit("  "), _material(F.col("material_number")), F.lit(" "), one_line(F.col("description")), F.lit("  "), F.col("quantity").cast("string"), F.lit(" EA  "),
        amount(F.col("unit_price")), F.lit("  "), amount(F.col("gross_value")), F.lit(" USD"), promo)
    rows = il.groupBy("invoice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "invoice_line_id", row.alias("t")))), lambda s: s["t"]), "\n").alias("rows"))
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    text = F.concat_ws(
        "\n", F.lit("Bill-To-Party"), line("Document Number ", F.col("invoice_number")), line("Document Date ", F.regexp_replace("invoice_date", "-", "/")), line("Purchase Order ", digits(F.col("po_number"))),
        line("Delivery Number ", digits(F.col("delivery_number"))), line("Carrier ", F.col("carrier")), line("Terms of Payment ", F.col("terms_of_payment")), F.col("rows"),
        F.when(F.col("subtotal").isNotNull(), F.concat(F.lit("Subtotal "), amount(F.col("subtotal")))), F.when(F.col("total_amount").isNotNull(), F.concat(F.lit("Total Amount "), amount(F.col("total_amount")))))
    return inv.join(rows, "invoice_id", "left").select(F.col("invoice_id").alias("doc_id"), text.alias("text"))


def bol_pages(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (bol_id), page_number, text; what a line lacks is printed as a dash."""
    sl = table(spark, sf, "shipped_lines")
    shown = lambda c: F.coalesce(c, F.lit("-"))
    row = F.concat_ws(
        " ", shown(F.nullif(F.when(F.regexp_replace(digits(F.col("material_number")), "^0+", "") != "", _material(F.col("material_number"))), F.lit(""))), F.concat(F.lit("X "), one_line(F.col("description"))), F.lpad((F.col("shipped_line_id") + 10_000_000).cast("string"), 9, "1"), shown(F.floor("cases").cast("string")), shown(amount(F.col("weight"))),
        shown(F.col("cases").cast("string")), F.concat(F.lit("S"), F.col("shipped_line_id").cast("string")))
    rows = sl.groupBy("bol_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shipped_line_id", row.alias("t")))), lambda s: s["t"]), "\n").alias("rows"))
    return rows.select(F.col("bol_id").alias("doc_id"), "page_number", F.concat(F.lit("STRAIGHT BILL OF LADING\n"), F.col("rows"), F.lit("\n")).alias("text"))


def pod_texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (pod_id), text."""
    pods = table(spark, sf, "pods")
    n = lambda c: F.floor(c).cast("string")
    text = F.concat_ws(
        "\n", F.lit("Proof of Delivery"), F.when(F.col("total_cases_shipped").isNotNull(), F.concat(F.lit("Total # of Cases on BOL "), n("total_cases_shipped"))),
        F.when(F.col("total_cases_received").isNotNull(), F.concat(F.lit("TOTAL # Of Cases RECVD "), n("total_cases_received"))), F.lit("Receiver signature"))
    return pods.select(F.col("pod_id").alias("doc_id"), text.alias("text"))


def remittance_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One payment row for each invoice and one credit memo for each claim with an amount: case_id, pos, seller_invoice_num, is_credit_memo, invoice_amount."""
    inv = table(spark, sf, "invoices").where("invoice_number is not null and total_amount is not null")
    cl = table(spark, sf, "claim_lines").where("case_id is not null and adj_amount is not null")
    memo = F.concat(F.when(F.col("claim_line_id") % 2 == 0, F.col("claim_invoice_number")).otherwise(F.lit("ADJ")), F.lit("-CM"))
    pay = inv.select("case_id", F.col("invoice_id").alias("pos"), F.col("invoice_number").alias("seller_invoice_num"), F.lit(False).alias("is_credit_memo"), F.col("total_amount").alias("invoice_amount"))
    return pay.union(cl.select("case_id", (F.col("claim_line_id") + 10_000_000).alias("pos"), F.coalesce(memo, F.lit("ADJ-CM")), F.lit(True), "adj_amount"))


def remittance_texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (case_id), text."""
    r = remittance_lines(spark, sf).withColumn("num", F.regexp_replace("seller_invoice_num", r"\s", ""))
    signed = lambda c: F.concat(F.lit("$"), amount(c), F.when(c < 0, "-").otherwise(""))
    row = F.concat_ws(" ", F.lpad((F.col("pos") % 90_000).cast("string"), 5, "0"), F.col("num"), signed(F.col("invoice_amount")), signed(F.col("invoice_amount")))
    detail = F.when(~F.col("is_credit_memo"), F.concat(F.lit("SELLER INVOICE NUM: "), F.col("num"), F.lit("\nTERMS DISC AMT: $"), money(F.col("invoice_amount") / 100)))
    per = r.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("t"), detail.alias("d")))).alias("rs"))
    rows = F.array_join(F.transform("rs", lambda s: s["t"]), "\n")
    details = F.array_join(F.filter(F.transform("rs", lambda s: s["d"]), lambda d: d.isNotNull()), "\n")
    return per.select(F.col("case_id").alias("doc_id"), F.concat(F.lit("REMITTANCE INFORMATION\n"), rows, F.lit("\n"), details, F.lit("\n")).alias("text"))


def claim_texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (claim_line_id), text: one row of deductions each; amounts that are missing leave their place empty, a quantity a dash."""
    cl = table(spark, sf, "claim_lines")
    shown = lambda c, none="": F.coalesce(c, F.lit(none))
    code = F.lpad(F.col("claim_line_id").cast("string"), 12, "7")
    text = F.concat(
        F.lit("Associated Deductions\nKROGER Invoice number: "), F.lpad(F.col("claim_id").cast("string"), 10, "0"), F.lit("\nDeduction amount ( - ) $ "), shown(amount(F.col("adj_amount"))), F.lit("\n"), code, F.lit("\nITEM NAME "),
        F.col("claim_line_id").cast("string"), F.lit("\n"), shown(F.floor("adj_qty").cast("bigint").cast("string"), "-"), F.lit(" $ "), shown(amount(F.col("unit_price"))), F.lit(" "), F.coalesce(F.col("reason_code"), F.lit("6")), F.lit("\n(-) $ "),
        shown(amount(F.col("adj_amount"))), F.lit(" shortage\n"))
    return cl.select(F.col("claim_line_id").alias("doc_id"), text.alias("text"))


def promotion_texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (claim_line_id), text: a header pair of amounts, far from the narrative, and the pair beside it where there is an amount."""
    cl = table(spark, sf, "claim_lines")
    text = F.concat(
        F.lit("Deductions\nAssociated Promotions\nTotal $ 1.00 $ 2.00 and a long line of column headers that stands between\nDEPOT ORAD LATE; claim "), F.col("claim_line_id").cast("string"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("$ "), amount(F.col("adj_amount")), F.lit(" $ "), amount(F.col("adj_amount"))), F.lit("no amount")), F.lit("\n"))
    return cl.select(F.col("claim_line_id").alias("doc_id"), text.alias("text"))


def case_files(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, doc_type, doc_id, path, extraction_confidence, extraction_method of all case documents."""
    parts = [("invoices", "sales_invoice", "invoice_id", F.col("source_path")), ("bols", "bill_of_lading", "bol_id", F.col("source_path")), ("pods", "proof_of_delivery", "pod_id", F.concat(F.lit("case_"), F.col("case_id").cast("string"), F.lit("/pod-"), F.col("pod_id").cast("string"), F.lit(".jpg")))]
    out = None
    for t, kind, i, path in parts:
        one = table(spark, sf, t).select("case_id", F.lit(kind).alias("doc_type"), F.col(i).alias("doc_id"), path.alias("path"), "extraction_confidence", "extraction_method")
        out = one if out is None else out.unionByName(one)
    return out
