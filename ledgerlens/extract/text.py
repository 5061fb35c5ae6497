"""Table functions over document text: headers, printed rows and totals.

Every function takes a frame with ``doc_id`` and ``text`` (pages with ``page_number`` where said) and
works inside the row: texts are cut at row starts with look-ahead, so that only explode is needed
and nothing is shuffled but for the first-of-its-code rule of claim rows. Null and empty texts
give no rows (headers: null fields); repeated documents give their rows again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import first_match, number, parse_amount

# Labels and row formats of the documents.
INVOICE_HEADER = {
    "invoice_number": r"(?i)Document\s*Number\s+(\d+)",
    "invoice_date": r"(?i)Document\s*Date\s+([\d/]+)",
    "po_number": r"(?i)Purchase\s*Order\s+(\S+)",
    "delivery_number": r"(?i)Delivery\s*Number\s+(\S+)",
    "terms_of_payment": r"(?i)Terms\s*of\s*Payment\s+(\S.*)",
    "carrier": r"(?i)(?<!\S)Carrier\s+(\S.*)",
}
INVOICE_TOTALS = {"subtotal": r"(?i)Subtotal\s+([\d,]+\.\d{2})", "total_amount": r"(?i)Total\s*Amount\s+([\d,]+\.\d{2})"}
INVOICE_ROW = r"(?m)^\s*(\d{2,4})\s+(\d{4,6})([^\n]*?)\s+(\d+(?:\.\d+)?)\s*EA\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+USD\s*$"
PROMO = r"(?i)Off\s*Invoice\s*Pro\s*Qty\s+([\d,]+\.\d{2})-\s*USD"
BOL_HEADER = {
    "bol_number": r"(?i)BOL\s*NUMBER:?[^\d]*(\d{5,})",
    "pro_number": r"(?i)PRO\s*#:?\s*(\d{5,})",
    "po_number": r"(?i)Customer\s+PO\s*#:?\s*(\S+)",
    "ship_date": r"(?i)SHIP\s+DATE:?\s*\S*\s*([\d/]+)",
}
BOL_ROW = r"(?m)^\s*(\d{4,6})\s+(.+?)\s+(\d{8,})\s+(\d+(?:\.\d+)?)\s+([\d,]+\.\d+)\s+(\d+(?:\.\d+)?)\s+(\S+)\s*$"
_SHIPPED = r"(?:Total\s*#\s*of\s*Cases?\s*on\s*BOL|CASES\s*SHIPPED|CASES\s*ON\s*BOL)"
_RECEIVED = r"(?:TOTAL\s*#?\s*O?f?\s*Cases?\s*REC[VD']*D?|CASES\s*RECEIVED|REC[VD']?VD)"
POD_TOTALS = {
    "shipped": (rf"(?i){_SHIPPED}\D{{0,30}}(\d{{2,6}})", rf"(?i)(\d{{2,6}})\s*\n[^\n]{{0,20}}{_SHIPPED}"),
    "received": (rf"(?i){_RECEIVED}\D{{0,30}}(\d{{2,6}})", rf"(?i)(\d{{2,6}})\s*\n[^\n]{{0,20}}{_RECEIVED}"),
}
POD_SHORT, POD_OVER = r"(?i)Short[ \t]*[:\-]?[ \t]*(\d{1,6})\b", r"(?i)Over[ \t]*[:\-]?[ \t]*(\d{1,6})\b"
POD_REFERENCES = {"po_number": r"(?i)(?:PO|Customer\s*PO)\s*#?\s*[:\-]?\s*(\d{4,10})", "bol_number": r"(?i)BOL\s*(?:NUMBER|#|No)?\s*[:\-]?\s*(\d{4,12})"}
REMITTANCE_ROW = r"(?m)^\s*\d{5}\s+(\S+)\s+\$?([\d,]+\.\d{2})(-?)\s+\$?([\d,]+\.\d{2})(-?)\s*(?:\s+[A-Z]\b)?\s*$"
REMITTANCE_TERMS = r"(?s)SELLER INVOICE NUM:\s*(\S+).*?TERMS DISC AMT:\s*\$?([\d,.]+)"
REMITTANCE_HEADER = {"effective_date": r"(?i)EFFECTIVE\s+DATE:\s*([\d/]+)", "originator": r"(?i)ORIGINATOR:\s*(\S+)"}
CLAIM_HEADER = {
    "invoice_number": (r"(?i)KROGER\s+Invoice\s+number:\s*(\d+)", r"(?i)Invoice\s+number\s+(\d{7,})"),
    "po_number": (r"(?i)PO\s+Number\s+(\d[\d\-]{2,})\b", r"(?i)PO\s*Num(?:ber)?\s*[:#]?\s*(\d[\d\-]{2,})"),
}
CLAIM_AMOUNTS = {
    "deduction_amount": r"(?i)Deduction amount\s*\(\s*-\s*\)\s*\$\s*([\d,]+\.\d{2})",
    "gross_invoice_amount": r"(?i)Gross invoice amount\s*\(\s*\+\s*\)\s*\$\s*([\d,]+\.\d{2})",
    "net_invoice_amount": r"(?i)Net invoice amount\s*\(\s*\+\s*\)\s*\$\s*([\d,]+\.\d{2})",
    "discount_amount": r"(?i)Discount amount\s*\(\s*-\s*\)\s*\$\s*([\d,]+\.\d{2})",
}
UPC = r"\b(\d{11,14})\b"
QTY_PRICE = r"\b(\d{1,5})\s+\$\s*([\d,]+\.\d{2})\b"
ADJUSTMENTS = (r"\(-\)\s*\$\s*([\d,]+\.\d{2})", r"(?s)\(-\)\s*\$.*?([\d,]+,\d{3}\.\d{2})", r"(?m)^\s*([\d,]+\.\d{2})\s*\(shortage\)")
REASON = r"(?i)(Item\s*invoiced/?Not\s*received|shortage|pricing|compliance|damage|unsaleab)"
CODE_BEHIND_PRICE = r"\$\s*[\d,]+\.\d{2}\s+(\d{1,2})\b"
PROMOTIONS = r"(?i)\bAssociated\s+Promotions\b"
AMOUNT_PAIR = r"\$\s*([\d,]+\.\d{2})\s+\$\s*([\d,]+\.\d{2})"
COMPLIANCE = r"(?i)(orad\s*(?:late|date)|on[\s-]?time\s+in[\s-]?full|otif|late\s+delivery|missed\s+appointment|routing\s+violation|asn\s+(?:fail|error)|edi\s+(?:fail|error)|compliance\s+fee)"

LINES_BEFORE, LINES_BEHIND, NAME_LINES = 6, 11, 3


def _columns(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [first_match(text, p).alias(n) for n, p in patterns.items()]


def invoice_headers(docs: DataFrame) -> DataFrame:
    """doc_id, the six header fields, subtotal and total."""
    t = F.col("text")
    return docs.select("doc_id", *_columns(t, INVOICE_HEADER), *(number(first_match(t, p)).alias(n) for n, p in INVOICE_TOTALS.items()))


def _chunks(text: Column, row: str) -> Column:
    """The text cut before each line that is a row; each chunk that starts with one goes up to the next."""
    return F.filter(F.split(text, rf"(?m)(?={row[4:]})"), lambda c: c.rlike(row))


def invoice_rows(docs: DataFrame) -> DataFrame:
    """Item rows with the first promotion printed between an item and the next: doc_id, pos and the columns of a row."""
    at = docs.select("doc_id", F.posexplode(_chunks(F.col("text"), INVOICE_ROW)).alias("i", "c"))
    g = lambda n: F.regexp_extract("c", INVOICE_ROW, n)
    promo = number(first_match(F.col("c"), PROMO))
    return at.select(
        "doc_id", (F.col("i") + 1).alias("pos"), g(1).alias("line_no"), g(2).alias("material_number"), F.nullif(F.trim(g(3)), F.lit("")).alias("description"),
        number(g(4)).alias("quantity"), number(g(5)).alias("unit_price"), number(g(6)).alias("gross_value"), F.when(promo != 0, -promo).alias("off_invoice_promo"),
    )


def _rows(text: Column, row: str, groups: int) -> Column:
    """All rows as an array of structs of their groups."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(row), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)))


def bol_rows(pages: DataFrame) -> DataFrame:
    """Shipped rows of each page: doc_id, page_number, pos on the page and the columns of a row."""
    at = pages.select("doc_id", "page_number", F.posexplode(_rows(F.col("text"), BOL_ROW, 7)).alias("i", "r"))
    return at.select(
        "doc_id", "page_number", (F.col("i") + 1).alias("pos"), F.col("r.g1").alias("material_number"), F.trim("r.g2").alias("description"), number(F.col("r.g5")).alias("weight"),
        number(F.col("r.g6")).alias("cases"), F.col("r.g7").alias("customer_sku"),
    )


def bol_headers(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_columns(F.col("text"), BOL_HEADER))


def pod_totals(docs: DataFrame) -> DataFrame:
    """Counts of a receiving stamp: doc_id, shipped, received, short, over, notes, shortage; only texts with a count.

    A number behind its label counts before one in the line above; a count of 0 falls through to the next place.
    """
    t = F.col("text")
    either = lambda ps: F.coalesce(F.nullif(first_match(t, ps[0]).try_cast("int"), F.lit(0)), first_match(t, ps[1]).try_cast("int"))
    x = docs.select("doc_id", *(either(p).alias(n) for n, p in POD_TOTALS.items()), first_match(t, POD_SHORT).try_cast("int").alias("short"), first_match(t, POD_OVER).try_cast("int").alias("over"))
    said = lambda label, c: F.when(F.col(c).isNotNull() & ((F.col(c) != 0) if c in ("short", "over") else F.lit(True)), F.concat(F.lit(label), F.col(c).cast("string")))
    notes = F.concat_ws("; ", said("Cases on BOL: ", "shipped"), said("Cases received: ", "received"), said("Short: ", "short"), said("Over: ", "over"))
    short = F.coalesce(F.col("received") < F.col("shipped"), F.lit(False)) | F.coalesce(F.col("short") > 0, F.lit(False))
    return x.where(F.col("shipped").isNotNull() | F.col("received").isNotNull()).select("*", notes.alias("notes"), short.alias("shortage"))


def remittance_rows(docs: DataFrame) -> DataFrame:
    """Payment rows with their terms discount: doc_id, pos, seller_invoice_num, is_credit_memo, invoice_amount, net_amount_paid, terms_discount.

    Of several discounts of one number the last counts.
    """
    t = F.col("text")
    at = docs.select("doc_id", _rows(t, REMITTANCE_TERMS, 2).alias("terms"), F.posexplode(_rows(t, REMITTANCE_ROW, 5)).alias("i", "r"))
    own = F.filter("terms", lambda x: x["g1"] == F.col("r.g1"))
    signed = lambda v, s: F.when(F.col(s) == "-", -number(F.col(v))).otherwise(number(F.col(v)))
    return at.select(
        "doc_id", (F.col("i") + 1).alias("pos"), F.col("r.g1").alias("seller_invoice_num"), F.col("r.g1").contains("-CM").alias("is_credit_memo"), signed("r.g2", "r.g3").alias("invoice_amount"),
        signed("r.g4", "r.g5").alias("net_amount_paid"), number(F.try_element_at(own, F.lit(-1))["g2"]).alias("terms_discount"),
    )


def claim_headers(docs: DataFrame) -> DataFrame:
    """doc_id, invoice and order number with their second places, and the four amounts."""
    t = F.col("text")
    return docs.select(
        "doc_id", *(F.coalesce(*(first_match(t, p) for p in ps)).alias(n) for n, ps in CLAIM_HEADER.items()), *(parse_amount(first_match(t, p)).alias(n) for n, p in CLAIM_AMOUNTS.items())
    )


def claim_rows(docs: DataFrame) -> DataFrame:
    """Claimed rows around item codes: doc_id, pos, upc, description, adj_qty, unit_price, adj_amount, reason_code, reason_text.

    Around each line with a code of 11 to 14 digits a window of lines is read; it must name a
    reason. Of a code that comes again in a document the first accepted one counts.
    """
    lines = F.split(F.regexp_replace("text", r"\r\n|\r|\x0b|\x0c|\x1c|\x1d|\x1e|\x85| | ", "\n"), "\n")
    at = docs.select("doc_id", lines.alias("ls"), F.posexplode(lines).alias("i", "line")).withColumn("upc", first_match(F.col("line"), UPC)).where(F.col("upc").isNotNull())
    upto = lambda a, b: F.slice("ls", F.greatest(F.lit(1), F.col("i") + 1 - a), F.col("i") + 1 + b - F.greatest(F.lit(1), F.col("i") + 1 - a) + 1)
    near = at.select("doc_id", "i", "upc", F.array_join(upto(LINES_BEFORE, LINES_BEHIND), "\n").alias("w"), upto(NAME_LINES, NAME_LINES).alias("around")).where(F.col("w").rlike(REASON))
    w = F.col("w")
    names = F.slice(F.transform(F.filter("around", lambda x: ~x.rlike(UPC) & F.trim(x).rlike(r"^[A-Z0-9 \-/\.]{3,}$")), lambda x: F.trim(x)), 1, 3)
    amount = F.coalesce(*(number(first_match(w, p)) for p in ADJUSTMENTS))
    parsed = near.select(
        "doc_id", "upc", F.col("i").alias("pos"), F.nullif(F.array_join(names, " "), F.lit("")).alias("description"), number(first_match(w, QTY_PRICE, 1)).alias("adj_qty"),
        number(first_match(w, QTY_PRICE, 2)).alias("unit_price"), (-amount).alias("adj_amount"), first_match(w, CODE_BEHIND_PRICE).alias("reason_code"), first_match(w, REASON).alias("reason_text"),
    )
    rest = [c for c in parsed.columns if c not in ("doc_id", "upc")]
    return parsed.groupBy("doc_id", "upc").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "upc", "r.*")


def promotion_rows(docs: DataFrame) -> DataFrame:
    """The compliance row of a promotions section: doc_id, adj_amount, reason_text.

    The pair of amounts nearest to the narrative by characters counts, of ties the smaller one;
    offsets need Python's matches, which run over Arrow batches of the documents that have a section.
    """
    section, story, pair = re.compile(PROMOTIONS), re.compile(COMPLIANCE), re.compile(AMOUNT_PAIR)

    def one(text: str):
        head = section.search(text)
        told = head and story.search(text, head.start())
        if not told:
            return None
        money = [tuple(float(x.replace(",", "")) for x in m.groups()) for m in pair.finditer(text, head.start())]
        where = [m.start() for m in pair.finditer(text, head.start())]
        if not where:
            return None
        _, (bill, accrued) = min(((abs(p - told.start()), a) for p, a in zip(where, money)))
        if not (bill or accrued):
            return None
        line = text[: told.end()].rpartition("\n")[2] if "\n" not in told[0] else told[0]
        line += text[told.end() :].partition("\n")[0]
        return -abs(bill or accrued), " ".join(line.split())

    def run(batches):
        for pdf in batches:
            got = [(i, r) for i, t in zip(pdf["doc_id"], pdf["text"]) if (r := one(t))]
            if not got:
                continue
            yield pd.DataFrame({"doc_id": [i for i, _ in got], "adj_amount": [r[0] for _, r in got], "reason_text": [r[1] for _, r in got]})

    kept = docs.where(F.col("text").rlike(PROMOTIONS)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInPandas(run, "doc_id long, adj_amount double, reason_text string")


def repair_json(c: Column) -> Column:
    """The object in a text that should be JSON, as JSON text: whole, fenced, without its braces, or embedded; null if none is.

    The empty text is '{}'.
    """
    s = F.trim(c)
    bare = F.trim(F.regexp_replace(F.regexp_replace(s, r"^`+(?i:json)?", ""), r"`+$", ""))
    body = F.when(bare.contains(":") & ~bare.startswith("{"), F.concat(F.lit("{"), F.regexp_replace(bare, r"[,\s]+$", ""), F.lit("}")))
    inner = first_match(bare, r"(?s)(\{.*\})")
    # the parser stops behind a first value, so that both ends have to be those of one object or list;
    # one filter over the candidates keeps the code of the projection small
    ok = lambda x: F.trim(x).rlike(r"(?s)^(\{.*\}|\[.*\])$") & F.try_parse_json(x).isNotNull()
    return F.when(F.coalesce(c, F.lit("")) == "", "{}").otherwise(F.try_element_at(F.filter(F.array(c, bare, body, inner), ok), F.lit(1)))
