"""Linking claimed lines to invoice, shipment and payment rows of their case.

All links are equi-joins on the case and a key derived from the condition (a code suffix, a cell of
prices, a number), so that no pairs of a case are formed that the condition cannot accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import description_tokens, digits, net_unit_price, round_to, upc_suffix

LEAST_SCORE = 0.3
#: Numbers up to this length are cut into all their pieces, by which a number inside another one is found.
LONGEST_NUMBER = 32


def line_score(upc: Column, claim_price: Column, claim_desc: Column, material: Column, gross: Column, net: Column, desc: Column) -> Column:
    """Score of a claimed line against an invoice line: code suffix, price and shared words, 1.0 at most."""
    suffix = upc_suffix(upc, material)
    code = F.when(suffix == "suffix5", 0.7).when(suffix == "suffix4", 0.45).otherwise(0.0)
    price = F.when(F.abs(claim_price - gross) < 0.01, 0.15).when(F.abs(claim_price - net) < 0.02, 0.3).otherwise(0.0)
    words = F.when(F.size(F.array_intersect(description_tokens(claim_desc), description_tokens(desc))) >= 2, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), code + price + words)


def best_invoice_lines(claims: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """The invoice line of the case with the highest score of LEAST_SCORE or more for each claimed line.

    claims: claim_line_id, case_id, upc, unit_price, description. Columns out: claim_line_id,
    invoice_line_id, score (three places). Ties go to the line with the smallest id. Only a code
    suffix or the net price can lift a line to the least score, so these are the join keys.
    A claim without a case, or with nothing that matches, has no row; nulls match nothing.
    """
    inv = invoice_lines.where(F.col("case_id").isNotNull()).select(
        "case_id", "invoice_line_id", "material_number", F.col("unit_price").alias("gross"), F.col("description").alias("inv_desc"),
        net_unit_price(F.col("unit_price"), F.col("quantity"), F.col("off_invoice_promo")).alias("net"), digits(F.col("material_number")).alias("m"),
    )
    m5 = F.when(F.length("m") < 5, F.lpad("m", 5, "0")).otherwise(F.col("m"))
    cell = lambda c, k=0: F.concat(F.lit("p"), (F.floor(c / 0.02) + k).cast("string"))
    inv_keys = F.array_compact(F.array(
        F.when(F.col("m") != "", F.concat(F.lit("f"), F.right(m5, F.lit(5)))), F.when(F.col("m") != "", F.concat(F.lit("t"), F.right(m5, F.lit(4)))), cell(F.col("net"))))
    cl = claims.where(F.col("case_id").isNotNull()).select("claim_line_id", "case_id", "upc", "unit_price", "description", digits(F.col("upc")).alias("u"))
    claim_keys = F.array_compact(F.array(
        F.when(F.length("u") >= 5, F.concat(F.lit("f"), F.right("u", F.lit(5)))), F.when(F.length("u") >= 4, F.concat(F.lit("t"), F.right("u", F.lit(4)))),
        *(cell(F.col("unit_price"), k) for k in (-1, 0, 1))))
    pairs = cl.withColumn("key", F.explode(claim_keys)).join(inv.withColumn("key", F.explode(inv_keys)), ["case_id", "key"])
    score = line_score(F.col("upc"), F.col("unit_price"), F.col("description"), F.col("material_number"), F.col("gross"), F.col("net"), F.col("inv_desc"))
    scored = pairs.select("claim_line_id", "invoice_line_id", score.alias("score")).where(F.col("score") >= LEAST_SCORE)
    best = scored.groupBy("claim_line_id").agg(F.max(F.struct("score", (-F.col("invoice_line_id")).alias("early"))).alias("b"))
    return best.select("claim_line_id", (-F.col("b.early")).alias("invoice_line_id"), round_to(F.col("b.score"), 3).alias("score"))


def shipped_for_claims(claims: DataFrame, invoice_matches: DataFrame, invoice_lines: DataFrame, shipped_lines: DataFrame) -> DataFrame:
    """Shipped lines of the primary shipment for each claimed line, with their cases summed.

    A shipped line belongs if its material is that of the matched invoice line, or the claim's
    code ends in its digits. Columns: claim_line_id, shipped_line_ids (ascending), bol_cases
    (null if no line has any). Claims without such a line have no row.
    """
    ship = shipped_lines.where(F.col("belongs_to_primary_shipment") & F.col("case_id").isNotNull() & F.col("material_number").isNotNull()).select(
        "case_id", "shipped_line_id", F.col("material_number").alias("ship_material"), "cases", digits(F.col("material_number")).alias("m"))
    m5 = F.when(F.length("m") < 5, F.lpad("m", 5, "0")).otherwise(F.col("m"))
    ship_keys = F.array_compact(F.array(
        F.concat(F.lit("="), "ship_material"), F.when(F.col("m") != "", F.concat(F.lit("f"), F.right(m5, F.lit(5)))), F.when(F.col("m") != "", F.concat(F.lit("t"), F.right(m5, F.lit(4))))))
    material = invoice_matches.join(invoice_lines.select("invoice_line_id", F.nullif("material_number", F.lit("")).alias("inv_material")), "invoice_line_id").select("claim_line_id", "inv_material")
    cl = claims.where(F.col("case_id").isNotNull()).select("claim_line_id", "case_id", digits(F.col("upc")).alias("u")).join(material, "claim_line_id", "left")
    claim_keys = F.array_compact(F.array(
        F.concat(F.lit("="), "inv_material"), F.when(F.length("u") >= 5, F.concat(F.lit("f"), F.right("u", F.lit(5)))), F.when(F.length("u") >= 4, F.concat(F.lit("t"), F.right("u", F.lit(4))))))
    pairs = cl.withColumn("key", F.explode(claim_keys)).join(ship.withColumn("key", F.explode(ship_keys)), ["case_id", "key"])
    once = pairs.select("claim_line_id", "shipped_line_id", "cases").dropDuplicates(["claim_line_id", "shipped_line_id"])
    return once.groupBy("claim_line_id").agg(F.array_sort(F.collect_list("shipped_line_id")).alias("shipped_line_ids"), F.sum("cases").alias("bol_cases"))


def credit_memos(claims: DataFrame, remittance_lines: DataFrame) -> DataFrame:
    """First credit memo of the case whose number contains the claim's invoice number, else the first one of its amount.

    claims: claim_line_id, case_id, claim_invoice_number, adj_amount; remittance_lines: case_id,
    pos, seller_invoice_num, is_credit_memo, invoice_amount. Columns out: claim_line_id,
    cm_pos, cm_amount, found_by. Claims without one have no row.
    """
    cm = remittance_lines.where("is_credit_memo").select("case_id", F.col("pos").alias("cm_pos"), F.col("seller_invoice_num").alias("num"), F.col("invoice_amount").alias("cm_amount"))
    cl = claims.where(F.col("case_id").isNotNull()).select("claim_line_id", "case_id", F.nullif("claim_invoice_number", F.lit("")).alias("wanted"), (-F.abs("adj_amount")).alias("owed"))
    memo = F.struct("cm_pos", "cm_amount")
    # by number: the first memo of each piece of a number; numbers too long to be cut into all pieces are compared in their case
    size = F.length("num")
    short = cm.where(size.between(1, LONGEST_NUMBER)).groupBy("case_id", "num").agg(F.min(memo).alias("m"))
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("num"), i, n)))))
    by_piece = short.select("case_id", "m", F.explode(pieces).alias("wanted")).groupBy("case_id", "wanted").agg(F.min("m").alias("m"))
    numbered = cl.where(F.col("wanted").isNotNull())
    found = numbered.join(by_piece, ["case_id", "wanted"]).select("claim_line_id", F.lit(1).alias("rank"), "m")
    long = cm.where(size > LONGEST_NUMBER).select("case_id", "num", memo.alias("m"))
    found = found.union(numbered.join(long, "case_id").where(F.col("num").contains(F.col("wanted"))).select("claim_line_id", F.lit(1), "m"))
    # by amount: cells of a hundredth, and their neighbours
    cell = lambda c, k=0: F.floor(c / 0.01) + k
    owed = cl.where(F.col("owed").isNotNull()).select("claim_line_id", "case_id", "owed", F.explode(F.array(*(cell(F.col("owed"), k) for k in (-1, 0, 1)))).alias("cell"))
    paid = cm.where(F.col("cm_amount").isNotNull()).groupBy("case_id", cell(F.col("cm_amount")).alias("cell"), "cm_amount").agg(F.min(memo).alias("m"))
    found = found.union(owed.join(paid, ["case_id", "cell"]).where(F.abs(F.col("cm_amount") - F.col("owed")) < 0.01).select("claim_line_id", F.lit(2), "m"))
    best = found.groupBy("claim_line_id").agg(F.min(F.struct("rank", "m")).alias("b"))
    return best.select("claim_line_id", "b.m.cm_pos", "b.m.cm_amount", F.when(F.col("b.rank") == 1, "number").otherwise("amount").alias("found_by"))


def best_documents(documents: DataFrame) -> DataFrame:
    """The document of each case and type with the highest extraction confidence; ties go to the first path, then the smallest id.

    documents: case_id, doc_type, doc_id, path, extraction_confidence. A null confidence is below
    all; null cases form a case of their own.
    """
    w = Window.partitionBy("case_id", "doc_type").orderBy(F.col("extraction_confidence").desc_nulls_last(), F.col("path"), F.col("doc_id"))
    return documents.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def number_disagrees(a: Column, b: Column) -> Column:
    """Whether two numbers, both given, differ beyond leading zeros."""
    strip = lambda c: F.ltrim(F.trim(c), F.lit("0"))
    return F.coalesce((F.trim(a) != "") & (F.trim(b) != "") & (strip(a) != strip(b)), F.lit(False))
