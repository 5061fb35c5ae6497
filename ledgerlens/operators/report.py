"""Roll-ups per case: documents seen and missing, receiving status, pages, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Documents that a case should have.
EXPECTED = ("bill_of_lading", "deduction_claim", "remittance_advice", "sales_invoice")


def case_documents(documents: DataFrame) -> DataFrame:
    """case_id, documents_seen ('type :: path', sorted), documents_missing (sorted), n_documents; documents: case_id, doc_type, path."""
    seen = F.array_sort(F.collect_set(F.concat_ws(" :: ", "doc_type", "path")))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, EXPECTED)), F.collect_set("doc_type")))
    return documents.groupBy("case_id").agg(seen.alias("documents_seen"), missing.alias("documents_missing"), F.count(F.lit(1)).alias("n_documents"))


def receiving_status(shipped: Column, received: Column) -> Column:
    """full, short or over if both counts are known, partial if one is, unread if none is."""
    return (
        F.when(shipped.isNotNull() & received.isNotNull(), F.when(received == shipped, "full").when(received < shipped, "short").otherwise("over"))
        .when(shipped.isNotNull() | received.isNotNull(), "partial").otherwise("unread")
    )


def lines_by_page(lines: DataFrame) -> DataFrame:
    """bol_id, page_number, n_lines, cases, is_other, first_pos: the pages of a bill in the order of their first line."""
    return lines.groupBy("bol_id", "page_number").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("cases").alias("cases"), F.max(~F.col("belongs_to_primary_shipment")).alias("is_other"), F.min("pos").alias("first_pos")
    )


def primary_totals(lines: DataFrame) -> DataFrame:
    """bol_id, total_cases (null for 0), pages (sorted) over the lines of the primary shipment."""
    own = F.col("belongs_to_primary_shipment")
    return lines.groupBy("bol_id").agg(F.nullif(F.sum(F.when(own, F.col("cases"))), F.lit(0.0)).alias("total_cases"), F.array_sort(F.collect_set("page_number")).alias("pages"))


def extraction_audit(documents: DataFrame) -> DataFrame:
    """doc_type, extraction_method, n, least, mean and greatest confidence."""
    c = F.col("extraction_confidence")
    return documents.groupBy("doc_type", "extraction_method").agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("least"), F.avg(c).alias("mean"), F.max(c).alias("greatest"))
