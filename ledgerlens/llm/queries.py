"""Queries of the operators for language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import address, entity_match, leakage, packing, reading
from ledgerlens.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [table(spark, sf_dir, t) for t in ("claim_lines", "invoices", "invoice_lines", "shipped_lines", "bols", "uom_codes")]
    return entity_match.match_items(*tables).select("claim_line_id", "target_table", "target_line_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [table(spark, sf_dir, t).select("ship_to").withColumnRenamed("ship_to", "text") for t in ("invoices", "bols")]
    return address.same_places(texts[0].unionByName(texts[1]))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(packing.token_sizes(table(spark, sf_dir, "documents"))).drop("loss_tokens")


def p6_container_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(p6_containers(spark, sf_dir))


#: Limits of which each binds on documents of the trade: instruction data with few and partly loss-bearing segments.
TIGHT = packing.PackingSettings(segments=6, loss_tokens=1536)


def p6_tight_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers under limits on segments and loss that bind before the tokens do."""
    return packing.limits_report(packing.pack_documents(packing.token_sizes(table(spark, sf_dir, "documents")), TIGHT), TIGHT)


def p6_container_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.packing_check(documents, packing.pack_documents(packing.token_sizes(documents)))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).select("doc_id", "reading_level")


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p6_containers": p6_containers, "p6_container_report": p6_container_report, "p6_container_check": p6_container_check,
    "p6_tight_containers": p6_tight_containers, "p7_found": p7_found, "p8_found": p8_found,
}

# what has to hold of any packing: every document is in it whole, none is split without need, no container exceeds a limit
ORACLES: dict[str, str] = {
    "p6_container_check": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_torn, CAST(0 AS BIGINT) AS n_needless_splits, CAST(0 AS BIGINT) AS n_over FROM documents",
}
