"""Case folders to tables: scan, decode, classify, extract, choose the best document, roll up, write.

One lazy plan over all cases; a case is the folder of its files, noise and project folders are
none. Texts of the same content are extracted once, by the tiers of their type: EDI, printed text,
recognised text, and a model for what is still open, if one is handed in. Recognition of scans and pictures is a tier that is handed in; files that get no
text, without one or from it, come out in a table of their own, ``unresolved``, and in the report
of their case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.extract import edi
from ledgerlens.extract import text as X
from ledgerlens.functions.exprs import readable_chars
from ledgerlens.operators.classify import classify_claim, classify_document
from ledgerlens.operators.match import best_documents, best_invoice_lines, credit_memos, shipped_for_claims
from ledgerlens.extract.tiers import Tier, ladder
from ledgerlens.operators.receiving import fold_receiving, other_shipment_pages
from ledgerlens.operators.report import EXPECTED, case_documents, primary_totals
from ledgerlens.session import cut
from ledgerlens.sources import files


def _edi(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"INVOIC0[12]")).select(F.col("doc_id").alias("idoc_id"), F.col("text").alias("payload"))


def _edi_or_text(of_edi: Callable, of_text: Callable) -> Callable:
    """Results of EDI messages that hold a goods line, by ``of_edi``; of all other documents by ``of_text``."""

    def run(docs: DataFrame) -> DataFrame:
        held = edi.idoc_lines(_edi(docs)).select(F.col("idoc_id").alias("doc_id")).distinct()
        got = of_edi(_edi(docs)).withColumnRenamed("idoc_id", "doc_id").join(held, "doc_id", "left_semi")
        return of_text(docs.join(held, "doc_id", "left_anti")).unionByName(got, allowMissingColumns=True)

    return run


def bol_lines(docs: DataFrame) -> DataFrame:
    """Shipped rows of each page of a text with its page marks, and whether they are of the primary shipment."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?:^|\n\n)\[page \d+\]\n")).alias("page_number", "text")).where("page_number > 0")
    head = parts.select("doc_id", "page_number", *(X.first_match(F.col("text"), X.BOL_HEADER[n]).alias(n) for n in ("bol_number", "po_number")), F.lit(None).cast("string").alias("ship_to"))
    return X.bol_rows(parts).join(other_shipment_pages(head), ["doc_id", "page_number"]).withColumn("belongs_to_primary_shipment", ~F.col("is_other")).drop("is_other")


def bol_heads(docs: DataFrame) -> DataFrame:
    total = primary_totals(bol_lines(docs).withColumnRenamed("doc_id", "bol_id")).select(F.col("bol_id").alias("doc_id"), "total_cases")
    return X.bol_headers(docs).join(total, "doc_id", "left")


def pods(docs: DataFrame) -> DataFrame:
    """Counts of the stamp, null where there are none, and the references of each receipt."""
    refs = docs.select("doc_id", *(X.first_match(F.col("text"), p).alias(f"referenced_{n.split('_')[0]}") for n, p in X.POD_REFERENCES.items()))
    return refs.join(X.pod_totals(docs), "doc_id", "left")


def claim_lines(docs: DataFrame) -> DataFrame:
    """Claimed rows with their type; of a claim without any the compliance row of its promotions.

    A single row without an amount takes the deduction amount of the header.
    """
    rows = X.claim_rows(docs)
    promo = X.promotion_rows(docs.join(rows.select("doc_id").distinct(), "doc_id", "left_anti"))
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    both = rows.unionByName(promo, allowMissingColumns=True).join(n, "doc_id", "left").join(X.claim_headers(docs).select("doc_id", "deduction_amount"), "doc_id")
    amount = F.coalesce("adj_amount", F.when(F.col("n") == 1, -F.abs("deduction_amount")))
    c = classify_claim(F.col("reason_code"), F.col("reason_text"), F.col("description"))
    return both.withColumn("adj_amount", amount).withColumn("claim_type", c["claim_type"]).drop("n", "deduction_amount")


#: Document type: its header and its row extractor.
EXTRACTORS: dict[str, tuple[Callable, Callable | None]] = {
    "sales_invoice": (_edi_or_text(edi.idoc_headers, X.invoice_headers), _edi_or_text(lambda d: edi.idoc_lines(d).withColumn("pos", F.col("line_seq")), X.invoice_rows)),
    "bill_of_lading": (bol_heads, bol_lines),
    "proof_of_delivery": (pods, None),
    "remittance_advice": (lambda d: d.select("doc_id", *(X.first_match(F.col("text"), p).alias(n) for n, p in X.REMITTANCE_HEADER.items())), X.remittance_rows),
    "deduction_claim": (X.claim_headers, claim_lines),
}
# Confidence of what a tier reads, by document type; what pictures gave is worth as much at most.
TEXT_CONFIDENCE = {"sales_invoice": 0.95, "bill_of_lading": 0.85, "proof_of_delivery": 0.75, "remittance_advice": 0.9, "deduction_claim": 0.9}
PICTURE_CONFIDENCE = {"sales_invoice": 0.8, "bill_of_lading": 0.8, "proof_of_delivery": 0.75, "remittance_advice": 0.85, "deduction_claim": 0.85}
EDI_CONFIDENCE, MODEL_CONFIDENCE = 0.92, 0.6


def tiers(kind: str, ask: Callable[[str, DataFrame], DataFrame] | None = None) -> list[Tier]:
    """The ladder of a document type over its rows, or its header where it has none: EDI for invoices, text, and ``ask(kind, docs)`` if given."""
    head, rows = EXTRACTORS[kind]
    text = Tier("text", rows or head, TEXT_CONFIDENCE[kind])
    if kind == "sales_invoice":
        message = Tier("edi", lambda d: edi.idoc_lines(_edi(d)).withColumnRenamed("idoc_id", "doc_id").withColumn("pos", F.col("line_seq")), EDI_CONFIDENCE)
        out = [message, Tier("text", X.invoice_rows, TEXT_CONFIDENCE[kind])]
    else:
        out = [text]
    return out if ask is None else [*out, Tier("model", lambda d: ask(kind, d), MODEL_CONFIDENCE)]


def _in_cases(spark: SparkSession, root: str, least_files: int) -> DataFrame:
    """The triaged files under ``root``; those outside case folders have a reason instead of a kind."""
    raw = files.read_files(spark, root).withColumn("below", F.ltrim(F.expr(f"substring(path, {len(root.removeprefix('file:').rstrip('/')) + 1})"), F.lit("/")))
    sorted_out = files.triage(raw)
    cases = files.case_folders(raw.select(F.col("below").alias("path")), least_files).select(F.col("folder").alias("_folder"), F.lit(True).alias("_case"))
    put = sorted_out.withColumn("_folder", files.folder(F.col("below"))).join(cases, "_folder", "left")
    outside = F.col("_case").isNull() & F.col("kind").isNotNull()
    return put.withColumns({"reason": F.when(outside, "not in a case folder").otherwise(F.col("reason")), "kind": F.when(~outside, F.col("kind"))}).drop("_folder", "_case", "below")


def documents(spark: SparkSession, root: str, read_pictures: Callable[[DataFrame], DataFrame] | None = None, least_files: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) of the files under ``root``.

    documents: doc_id, case_id (the folder), path, content_id, method ('text' or 'ocr'), text, doc_type, confidence. skipped: path, reason.
    ``read_pictures`` maps (path, content_id, content) of PDF and picture files to (path, content_id, text).
    Folders of noise and of projects, and those with fewer than ``least_files`` readable files, are no cases.
    """
    sorted_out = _in_cases(spark, root, least_files)
    texts = files.decoded(sorted_out.where("kind = 'text'")).withColumn("method", F.lit("text"))
    if read_pictures is not None:
        texts = texts.unionByName(read_pictures(sorted_out.where("kind in ('pdf', 'image')").select("path", "content_id", "content")).select("path", "content_id", "text", F.lit("ocr").alias("method")))
    paged = files.joined_pages(files.pages(texts), "path").select("path", F.col("full_text").alias("text"))
    d = texts.select("path", "content_id", "method").join(paged, "path")
    c = classify_document(F.col("text"), files.file_name(F.col("path")))
    out = d.select(F.xxhash64("path").alias("doc_id"), files.folder(F.col("path")).alias("case_id"), "path", "content_id", "method", "text", c.alias("c"))
    return out.select("doc_id", "case_id", "path", "content_id", "method", "text", "c.doc_type", "c.confidence"), sorted_out.where("reason is not null").select("path", "reason")


def unresolved(spark: SparkSession, root: str, docs: DataFrame, least_files: int = 1) -> DataFrame:
    """Readable files under ``root`` that are not in ``docs``: doc_id, case_id, path, content_id, kind, doc_type by the file name, confidence 0."""
    rest = _in_cases(spark, root, least_files).where("kind is not null").join(docs.select("path"), "path", "left_anti")
    c = classify_document(None, files.file_name(F.col("path")))
    return rest.select(F.xxhash64("path").alias("doc_id"), files.folder(F.col("path")).alias("case_id"), "path", "content_id", "kind", c["doc_type"].alias("doc_type"), F.lit(0.0).alias("confidence"))


def extract(docs: DataFrame, ask: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Header and row table of each document type; a content is read once and joined to every document that has it.

    With ``ask`` the rows come down the ladder of the type, with their method and confidence, and a
    model reads the documents that no other tier has rows of. Documents of an unknown type are in
    none of the tables but in one of their own, ``unknown``, as a stub.
    """
    out = {"unknown": docs.where("doc_type = 'unknown'").select("doc_id", "case_id", "path", F.lit(0.0).alias("extraction_confidence"))}
    for kind, (head, rows) in EXTRACTORS.items():
        if ask is not None and rows is not None:
            rows = lambda d, kind=kind: ladder(d, "doc_id", tiers(kind, ask))
        own = docs.where(F.col("doc_type") == kind)
        once = own.groupBy("content_id").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        back = own.select(F.col("doc_id").alias("own_id"), "case_id", "content_id").join(once.select("content_id", "doc_id"), "content_id").drop("content_id")
        for name, f in ((kind, head), (f"{kind}_lines", rows)):
            if f is not None:
                out[name] = f(once.select("doc_id", "text")).join(back, "doc_id").drop("doc_id").withColumnRenamed("own_id", "doc_id")
    return out


def _best(docs: DataFrame) -> DataFrame:
    by_type = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col("doc_type"))
    confidence = F.when(F.col("method") == "ocr", by_type(PICTURE_CONFIDENCE)).otherwise(by_type(TEXT_CONFIDENCE))
    scored = docs.withColumn("extraction_confidence", F.when(readable_chars(F.col("text")) > 0, confidence))
    return best_documents(scored.where("doc_type <> 'unknown'").select("case_id", "doc_type", "doc_id", "path", "extraction_confidence"))


def links(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Every claimed row of the best claim of a case with its invoice row, shipped rows and credit memo, from the best document of each type."""
    best = _best(docs).select("doc_id").distinct()

    def lines(kind: str, name: str, *place: str) -> DataFrame:
        d = tables[f"{kind}_lines"].join(best, "doc_id", "left_semi")
        return d.withColumn(name, F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", *place))))

    inv = lines("sales_invoice", "invoice_line_id", "idoc_seq", "pos")
    ship = lines("bill_of_lading", "shipped_line_id", "page_number", "pos")
    number = tables["deduction_claim"].select("doc_id", F.col("invoice_number").alias("claim_invoice_number"))
    claims = lines("deduction_claim", "claim_line_id", "pos", "upc").join(number, "doc_id", "left")
    matched = best_invoice_lines(claims, inv)
    out = claims.select("claim_line_id", "case_id", "doc_id", "pos", "upc", "claim_type", "adj_amount").join(matched, "claim_line_id", "left")
    out = out.join(inv.select("invoice_line_id", F.col("doc_id").alias("invoice_doc_id"), F.col("pos").alias("invoice_pos")), "invoice_line_id", "left")
    out = out.join(shipped_for_claims(claims, matched, inv, ship), "claim_line_id", "left")
    return out.join(credit_memos(claims, lines("remittance_advice", "remittance_line_id", "pos")), "claim_line_id", "left")


def receiving(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The receiving record of each case, folded over its receipts in the order of their paths."""
    p = tables["proof_of_delivery"].join(docs.select("doc_id", "path"), "doc_id")
    records = p.select(
        "case_id", "path", (F.col("shipped").isNotNull() | F.col("received").isNotNull()).alias("stamp"), "notes", F.col("shipped").cast("double").alias("shipped"), F.col("received").cast("double").alias("received"),
        F.coalesce("shortage", F.lit(False)).alias("shortage"), F.array().cast("array<string>").alias("exceptions"))
    return fold_receiving(records, "case_id", "path")


def reports(docs: DataFrame, skipped: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """One row per case of any file: documents seen and missing, the best document per type, warnings for skipped files.

    A type is missing if no document of it was read; files of ``unread`` stand in
    ``documents_unresolved`` ('type :: path', sorted), so that both can be told apart.
    """
    best = _best(docs)
    chosen = best.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", "path")))).alias("best"))
    warned = skipped.groupBy(files.folder(F.col("path")).alias("case_id")).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "reason"))).alias("warnings"))
    unread = docs.limit(0) if unread is None else unread
    open_ = unread.groupBy("case_id").agg(F.array_sort(F.collect_list(F.concat_ws(" :: ", "doc_type", "path"))).alias("documents_unresolved"))
    none = F.array().cast("array<string>")
    out = case_documents(docs.select("case_id", "doc_type", "path")).join(warned, "case_id", "full").join(open_, "case_id", "full").join(chosen, "case_id", "left")
    return out.select(
        "case_id", F.coalesce("documents_seen", none).alias("documents_seen"), F.coalesce("documents_missing", F.array(*map(F.lit, EXPECTED))).alias("documents_missing"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "best", "warnings", F.coalesce("documents_unresolved", none).alias("documents_unresolved"))


def run_cases(spark: SparkSession, root: str, out: str | None = None, read_pictures=None, ask=None, least_files: int = 1) -> dict[str, DataFrame]:
    """All tables of the cases under ``root``, written below ``out`` if given; see ``documents`` and ``extract``."""
    docs, skipped = documents(spark, root, read_pictures, least_files)
    docs = cut(docs)  # files are read, decoded and classified once, not once a table
    unread, found = unresolved(spark, root, docs, least_files), extract(docs, ask)
    tables = {"documents": docs, "skipped": skipped, "unresolved": unread, **found, "links": links(docs, found), "receiving": receiving(docs, found), "reports": reports(docs, skipped, unread)}
    if out is not None:
        for name, df in tables.items():
            write(df, f"{out}/{name}")
    return tables


def write(df: DataFrame, path: str, fmt: str = "parquet", key: str | None = None, parts: int = 64) -> None:
    """Overwrite ``path``; with ``key``, in a bounded number of folders by a hash of the key, so that a reader of some keys skips the others."""
    w = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).repartition("part").write.partitionBy("part") if key else df.write
    w.mode("overwrite").format(fmt).save(path)
