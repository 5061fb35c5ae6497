"""Queries of the case operators over the trade tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.extract import edi, tiers
from ledgerlens.extract import text as X
from ledgerlens.functions import exprs as E
from ledgerlens.operators import classify, match, receiving, report
from ledgerlens.operators.orphans import utc_clock
from ledgerlens.plans import case_texts as T
from ledgerlens.session import table
from ledgerlens.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# ---- classification

_CONTENT = ", ".join(f"({k}, {_quote(p)}, '{t}', {s})" for k, (p, t, s) in enumerate(classify.CONTENT_RULES))
_NAMES = ", ".join(f"({k}, {_quote(p)}, '{t}', {s * 0.9!r})" for k, (p, t, s) in enumerate(classify.FILENAME_RULES))


def _rule_sql(source: str, ident: str, text: str, rules: str) -> str:
    return f"""
WITH rules(k, pattern, kind, strength) AS (VALUES {rules}),
hits AS (SELECT d.{ident} AS id, r.kind, max(CAST(r.strength AS DOUBLE)) AS s, min(r.k) AS k FROM {source} d JOIN rules r ON regexp_matches(d.{text}, r.pattern) GROUP BY 1, 2),
best AS (SELECT id, kind, s FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, k) = 1)
SELECT d.{ident} AS doc_id, coalesce(b.kind, 'unknown') AS doc_kind, coalesce(b.s, 0.2e0) AS confidence FROM {source} d LEFT JOIN best b ON b.id = d.{ident}"""


@query(_rule_sql("documents", "doc_id", "text", _CONTENT))
def doc_classification(spark: SparkSession, sf: str) -> DataFrame:
    c = classify.classify_document(F.col("text"), None)
    return table(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", F.col("c.doc_type").alias("doc_kind"), "c.confidence")


@query(_rule_sql("(SELECT invoice_id, source_path AS path FROM invoices UNION ALL SELECT -bol_id, source_path FROM bols)", "invoice_id", "path", _NAMES))
def filename_classification(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "invoices").select(F.col("invoice_id").alias("doc_id"), "source_path").union(table(spark, sf, "bols").select(-F.col("bol_id"), "source_path"))
    c = classify.classify_document(None, F.col("source_path"))
    return f.select("doc_id", c.alias("c")).select("doc_id", F.col("c.doc_type").alias("doc_kind"), "c.confidence")


_HAY = "concat_ws(' ', reason_text, description)"
_CODES = " ".join(f"WHEN trim(reason_code) = '{k}' THEN '{v}'" for k, v in classify.CODE_TYPES.items())
_STORY = " ".join(f"WHEN regexp_matches({_HAY}, {_quote(p)}) THEN '{t}'" for t, p in classify.NARRATIVES)
_SURE = " ".join(f"WHEN regexp_matches({_HAY}, {_quote(p)}) THEN CASE WHEN coalesce(regexp_matches(reason_text, {_quote(p)}), false) THEN 0.82e0 ELSE 0.75e0 END" for t, p in classify.NARRATIVES)


@query(f"""SELECT claim_line_id, CASE {_CODES} WHEN trim({_HAY}) = '' THEN 'unknown' {_STORY} ELSE 'unknown' END AS claim_type,
CASE WHEN trim(reason_code) IN ({", ".join(map(_quote, classify.CODE_TYPES))}) THEN 0.92e0 WHEN trim({_HAY}) = '' THEN 0e0 {_SURE} ELSE 0.15e0 END AS confidence FROM claim_lines""")
def claim_types(spark: SparkSession, sf: str) -> DataFrame:
    c = classify.classify_claim(F.col("reason_code"), F.col("reason_text"), F.col("description"))
    return table(spark, sf, "claim_lines").select("claim_line_id", c.alias("c")).select("claim_line_id", "c.claim_type", "c.confidence")


# ---- matching

_D = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
_M5 = f"CASE WHEN length({_D('i.material_number')}) < 5 THEN lpad({_D('i.material_number')}, 5, '0') ELSE {_D('i.material_number')} END"
_SUFFIX = f"""CASE WHEN {_D('c.upc')} = '' OR {_D('i.material_number')} = '' THEN NULL WHEN ends_with({_D('c.upc')}, right({_M5}, 5)) THEN 'suffix5' WHEN ends_with({_D('c.upc')}, right({_M5}, 4)) THEN 'suffix4' END"""
_NET = "CASE WHEN coalesce(i.quantity, 0) = 0 OR i.off_invoice_promo IS NULL THEN i.unit_price ELSE sign(i.unit_price - abs(i.off_invoice_promo) / i.quantity) * floor(abs(i.unit_price - abs(i.off_invoice_promo) / i.quantity) * 1e6 + 0.5e0) / 1e6 END"
_TOK = lambda c: f"list_distinct(list_filter(string_split_regex(trim(translate(upper(coalesce({c}, '')), '&-/,.', '     ')), '\\s+'), lambda w: w <> ''))"
_SCORED = f"""
pairs AS (SELECT c.claim_line_id, i.invoice_line_id, i.material_number, least(1e0,
  CASE {_SUFFIX} WHEN 'suffix5' THEN 0.7e0 WHEN 'suffix4' THEN 0.45e0 ELSE 0e0 END
  + CASE WHEN abs(c.unit_price - i.unit_price) < 0.01e0 THEN 0.15e0 WHEN abs(c.unit_price - ({_NET})) < 0.02e0 THEN 0.3e0 ELSE 0e0 END
  + CASE WHEN len(list_intersect({_TOK('c.description')}, {_TOK('i.description')})) >= 2 THEN 0.05e0 ELSE 0e0 END) AS s
  FROM claim_lines c JOIN invoice_lines i ON i.case_id = c.case_id),
best AS (SELECT * FROM pairs WHERE s >= 0.3e0 QUALIFY row_number() OVER (PARTITION BY claim_line_id ORDER BY s DESC, invoice_line_id) = 1)"""


@query(f"SELECT i.invoice_line_id, {_NET} AS net_unit_price FROM invoice_lines i")
def net_unit_price(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "invoice_lines").select("invoice_line_id", E.net_unit_price(F.col("unit_price"), F.col("quantity"), F.col("off_invoice_promo")).alias("net_unit_price"))


@query(f"WITH {_SCORED} SELECT claim_line_id, invoice_line_id, floor(s * 1000 + 0.5e0) / 1000 AS score FROM best")
def best_invoice_match(spark: SparkSession, sf: str) -> DataFrame:
    return match.best_invoice_lines(table(spark, sf, "claim_lines"), table(spark, sf, "invoice_lines"))


@query(f"SELECT c.claim_line_id, i.invoice_line_id, {_SUFFIX} AS suffix_kind FROM claim_lines c JOIN invoice_lines i ON i.case_id = c.case_id WHERE ({_SUFFIX}) IS NOT NULL")
def upc_suffix_match(spark: SparkSession, sf: str) -> DataFrame:
    # the last four digits decide either kind, so they are the key
    c = table(spark, sf, "claim_lines").select("claim_line_id", "case_id", "upc", F.right(E.digits(F.col("upc")), F.lit(4)).alias("k"))
    m = E.digits(F.col("material_number"))
    i = table(spark, sf, "invoice_lines").where(m != "").select("invoice_line_id", "case_id", "material_number", F.right(F.lpad(m, F.greatest(F.lit(5), F.length(m)), F.lit("0")), F.lit(4)).alias("k"))
    return c.join(i, ["case_id", "k"]).select("claim_line_id", "invoice_line_id", E.upc_suffix(F.col("upc"), F.col("material_number")).alias("suffix_kind")).where("suffix_kind is not null")


@query(f"SELECT claim_line_id, len({_TOK('description')}) AS n_words, list_sort({_TOK('description')}) AS words FROM claim_lines")
def description_words(spark: SparkSession, sf: str) -> DataFrame:
    t = E.description_tokens(F.col("description"))
    return table(spark, sf, "claim_lines").select("claim_line_id", F.size(t).cast("long").alias("n_words"), F.array_sort(t).alias("words"))


@query(f"""WITH {_SCORED}, hit AS (SELECT c.claim_line_id, s.shipped_line_id, s.cases FROM claim_lines c JOIN shipped_lines s ON s.case_id = c.case_id LEFT JOIN best b ON b.claim_line_id = c.claim_line_id
WHERE s.belongs_to_primary_shipment AND s.material_number IS NOT NULL AND (coalesce(nullif(b.material_number, '') = s.material_number, false) OR ({_SUFFIX.replace('i.', 's.')}) IS NOT NULL))
SELECT claim_line_id, list(shipped_line_id ORDER BY shipped_line_id) AS shipped_line_ids, sum(cases) AS bol_cases FROM hit GROUP BY 1""")
def bol_match_cases(spark: SparkSession, sf: str) -> DataFrame:
    c, i = table(spark, sf, "claim_lines"), table(spark, sf, "invoice_lines")
    return match.shipped_for_claims(c, match.best_invoice_lines(c, i), i, table(spark, sf, "shipped_lines"))


_REMIT = """remit AS (SELECT case_id, invoice_id AS pos, invoice_number AS num, false AS cm, total_amount AS amount FROM invoices WHERE invoice_number IS NOT NULL AND total_amount IS NOT NULL
UNION ALL SELECT case_id, claim_line_id + 10000000, coalesce(CASE WHEN claim_line_id % 2 = 0 THEN claim_invoice_number ELSE 'ADJ' END || '-CM', 'ADJ-CM'), true, adj_amount FROM claim_lines WHERE case_id IS NOT NULL AND adj_amount IS NOT NULL)"""


@query(f"""WITH {_REMIT}, r AS (SELECT c.claim_line_id, m.pos AS cm_pos, m.amount AS cm_amount,
CASE WHEN c.claim_invoice_number <> '' AND contains(m.num, c.claim_invoice_number) THEN 1 WHEN abs(m.amount + abs(c.adj_amount)) < 0.01e0 THEN 2 END AS rank FROM claim_lines c JOIN remit m ON m.case_id = c.case_id AND m.cm)
SELECT claim_line_id, cm_pos, cm_amount, CASE rank WHEN 1 THEN 'number' ELSE 'amount' END AS found_by FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim_line_id ORDER BY rank, cm_pos) = 1""")
def remittance_cm_match(spark: SparkSession, sf: str) -> DataFrame:
    return match.credit_memos(table(spark, sf, "claim_lines"), T.remittance_lines(spark, sf))


_FILES = """f AS (SELECT case_id, 'sales_invoice' AS doc_type, invoice_id AS doc_id, source_path AS path, extraction_confidence AS conf, extraction_method AS method FROM invoices
UNION ALL SELECT case_id, 'bill_of_lading', bol_id, source_path, extraction_confidence, extraction_method FROM bols
UNION ALL SELECT case_id, 'proof_of_delivery', pod_id, concat('case_', case_id, '/pod-', pod_id, '.jpg'), extraction_confidence, extraction_method FROM pods)"""


@query(f"WITH {_FILES} SELECT case_id, doc_type, doc_id, path, conf AS extraction_confidence FROM f QUALIFY row_number() OVER (PARTITION BY case_id, doc_type ORDER BY conf DESC NULLS LAST, path, doc_id) = 1")
def best_document_per_type(spark: SparkSession, sf: str) -> DataFrame:
    return match.best_documents(T.case_files(spark, sf)).select("case_id", "doc_type", "doc_id", "path", "extraction_confidence")


@query("""SELECT c.claim_line_id, count(*) AS n_invoices, bool_and(trim(c.claim_invoice_number) <> '' AND trim(i.invoice_number) <> '' AND ltrim(trim(c.claim_invoice_number), '0') <> ltrim(trim(i.invoice_number), '0')) AS all_disagree
FROM claim_lines c JOIN invoices i ON i.case_id = c.case_id WHERE c.claim_invoice_number IS NOT NULL AND i.invoice_number IS NOT NULL GROUP BY 1""")
def invoice_number_crosscheck(spark: SparkSession, sf: str) -> DataFrame:
    # the invoices of a case collapse to their distinct numbers before they meet its claims
    i = table(spark, sf, "invoices").where("invoice_number is not null").groupBy("case_id", "invoice_number").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "claim_lines").where("claim_invoice_number is not null").select("claim_line_id", "case_id", "claim_invoice_number")
    odd = match.number_disagrees(F.col("claim_invoice_number"), F.col("invoice_number"))
    return c.join(i, "case_id").groupBy("claim_line_id").agg(F.sum("n").alias("n_invoices"), F.min(odd).alias("all_disagree"))


@query(f"""SELECT c.claim_line_id, c.case_id, b.invoice_line_id, coalesce(floor(b.s * 1000 + 0.5e0) / 1000, 0e0) AS score, s.bol_cases, m.found_by AS memo_found_by, m.cm_amount AS memo_amount, x.all_disagree AS number_disagrees
FROM claim_lines c LEFT JOIN (WITH {_SCORED} SELECT claim_line_id, invoice_line_id, s FROM best) b ON b.claim_line_id = c.claim_line_id LEFT JOIN ({ORACLES['bol_match_cases']}) s ON s.claim_line_id = c.claim_line_id
LEFT JOIN ({ORACLES['remittance_cm_match']}) m ON m.claim_line_id = c.claim_line_id LEFT JOIN ({ORACLES['invoice_number_crosscheck']}) x ON x.claim_line_id = c.claim_line_id""")
def flagship_linked_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Every claimed line with its invoice line, the cases shipped, its credit memo and whether all invoices of the case have another number."""
    c, i = table(spark, sf, "claim_lines"), table(spark, sf, "invoice_lines")
    best = match.best_invoice_lines(c, i)
    memo = match.credit_memos(c, T.remittance_lines(spark, sf)).select("claim_line_id", F.col("found_by").alias("memo_found_by"), F.col("cm_amount").alias("memo_amount"))
    shipped = match.shipped_for_claims(c, best, i, table(spark, sf, "shipped_lines")).select("claim_line_id", "bol_cases")
    number = invoice_number_crosscheck(spark, sf).select("claim_line_id", F.col("all_disagree").alias("number_disagrees"))
    out = c.select("claim_line_id", "case_id").join(best, "claim_line_id", "left")
    for more in (shipped, memo, number):
        out = out.join(more, "claim_line_id", "left")
    return out.select("claim_line_id", "case_id", "invoice_line_id", F.coalesce("score", F.lit(0.0)).alias("score"), "bol_cases", "memo_found_by", "memo_amount", "number_disagrees")


# ---- extraction: printed from the tables, read back

_C = lambda c: f"floor(abs({c}) * 100 + 0.5e0) / 100"


@query(f"""SELECT invoice_id AS doc_id, invoice_number, nullif(regexp_extract(replace(invoice_date, '-', '/'), '^[0-9/]+'), '') AS invoice_date, nullif({_D('po_number')}, '') AS po_number, nullif({_D('delivery_number')}, '') AS delivery_number,
terms_of_payment, carrier, {_C('subtotal')} AS subtotal, {_C('total_amount')} AS total_amount FROM invoices""")
def invoice_header_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of all invoices; a date that is printed in words is not read."""
    return X.invoice_headers(T.invoice_texts(spark, sf))


_MAT = f"ltrim({_D('coalesce(material_number, chr(32))')}, '0')"


@query(f"""SELECT invoice_id AS doc_id, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY pos, invoice_line_id) AS INT) AS pos, lpad(CAST(pos * 10 AS VARCHAR), 4, '0') AS line_no,
CASE WHEN length({_MAT}) < 5 THEN lpad({_MAT}, 5, '0') ELSE {_MAT} END AS material_number, nullif(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')), '') AS description, quantity,
{_C('unit_price')} AS unit_price, {_C('gross_value')} AS gross_value, CASE WHEN {_C('off_invoice_promo')} <> 0 THEN -({_C('off_invoice_promo')}) END AS off_invoice_promo FROM invoice_lines""")
def invoice_lines_parse(spark: SparkSession, sf: str) -> DataFrame:
    return X.invoice_rows(T.invoice_texts(spark, sf))


@query(f"""SELECT bol_id AS doc_id, page_number, CAST(row_number() OVER (PARTITION BY bol_id, page_number ORDER BY pos, shipped_line_id) AS INT) AS pos, CASE WHEN length({_MAT}) < 5 THEN lpad({_MAT}, 5, '0') ELSE {_MAT} END AS material_number,
trim('X ' || trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS description, {_C('weight')} AS weight, cases, concat('S', shipped_line_id) AS customer_sku
FROM shipped_lines WHERE weight IS NOT NULL AND cases IS NOT NULL AND {_MAT} <> ''""")
def bol_lines_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all bills; a row that lacks material, weight or cases is none."""
    return X.bol_rows(T.bol_pages(spark, sf))


@query("""WITH p AS (SELECT pod_id, CASE WHEN floor(total_cases_shipped) BETWEEN 10 AND 999999 THEN CAST(floor(total_cases_shipped) AS INT) END AS shipped,
CASE WHEN floor(total_cases_received) BETWEEN 10 AND 999999 THEN CAST(floor(total_cases_received) AS INT) WHEN total_cases_received IS NOT NULL AND floor(total_cases_shipped) BETWEEN 10 AND 999999 THEN CAST(floor(total_cases_shipped) AS INT) END AS received FROM pods)
SELECT pod_id AS doc_id, shipped, received, CAST(NULL AS INT) AS short, CAST(NULL AS INT) AS over, concat_ws('; ', 'Cases on BOL: ' || shipped, 'Cases received: ' || received) AS notes, coalesce(received < shipped, false) AS shortage
FROM p WHERE shipped IS NOT NULL OR received IS NOT NULL""")
def pod_totals_parse(spark: SparkSession, sf: str) -> DataFrame:
    return X.pod_totals(T.pod_texts(spark, sf))


@query(f"""WITH {_REMIT}, k AS (SELECT case_id, pos, regexp_replace(num, '\\s', '', 'g') AS num, cm, amount FROM remit),
terms AS (SELECT case_id, num, floor(abs(amount / 100) * 100 + 0.5e0) / 100 AS v FROM k WHERE NOT cm QUALIFY row_number() OVER (PARTITION BY case_id, num ORDER BY pos DESC) = 1)
SELECT k.case_id AS doc_id, CAST(row_number() OVER (PARTITION BY k.case_id ORDER BY k.pos) AS INT) AS pos, k.num AS seller_invoice_num, contains(k.num, '-CM') AS is_credit_memo,
CASE WHEN amount < 0 THEN -1 ELSE 1 END * {_C('amount')} AS invoice_amount, CASE WHEN amount < 0 THEN -1 ELSE 1 END * {_C('amount')} AS net_amount_paid, t.v AS terms_discount
FROM k LEFT JOIN terms t ON t.case_id = k.case_id AND t.num = k.num""")
def remittance_rows_parse(spark: SparkSession, sf: str) -> DataFrame:
    return X.remittance_rows(T.remittance_texts(spark, sf))


@query(f"""SELECT claim_line_id AS doc_id, lpad(CAST(claim_line_id AS VARCHAR), 12, '7') AS upc, 3 AS pos, concat('ITEM NAME ', claim_line_id) AS description, CASE WHEN unit_price IS NOT NULL THEN floor(adj_qty) END AS adj_qty, CASE WHEN adj_qty IS NOT NULL THEN {_C('unit_price')} END AS unit_price,
-({_C('adj_amount')}) AS adj_amount, CASE WHEN unit_price IS NOT NULL THEN coalesce(reason_code, '6') END AS reason_code, 'shortage' AS reason_text FROM claim_lines""")
def claim_rows_window_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all claims, also those printed without a quantity, price or amount."""
    return X.claim_rows(T.claim_texts(spark, sf))


@query(f"""SELECT claim_line_id AS doc_id, lpad(CAST(claim_id AS VARCHAR), 10, '0') AS invoice_number, CAST(NULL AS VARCHAR) AS po_number, {_C('adj_amount')} AS deduction_amount, CAST(NULL AS DOUBLE) AS gross_invoice_amount,
CAST(NULL AS DOUBLE) AS net_invoice_amount, CAST(NULL AS DOUBLE) AS discount_amount FROM claim_lines""")
def claim_header_parse(spark: SparkSession, sf: str) -> DataFrame:
    return X.claim_headers(T.claim_texts(spark, sf))


# without an amount beside the narrative the pair of the header, 1.00, is the nearest
@query(f"SELECT claim_line_id AS doc_id, CASE WHEN adj_amount IS NULL THEN -1e0 ELSE -({_C('adj_amount')}) END AS adj_amount, concat('DEPOT ORAD LATE; claim ', claim_line_id) AS reason_text FROM claim_lines WHERE adj_amount IS NULL OR {_C('adj_amount')} <> 0")
def promo_row_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return X.promotion_rows(T.promotion_texts(spark, sf))


@query(f"SELECT claim_line_id, -({_C('adj_amount')}) AS amount, -({_C('adj_amount')}) AS trailing FROM claim_lines WHERE adj_amount IS NOT NULL")
def amount_parse(spark: SparkSession, sf: str) -> DataFrame:
    printed = table(spark, sf, "claim_lines").where("adj_amount is not null").select("claim_line_id", F.concat(F.lit("$ "), T.amount(F.col("adj_amount")), F.lit("-")).alias("a"), F.concat(T.amount(F.col("adj_amount")), F.lit("-")).alias("b"))
    return printed.select("claim_line_id", E.parse_amount(F.col("a")).alias("amount"), E.parse_trailing_minus(F.col("b")).alias("trailing"))


@query("SELECT invoice_id, CASE WHEN regexp_matches(trim(invoice_date), '^[0-9]{8}$') THEN regexp_replace(trim(invoice_date), '^([0-9]{4})([0-9]{2})([0-9]{2})$', '\\1-\\2-\\3') ELSE trim(invoice_date) END AS iso, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS back FROM invoices")
def yyyymmdd_format(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "invoices").select("invoice_id", E.iso_date(F.col("invoice_date")).alias("iso"), E.iso_date(F.date_format(utc_clock(F.col("loaded_at")), "yyyyMMdd")).alias("back"))


@query("SELECT pod_id, coalesce(regexp_matches(stamp_notes, " + _quote("(?i)" + "|".join(E.NO_SHORTAGE)) + "), false) AS no_shortage FROM pods")
def no_shortage_notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pods").select("pod_id", E.says_no_shortage(F.col("stamp_notes")).alias("no_shortage"))


@query("SELECT event_id, CAST(json_extract(props, '$') AS VARCHAR) IS NOT NULL AS repaired, event_type AS kind FROM events")
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as models print them (plain, fenced, without braces, in prose), repaired and read."""
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))
    n = F.col("event_id") % 4
    said = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.substring(body, 2, 1_000_000_000).substr(F.lit(1), F.length(body) - 2), F.lit(", "))).otherwise(F.concat(F.lit("Here it is, as asked - "), body, F.lit(" done")))
    r = X.repair_json(said)
    return e.select("event_id", r.isNotNull().alias("repaired"), F.get_json_object(r, "$.kind").alias("kind"))


# ---- files and pages

_READ = "length(regexp_replace(coalesce(text, ''), '[\\s\\x00-\\x1f\\x7f\\x{80}-\\x{9f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g'))"


@query(f"SELECT doc_id, {_READ} AS n_readable, {_READ} < 120 AS scanned FROM documents")
def readable_chars(spark: SparkSession, sf: str) -> DataFrame:
    n = E.readable_chars(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.cast("long").alias("n_readable"), (n < files.SCANNED_CHARS).alias("scanned"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def content_sha16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", files.content_id(F.encode("text", "UTF-8")).alias("content_id"))


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) AS n FROM documents)
SELECT doc_id, count(*) AS n_pages, string_agg('[page ' || n || ']' || chr(10) || CASE WHEN {_READ} >= 40 THEN text ELSE '' END, chr(10) || chr(10) ORDER BY n) AS full_text, sum({_READ}) / count(*) < 120 AS scanned FROM p GROUP BY doc_id""")
def page_text_concat(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n\n", "\f").alias("text"))
    return files.joined_pages(files.pages(d), "doc_id")


_PATHS = "(SELECT source_path AS path FROM invoices UNION ALL SELECT source_path FROM bols UNION ALL SELECT 'case_' || case_id || '/.hidden' || pod_id FROM pods UNION ALL SELECT 'case_' || case_id || '/notes.' || extraction_method FROM pods)"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pods")
    home = F.concat(F.lit("case_"), F.col("case_id").cast("string"))
    return (
        table(spark, sf, "invoices").select(F.col("source_path").alias("path")).union(table(spark, sf, "bols").select("source_path"))
        .union(p.select(F.concat(home, F.lit("/.hidden"), F.col("pod_id").cast("string")))).union(p.select(F.concat(home, F.lit("/notes."), "extraction_method")))
    )


@query(f"""WITH f AS (SELECT path, regexp_extract(lower(string_split(path, '/')[-1]), '^.+?(\\.[^.]*)$', 1) AS e FROM {_PATHS}),
k AS (SELECT path, e, CASE WHEN e = '.pdf' THEN 'pdf' WHEN e IN ('.txt', '.md', '.log', '.csv', '.tsv') THEN 'text' WHEN e IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.webp', '.bmp') THEN 'image' END AS kind FROM f WHERE NOT starts_with(string_split(path, '/')[-1], '.'))
SELECT path, kind, CASE WHEN kind IS NULL THEN 'unsupported file type ''' || CASE WHEN e = '' THEN '(no extension)' ELSE e END || '''' END AS reason FROM k""")
def ingest_triage(spark: SparkSession, sf: str) -> DataFrame:
    return files.triage(_paths(spark, sf))


@query(f"""SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) FILTER (regexp_matches(lower(path), '\\.(pdf|png|jpe?g|tiff?|webp|bmp|txt|md|log|csv|tsv)$') AND NOT regexp_matches(path, '/\\.[^/]*$')) AS n_files FROM {_PATHS} GROUP BY 1 HAVING n_files >= 2""")
def case_folder_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return files.case_folders(_paths(spark, sf))


# ---- receiving evidence


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pods").select(
        "case_id", "pod_id", F.col("has_receiving_stamp").alias("stamp"), F.col("stamp_notes").alias("notes"), F.col("total_cases_shipped").alias("shipped"), F.col("total_cases_received").alias("received"),
        F.coalesce(F.col("total_cases_received") < F.col("total_cases_shipped"), F.lit(False)).alias("shortage"), F.array_compact(F.array(F.col("extraction_method"))).alias("exceptions"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pod_id) AS n, count(*) OVER (PARTITION BY case_id) AS m FROM pods)
SELECT case_id, count(*) AS n_records, bool_or(has_receiving_stamp) AS stamp, CASE WHEN max(m) = 1 THEN min(total_cases_shipped) ELSE arg_min(total_cases_shipped, n) FILTER (total_cases_shipped >= 0 AND total_cases_shipped < 20000) END AS shipped,
CASE WHEN max(m) = 1 THEN min(total_cases_received) ELSE arg_min(total_cases_received, n) FILTER (total_cases_received >= 0 AND total_cases_received < 20000) END AS received,
list_sort(list(DISTINCT extraction_method)) AS exceptions FROM p GROUP BY case_id""")
def receiving_merge_fold(spark: SparkSession, sf: str) -> DataFrame:
    r = receiving.fold_receiving(_records(spark, sf), "case_id", "pod_id")
    return r.select("case_id", F.col("n_records").cast("long").alias("n_records"), "stamp", "shipped", "received", F.array_sort("exceptions").alias("exceptions"))


_OCR = """ocr AS (SELECT bol_id AS page_id, pos AS line_no, CASE pos % 4 WHEN 0 THEN 'TOTAL # OF CASES ON BOL' WHEN 1 THEN 'Receiving Stamp' ELSE description END AS text, 50e0 + pos * 7 AS x1, 100e0 + pos * 23 AS y1, 300e0 + pos * 11 AS x2, 118e0 + pos * 23 AS y2,
1700 AS page_w, 2200 AS page_h, coalesce(cases, 0) / 1000 AS confidence FROM shipped_lines)"""


def _ocr(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped lines as recognised lines of a page, some of them as labels of a stamp."""
    p = F.col("pos")
    said = F.when(p % 4 == 0, "TOTAL # OF CASES ON BOL").when(p % 4 == 1, "Receiving Stamp").otherwise(F.col("description"))
    return table(spark, sf, "shipped_lines").select(
        F.col("bol_id").alias("page_id"), p.alias("line_no"), said.alias("text"), (50.0 + p * 7).alias("x1"), (100.0 + p * 23).alias("y1"), (300.0 + p * 11).alias("x2"), (118.0 + p * 23).alias("y2"),
        F.lit(1700).alias("page_w"), F.lit(2200).alias("page_h"), (F.coalesce("cases", F.lit(0.0)) / 1000).alias("confidence"))


_REGION = """reg AS (SELECT page_id, CAST(greatest(0, trunc(min(x1)) - 80) AS BIGINT) AS x1, CAST(greatest(0, trunc(min(y1)) - 40) AS BIGINT) AS y1, CAST(least(trunc(1700 * 0.98e0), least(1700, trunc(max(x2)) + 160)) AS BIGINT) AS x2,
CAST(least(least(2200, trunc(max(y2)) + trunc(greatest(1, max(y2) - min(y1)) * CASE WHEN count(*) <= 2 THEN 11 ELSE 2 END)), greatest(0, trunc(min(y1)) - 40) + trunc(2200 * 0.40e0)) AS BIGINT) AS y2, count(*) AS n_anchors
FROM ocr WHERE line_no % 4 < 2 GROUP BY page_id)"""


@query(f"WITH {_OCR}, {_REGION} SELECT * FROM reg WHERE x2 - x1 >= 100 AND y2 - y1 >= 60")
def stamp_region_union(spark: SparkSession, sf: str) -> DataFrame:
    return receiving.stamp_regions(_ocr(spark, sf))


@query(f"""WITH {_OCR}, {_REGION}, inside AS (SELECT o.* FROM ocr o JOIN reg r ON r.page_id = o.page_id AND r.x2 - r.x1 >= 100 AND r.y2 - r.y1 >= 60 WHERE least(o.x2, r.x2) > greatest(o.x1, r.x1) AND least(o.y2, r.y2) > greatest(o.y1, r.y1)
AND (least(o.x2, r.x2) - greatest(o.x1, r.x1)) * (least(o.y2, r.y2) - greatest(o.y1, r.y1)) / greatest(1, (o.x2 - o.x1) * (o.y2 - o.y1)) >= 0.5e0)
SELECT page_id, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY round_even(y1 / 8, 0), x1, line_no, text) AS text, avg(confidence) AS confidence FROM inside GROUP BY page_id""")
def ocr_lines_in_bbox(spark: SparkSession, sf: str) -> DataFrame:
    o = _ocr(spark, sf)
    return receiving.lines_in_region(o, receiving.stamp_regions(o))


@query("""SELECT case_id AS doc_id, -max(best).p AS page_number, max(best).s AS score FROM (SELECT case_id, {'s': CAST(total_cases_shipped IS NOT NULL AS INT) + CAST(total_cases_received IS NOT NULL AS INT) + CAST(has_receiving_stamp AS INT) + CAST(extraction_method = 'vision_llm' AS INT), 'p': -pod_id} AS best FROM pods) GROUP BY case_id""")
def stamp_best_page(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pods").select(
        F.col("case_id").alias("doc_id"), F.col("pod_id").alias("page_number"), F.col("total_cases_shipped").alias("shipped"), F.col("total_cases_received").alias("received"), F.lit(None).cast("double").alias("over_short"),
        F.col("has_receiving_stamp").alias("stamp"), (F.col("extraction_method") == "vision_llm").alias("pictured"))
    return receiving.best_stamp_pages(p)


@query("SELECT pod_id, coalesce(CASE WHEN total_cases_received BETWEEN 0 AND 300 THEN trunc(total_cases_received) END, CASE WHEN trunc(total_cases_shipped) BETWEEN 0 AND 19999 THEN trunc(total_cases_shipped) END)::BIGINT AS fused FROM pods")
def stamp_fuse(spark: SparkSession, sf: str) -> DataFrame:
    # a reading above 300 is blown up to a number that cannot be a count
    r = F.when(F.col("total_cases_received") > 300, F.col("total_cases_received") * 1000).otherwise(F.col("total_cases_received"))
    return table(spark, sf, "pods").select("pod_id", receiving.fuse_counts(r, F.col("total_cases_shipped")).alias("fused"))


_N = lambda c: f"trim(regexp_replace(upper(coalesce({c}, '')), '\\s+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT case_id AS doc_id, bol_id AS page_number, {_N('bol_number')} AS b, {_N('po_number')} AS p, {_N('ship_to')} AS t FROM bols),
f AS (SELECT *, first_value(b) OVER w AS fb, first_value(p) OVER w AS fp, first_value(t) OVER w AS ft FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, page_number, NOT ((b = '' AND p = '' AND t = '') OR (fb = '' AND fp = '' AND ft = '') OR (NOT ((b <> '' AND fb <> '' AND b <> fb) OR (p <> '' AND fp <> '' AND p <> fp) OR (t <> '' AND ft <> '' AND t <> ft))
AND ((b <> '' AND fb <> '') OR (p <> '' AND fp <> '') OR (t <> '' AND ft <> '')))) AS is_other FROM f""")
def cross_shipment_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The bills of a case taken as the pages of one document."""
    return receiving.other_shipment_pages(table(spark, sf, "bols").select(F.col("case_id").alias("doc_id"), F.col("bol_id").alias("page_number"), "bol_number", "po_number", "ship_to"))


# ---- roll-ups


@query(f"""WITH {_FILES} SELECT case_id, list_sort(list(DISTINCT doc_type || ' :: ' || path)) AS documents_seen, list_sort(list_filter(['bill_of_lading', 'deduction_claim', 'remittance_advice', 'sales_invoice'], lambda x: NOT list_contains(list(DISTINCT doc_type), x))) AS documents_missing, count(*) AS n_documents FROM f GROUP BY case_id""")
def documents_missing(spark: SparkSession, sf: str) -> DataFrame:
    return report.case_documents(T.case_files(spark, sf))


@query("""SELECT pod_id, CASE WHEN total_cases_shipped IS NOT NULL AND total_cases_received IS NOT NULL THEN CASE WHEN total_cases_received = total_cases_shipped THEN 'full' WHEN total_cases_received < total_cases_shipped THEN 'short' ELSE 'over' END
WHEN total_cases_shipped IS NOT NULL OR total_cases_received IS NOT NULL THEN 'partial' ELSE 'unread' END AS status, total_cases_received - total_cases_shipped AS delta FROM pods""")
def receiving_status(spark: SparkSession, sf: str) -> DataFrame:
    s, r = F.col("total_cases_shipped"), F.col("total_cases_received")
    return table(spark, sf, "pods").select("pod_id", report.receiving_status(s, r).alias("status"), (r - s).alias("delta"))


@query("SELECT bol_id, page_number, count(*) AS n_lines, sum(cases) AS cases, bool_or(NOT belongs_to_primary_shipment) AS is_other, min(pos) AS first_pos FROM shipped_lines GROUP BY ALL")
def bol_lines_by_page(spark: SparkSession, sf: str) -> DataFrame:
    return report.lines_by_page(table(spark, sf, "shipped_lines"))


@query("SELECT bol_id, nullif(sum(CASE WHEN belongs_to_primary_shipment THEN cases END), 0) AS total_cases, list_sort(list(DISTINCT page_number)) AS pages FROM shipped_lines GROUP BY bol_id")
def bol_primary_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.primary_totals(table(spark, sf, "shipped_lines"))


@query(f"WITH {_FILES} SELECT doc_type, method AS extraction_method, count(*) AS n, min(conf) AS least, avg(conf) AS mean, max(conf) AS greatest FROM f GROUP BY ALL")
def extraction_audit(spark: SparkSession, sf: str) -> DataFrame:
    return report.extraction_audit(T.case_files(spark, sf))


# ---- EDI and ladders


@query()
def edi_invoice_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Number, date, order, delivery, partners, terms and totals of each IDOC."""
    return edi.idoc_headers(table(spark, sf, "idocs"))


@query()
def edi_invoice_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per goods line with a quantity: unit, item codes, words, rates and amounts."""
    return edi.idoc_lines(table(spark, sf, "idocs"))


@query("""SELECT concat('i', invoice_id) AS doc_id, 'invoice' AS extraction_method, 0.95e0 AS extraction_confidence, count(*) AS n_rows FROM invoice_lines WHERE invoice_id IN (SELECT invoice_id FROM invoices) GROUP BY 1
UNION ALL SELECT concat('c', claim_line_id), 'claim', 0.9e0, 1 FROM claim_lines""")
def tier_router(spark: SparkSession, sf: str) -> DataFrame:
    """Printed invoices and claims through two tiers: the reader of invoice rows, and that of claim rows for what it left open."""
    printed = lambda t, letter: t.select(F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    d = printed(T.invoice_texts(spark, sf), "i").unionByName(printed(T.claim_texts(spark, sf), "c"))
    rows = lambda read: lambda x: read(x).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return tiers.ladder(d, "doc_id", [tiers.Tier("invoice", rows(X.invoice_rows), 0.95), tiers.Tier("claim", rows(X.claim_rows), 0.9)])


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def extract_once_per_content(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return tiers.once_per_content(d, "text", lambda x: x.select("content_id", F.length("content").cast("long").alias("n")))
