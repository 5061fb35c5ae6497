"""Queries of the general data operators: p3 nested records, p4 units, p5 orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import nested, orphans, units
from ledgerlens.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.invoice_segments(table(spark, sf_dir, "idocs"))


def p3_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct objects with the number of their occurrences and records."""
    objects, bridge = nested.shred(table(spark, sf_dir, "idocs"), "idoc_id", "payload", "INVOIC02")
    uses = bridge.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_occurrences"), F.max("record_id").alias("last_record"))
    return objects.join(uses, "object_id").select("object_id", "name", "fields", "n_occurrences", "last_record")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.convert_units(*(table(spark, sf_dir, t) for t in ("invoice_lines", "shipped_lines", "uom_codes")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.find_orphans({t: table(spark, sf_dir, t) for t in ("invoices", "bols", "pods")})


def p5_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p5_found(spark, sf_dir))


_P5_SQL = """
WITH parent AS (
  SELECT 'bols' AS t, 'po_number' AS f, nullif(ltrim(regexp_replace(po_number, '[^0-9]', '', 'g'), '0'), '') AS k, loaded_at AS seen, voided_at AS gone FROM bols
  UNION ALL SELECT 'bols', 'bol_number', nullif(ltrim(regexp_replace(bol_number, '[^0-9]', '', 'g'), '0'), ''), loaded_at, voided_at FROM bols
  UNION ALL SELECT 'invoices', 'po_number', nullif(ltrim(regexp_replace(po_number, '[^0-9]', '', 'g'), '0'), ''), loaded_at, voided_at FROM invoices
), known AS (
  SELECT t, f, k, min(CASE WHEN gone IS NULL THEN seen END) AS live_at, bool_or(gone IS NOT NULL) AS gone FROM parent WHERE k IS NOT NULL GROUP BY t, f, k
), ref AS (
  SELECT 'invoices' AS src_table, 'po_number' AS ref_field, 'bols' AS t, 'po_number' AS f, invoice_id AS src_id, po_number AS v, loaded_at AS seen FROM invoices
  UNION ALL SELECT 'invoices', 'delivery_number', 'bols', 'bol_number', invoice_id, delivery_number, loaded_at FROM invoices
  UNION ALL SELECT 'pods', 'referenced_bol', 'bols', 'bol_number', pod_id, referenced_bol, loaded_at FROM pods
  UNION ALL SELECT 'pods', 'referenced_po', 'invoices', 'po_number', pod_id, referenced_po, loaded_at FROM pods
), keyed AS (SELECT *, nullif(ltrim(regexp_replace(v, '[^0-9]', '', 'g'), '0'), '') AS k FROM ref)
"""

_P5_ROWS = (
    _P5_SQL
    + """
SELECT r.src_table, r.ref_field, r.src_id,
  CASE WHEN p.live_at IS NOT NULL THEN 'late' WHEN p.gone THEN 'deleted' ELSE 'missing' END AS orphan_kind,
  strftime(r.seen AT TIME ZONE 'UTC', '%Y-%m') AS ref_month
FROM keyed r LEFT JOIN known p ON p.t = r.t AND p.f = r.f AND p.k = r.k
WHERE r.k IS NOT NULL AND (p.live_at IS NULL OR p.live_at > r.seen)
"""
)

_LIST = lambda words, *codes: "(" + ", ".join(f"'{w}'" for c in codes for w in (*words[c], c.lower())) + ")"
_KEY = lambda c: f"lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
_SIZE = lambda u: f"(SELECT factor FROM uom_codes WHERE uom = '{u}')"


def _cases_in(key: str) -> str:
    """Cases in one of a count unit; null for one case and for no unit."""
    w = units.COUNT_WORDS
    return f"""CASE WHEN {key} IN {_LIST(w, 'LY')} THEN {_SIZE('LY')} WHEN {key} IN {_LIST(w, 'PL')} THEN {_SIZE('PL')} WHEN {key} IN {_LIST(w, 'PC')} THEN 1e0 / ppc
WHEN {key} IN {_LIST(w, 'DZ')} THEN {_SIZE('DZ')} / ppc WHEN {key} IN {_LIST(w, 'TH')} THEN {_SIZE('TH')} / ppc
WHEN regexp_matches({key}, '^(bundle)?(cs|case)?x?[0-9]+(cs|case)?$') AND regexp_matches({key}, 'cs|case') THEN CAST(regexp_extract({key}, '[0-9]+') AS DOUBLE) END"""


def _pounds_in(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN {_LIST(units.WEIGHT_WORDS, c)} THEN {_SIZE(c)}" for c in units.WEIGHT_WORDS if c != "LB") + " END"


_PACK = lambda t: f"regexp_extract(upper({t}), '(?:([0-9]+)\\s*(?:CT)?\\s*[-/X]\\s*)?(?:([0-9]+)\\s*(?:CT)?\\s*[-/X]\\s*)?([0-9]+)(?:\\s*CT\\s*|\\s*[-/X]\\s*)[0-9]+(?:\\.[0-9]+)?\\s*OZ', ['a', 'b', 'c'])"
_PPC = lambda t: f"CASE WHEN {_PACK(t)}.c <> '' THEN coalesce(TRY_CAST({_PACK(t)}.a AS DOUBLE), 1) * coalesce(TRY_CAST({_PACK(t)}.b AS DOUBLE), 1) * CAST({_PACK(t)}.c AS DOUBLE) END"
_TAIL = "regexp_replace(regexp_extract(lower(description), '^.*[0-9] *oz\\s*(?:tube|bag|box|can|pouch|stick|pack)?(.*)$', 1), '\\b(qty|in|sold|by|the|full|per|of|a)\\b', ' ', 'g')"

# a text's unit counts where the column has none; a unit that is one case or pound gives no row
_P4_ROWS = f"""
WITH i AS (SELECT invoice_line_id AS id, quantity AS v, {_KEY('unit_label')} AS k, {_KEY(_TAIL)} AS t, {_PPC('description')} AS ppc FROM invoice_lines),
s AS (SELECT shipped_line_id AS id, cases, weight, {_KEY('weight_uom')} AS w, {_PPC('description')} AS ppc, CASE
  WHEN contains(raw_text, '|') THEN regexp_extract(raw_text, '^([0-9.,]+)([^|]*)\\|.*\\| *wt *([0-9.,]+)([^|]*)\\|', ['n', 'c', 'm', 'p'])
  WHEN contains(raw_text, ' lot ') THEN regexp_extract(raw_text, ' lot [^ ]+  ([0-9.,]+)(.*?)  ([0-9.,]+)(.*?)  [^ ]+$', ['n', 'c', 'm', 'p'])
  ELSE regexp_extract(raw_text, ' [0-9]{{6,}} ([0-9.,]+)([A-Za-z. ]*) ([0-9.,]+)([A-Za-z. ]*) [^ ]+$', ['m', 'p', 'n', 'c']) END AS r FROM shipped_lines),
k AS (SELECT *, {_KEY('r.c')} AS rc, {_KEY('r.p')} AS rp FROM s),
u AS (SELECT 'invoice_lines' AS src_table, id AS line_id, 'cases' AS measure, v, CASE WHEN coalesce(k, '') <> '' THEN {_cases_in('k')} ELSE {_cases_in('t')} END AS f FROM i
UNION ALL SELECT 'shipped_lines', id, 'cases', cases, {_cases_in('rc')} FROM k
UNION ALL SELECT 'shipped_lines', id, 'weight', weight, CASE WHEN coalesce(w, '') <> '' THEN {_pounds_in('w')} ELSE {_pounds_in('rp')} END FROM k)
SELECT src_table, line_id, measure, CAST(floor(v * f * 1000 + 0.5000010e0) AS BIGINT) AS amount_milli FROM u WHERE v IS NOT NULL AND f IS NOT NULL
"""

QUERIES = {
    "p3_found": p3_found, "p3_objects": p3_objects, "p4_found": p4_found, "p5_found": p5_found, "p5_orphan_report": p5_orphan_report,
}

ORACLES = {
    "p4_found": _P4_ROWS,
    "p5_found": _P5_ROWS,
    "p5_orphan_report": f"SELECT src_table, ref_field, orphan_kind, ref_month, count(*) AS n_orphans FROM ({_P5_ROWS}) GROUP BY ALL",
}
