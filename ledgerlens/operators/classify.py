"""Rule tables: the type of a document and of a claim, as one projection over the text.

Every rule is a literal pattern, so that it is compiled once; no rule table is joined and nothing
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, type, strength) over a document's text, in order.
CONTENT_RULES = (
    (r"(?i)\bSTRAIGHT\s+BILL\s+OF\s+LADING\b", "bill_of_lading", 0.98),
    (r"(?i)\bDELIVERY\s+ORDER\b", "bill_of_lading", 0.7),
    (r"(?i)\bBOL\s*NUMBER\b", "bill_of_lading", 0.85),
    (r"(?i)\bProof of Delivery\b", "proof_of_delivery", 0.95),
    (r"\bPOD\b", "proof_of_delivery", 0.5),
    (r"(?i)\bREMITTANCE\s+INFORMATION\b", "remittance_advice", 0.98),
    (r"(?is)\bEFFECTIVE\s+DATE\b.*\bCREDIT\b", "remittance_advice", 0.6),
    (r"-CM\b", "remittance_advice", 0.4),
    (r"(?i)\bAssociated\s+Deductions\b", "deduction_claim", 0.95),
    (r"(?i)\bAdjustment\s+reason\b", "deduction_claim", 0.8),
    (r"(?i)\bKROGER\s+Invoice\s+number\b", "deduction_claim", 0.9),
    (r"(?i)\bDeduction\s+amount\b", "deduction_claim", 0.5),
    (r"(?i)\bBill-To-Party\b", "sales_invoice", 0.6),
    (r"(?is)\bDocument\s+Number\b.*\bInvoice\b", "sales_invoice", 0.6),
    (r"(?i)Off\s*Invoice\s*Pro", "sales_invoice", 0.8),
    (r"(?i)Ref\.?\s*Order\s*Number", "sales_invoice", 0.5),
    (r"(?i)Delivery\s*Number", "sales_invoice", 0.4),
)
# The same over a file name; their strength counts nine tenths.
_EDGE = r"(?:^|[^a-z0-9])"
FILENAME_RULES = (
    (rf"(?i)sales.?invoice|invoice.*\d{{4,}}|{_EDGE}inv{_EDGE}", "sales_invoice", 0.7),
    (rf"(?i)bill.?of.?lading|{_EDGE}bol{_EDGE}", "bill_of_lading", 0.8),
    (rf"(?i){_EDGE}pod{_EDGE}|proof.?of.?delivery|receiving", "proof_of_delivery", 0.85),
    (r"(?i)check|payment|remittance", "remittance_advice", 0.8),
    (r"(?i)deduction|chargeback|debit.?note|claim", "deduction_claim", 0.8),
)
# Types of the reason codes.
CODE_TYPES = {"2": "shortage", "4": "shortage", "5": "shortage", "6": "shortage", "72": "shortage", "8": "pricing", "11": "pricing", "18": "pricing", "13": "compliance", "14": "compliance", "16": "compliance", "9": "unsaleables", "10": "unsaleables"}
# Words of each type in a narrative, in order.
NARRATIVES = (
    ("shortage", r"(?i)\b(shortage|short[\s-]?shipped|short[\s-]?ship|case[s]?\s+short|item\s+invoiced\s*/?\s*not\s+received|not\s+received|qty\s+short|under[\s-]?ship|missing\s+case)"),
    ("pricing", r"(?i)\b(pricing|price\s+diff|cost\s+variance|cost\s+diff|overcharg|billed?\s+price|incorrect\s+price|price\s+error|unit\s+price\s+mismatch)"),
    ("compliance", r"(?i)\b(orad\s+late|late\s+delivery|on[\s-]?time\s+in[\s-]?full|otif|routing\s+violation|asn\s+(fail|error)|edi\s+(fail|error)|compliance\s+fee|late\s+ship|missed\s+appointment)"),
    ("unsaleables", r"(?i)\b(unsaleab|damaged?\s+goods|expired|spoil|broken\s+case|product\s+damage)"),
)


def classify_document(text: Column | None, filename: Column | None) -> Column:
    """struct(doc_type, confidence, rules): the type with the strongest rule that hits.

    Ties go to the type whose rule hit first. ``rules`` are the numbers of the rules that hit, file
    name rules after the content rules. Nothing that hits, null and '' included, is 'unknown' with 0.2.
    """
    rules = [(k, text, *r) for k, r in enumerate(CONTENT_RULES)] if text is not None else []
    if filename is not None:
        rules += [(len(CONTENT_RULES) + k, filename, p, t, s * 0.9) for k, (p, t, s) in enumerate(FILENAME_RULES)]
    kinds, strengths = F.array(*(F.lit(r[3]) for r in rules)), F.array(*(F.lit(float(r[4])) for r in rules))
    first = rules[0][0]
    at = lambda values, k: F.element_at(values, k - (first - 1))

    def best(fired: Column) -> Column:
        """The greatest (strength, minus the first rule of the type) of the rules that hit."""
        early = lambda k: F.array_min(F.filter(fired, lambda j: at(kinds, j) == at(kinds, k)))
        return F.array_max(F.transform(fired, lambda k: F.struct(at(strengths, k).alias("s"), (-early(k)).alias("e"), at(kinds, k).alias("t"))))

    # each pattern stands in the plan once: what follows sees the rules that hit as a bound variable
    hits = F.filter(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, c, p, _, _ in rules)), lambda x: x.isNotNull())
    bind = lambda c, f: F.transform(F.array(c), f)[0]
    return bind(hits, lambda fired: bind(best(fired), lambda b: F.struct(
        F.coalesce(b["t"], F.lit("unknown")).alias("doc_type"), F.coalesce(b["s"], F.lit(0.2)).alias("confidence"), fired.alias("rules"))))


def classify_claim(code: Column, reason_text: Column, description: Column, document_text: Column | None = None) -> Column:
    """struct(claim_type, confidence): by reason code, else by the first family of words in the narrative.

    The narrative is reason, description and document together; a family that also stands in
    the reason itself counts more. Blank narratives are 'unknown' with 0.0, others with 0.15.
    """
    by_code = F.try_element_at(F.create_map(*(F.lit(x) for kv in CODE_TYPES.items() for x in kv)), F.trim(code))
    parts = [reason_text, description] + ([document_text] if document_text is not None else [])
    hay = F.concat_ws(" ", *parts)
    kind, sure = F.when(by_code.isNotNull(), by_code), F.when(by_code.isNotNull(), 0.92)
    kind, sure = kind.when(F.trim(hay) == "", "unknown"), sure.when(F.trim(hay) == "", 0.0)
    for name, pattern in NARRATIVES:
        kind = kind.when(hay.rlike(pattern), name)
        sure = sure.when(hay.rlike(pattern), F.when(reason_text.rlike(pattern), 0.82).otherwise(0.75))
    return F.struct(kind.otherwise("unknown").alias("claim_type"), sure.otherwise(0.15).alias("confidence"))


def decision_table(rules: list[tuple[Column, dict[str, Column]]], names: list[str]) -> list[Column]:
    """Columns ``names`` of the first rule whose condition is true; null conditions count as false.

    The rules stand in one CASE per column; a null comes out where no rule holds.
    """
    out = []
    for n in names:
        c = None
        for cond, values in rules:
            cond = F.coalesce(cond, F.lit(False))
            c = F.when(cond, values[n]) if c is None else c.when(cond, values[n])
        out.append(c.alias(n))
    return out
