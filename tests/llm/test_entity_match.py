import functools
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.entity_match import Vocabulary, abbreviates, describe, learn_vocabulary, learned_weights, match_items, near_pairs, vocabulary_of

CL = "claim_line_id long, case_id long, claim_invoice_number string, claim_po_number string, upc string, description string, unit_price double, item string, v long"
INV = "invoice_id long, case_id long, invoice_number string, po_number string, item string"
IL = "invoice_line_id long, case_id long, material_number string, description string, unit_price double, quantity double, off_invoice_promo double, words string"
SL = "shipped_line_id long, case_id long, material_number string, customer_sku string, description string, belongs_to_primary_shipment boolean, pack string"
ITEMS = {"08847": "PCN CRSP MPL ORG {} BAG|6/25 OZ|20", "18847": "PCN CRSP MPL ORG {} BOX|10/5 OZ|56", "01340": "CHKPEA PUF LIME CHL FAM SZ {} BAG|6-14 OZ|36", "22691": "SESM SNAP MPL WHL GRN {} BAG|18/3.5 OZ|84", "09523": "SEED CRKR LIME CHL LOW SOD {} CAN|8/16 OZ|97", "15059": "RICE THN VNLA LTLY SLTD {} BAG|18 X 3.5 OZ|46"}


FULL = dict(x.split(":") for x in "PCN:PECAN CRSP:CRISP MPL:MAPLE ORG:ORGANIC CHKPEA:CHICKPEA PUF:PUFF CHL:CHILI FAM:FAMILY SZ:SIZE SESM:SESAME WHL:WHOLE GRN:GRAIN CRKR:CRACKER SOD:SODIUM THN:THIN VNLA:VANILLA LTLY:LIGHTLY SLTD:SALTED".split())
PLAIN = ("LIME", "SNAP", "SEED", "LOW", "RICE", "OAT", "SEA")
WORDS = Vocabulary(FULL | {w: w for w in (*FULL.values(), *PLAIN)}, ("BAG", "BOX", "CAN"))


def in_full(text):
    return " ".join(FULL.get(w, w) for w in text.split())


def tables(spark, claims):
    il, sl, n = [], [], 0
    for case in range(1, 31):
        for k, (m, d) in enumerate(ITEMS.items()):
            if m == "15059" or (case + k) % 3 == 0:
                continue
            n += 1
            text, pack, price = d.split("|")
            il.append((n, case, m, text.format(pack), float(price), 5.0, None, "x"))
            sl.append((n, case, m if n % 4 else None, f"IE{100000 + k * 17}", in_full(text.format("").strip() + " " + pack), True, "x"))
    filler = [(10_000 + i, 1 + i % 30, None, None, "10073180" + list(ITEMS)[i % 6], ITEMS[list(ITEMS)[i % 6]].split("|")[0].format(ITEMS[list(ITEMS)[i % 6]].split("|")[1]), float(ITEMS[list(ITEMS)[i % 6]].split("|")[2])) for i in range(180)]
    il.append((900, 1, None, None, 3.0, 1.0, None, None))
    sl.append((901, 1, "08847", None, None, False, "x"))
    inv = [(c, c, f"00900{c:05d}", f"45000{c:05d}", "x") for c in range(1, 31)]
    return (
        spark.createDataFrame([(*c, "x", 1) for c in filler + list(claims)], CL), spark.createDataFrame(inv, INV), spark.createDataFrame(il, IL), spark.createDataFrame(sl, SL),
    )


def found(spark, *claims):
    t = tables(spark, claims)
    il = {r.invoice_line_id: (r.case_id, r.material_number) for r in t[2].collect()}
    out = {}
    for r in match_items(*t).collect():
        assert 0.5 <= r.confidence <= 1
        if r.claim_line_id < 10_000:
            out.setdefault(r.claim_line_id, set()).add((r.target_table, *il[r.target_line_id]))
    return out


def both(case, m):
    return {("invoice_lines", case, m), ("shipped_lines", case, m)}


def test_ways_of_naming_an_item(spark):
    # case 1 lacks the items of index 2 and 5, case 2 those of 1 and 4
    got = found(
        spark,
        (1, 1, None, None, "1007318008847", "ORG MPL PECAN CRISP 6CT 25OZ", 20.0), (2, 1, None, None, "0-73180-08847-2", None, 20.0), (3, 1, None, None, None, "6 x 25 oz organic maple pcn crisp", 20.0),
        (4, 1, None, None, "1007318008841", "ORGANIC MPALE PECAN CRISP, BAG 6/25OZ", 20.0),  # mistyped twice
        (5, None, "INV-0090000001", None, "00 10073180 22691", "SESAME SNAP", None), (6, None, None, "PO 4500000001", "100731802691", "WHOLE GRAIN MAPLE SESAME SNAP 18/3.5OZ", 84.0),
        (7, 1, None, None, "00000000000", "RICE THIN VNLA LTLY SLTD 18 X 3.5 OZ", 46.0),  # not in the case
        (8, 2, None, None, "1007318018847", "PCN CRSP MPL ORG 10/5 OZ", 56.0),  # its sister is in the case
        (9, None, None, None, "1007318008847", None, None), (10, 1, None, None, "N/A", "", None), (11, 99, None, None, "1007318008847", None, 20.0), (1, 1, None, None, "1007318008847", "x" * 50_000, 20.0),
    )
    assert got == {i: both(1, "08847") for i in (1, 2, 3, 4)} | {i: both(1, "22691") for i in (5, 6)}


def test_lines_without_a_material_find_the_item_of_their_case(spark):
    c, i, il, sl = tables(spark, [(1, 1, None, None, "1007318008847", "ORG MPL PECAN CRISP 6CT 25OZ", 20.0), (2, 1, None, None, "1007318022691", "WHL GRN MPL SESAME SNAP 18/3.5 OZ", 84.0)])
    # case 1 ships 08847 and 22691 and invoices both; cut-off words, another price, price alone, price of two
    more = [(2001, 1, None, "PCN CRSP MPL O", 20.0, 1.0, None, None), (2002, 1, None, "PCN CRSP MPL ORG", 56.0, 1.0, None, None), (2003, 1, None, None, 84.0, 1.0, None, None), (2004, 1, None, None, 51.0, 1.0, None, None)]
    skus = [(2005, 1, None, f"ie-{100000 + 3 * 17}", None, True, "x"), (2006, 1, None, f"ie-{100000 + 3 * 17}", None, False, "x"), (2007, 1, None, "??", None, True, "x")]
    got = match_items(c, i, il.union(spark.createDataFrame(more, IL)), sl.union(spark.createDataFrame(skus, SL))).where("claim_line_id < 10 and target_line_id > 2000").collect()
    assert {(r.claim_line_id, r.target_table, r.target_line_id) for r in got} == {(1, "invoice_lines", 2001), (2, "invoice_lines", 2003), (2, "shipped_lines", 2005)} and len(got) == 3


def test_empty_tables(spark):
    c, i, il, sl = tables(spark, [])
    assert match_items(c.limit(0), i, il, sl).count() == 0
    assert match_items(c, i, il.limit(0), sl.limit(0)).count() == 0


def test_describe():
    d = lambda t: describe(t, WORDS)
    assert d("SESMSNAPMPLWHLGRN18/3.5OZBAG") == d("WHL GRN MPL SESAME SNAP BAG 18CT 3.5OZ") == d("18 X 3.5 OZ whole grain maple sesm snap")
    assert d("PCN CRSP MPL ORG 6/25 OZ BAG sold by the dozen")[:2] == ("CRISP MAPLE ORGANIC PECAN", "6x25")
    assert d("OAT SNAP SEA LI")[:2] == ("OAT SEA SNAP", "") and d(None) == d("") == ("", "", 0)
    assert WORDS.normal("SNPA") == "SNAP" and WORDS.normal("ZZZ") == "ZZZ" and Vocabulary({}).segment("ABC") == ["ABC"]


def test_the_vocabulary_is_learned_from_the_lines(spark):
    assert abbreviates("PPR", "PEPPER") and not abbreviates("PPR", "PECAN") and not abbreviates("ORGANIC", "ORG")
    _, _, il, sl = tables(spark, [])
    lines = il.selectExpr("material_number as material", "description").union(sl.selectExpr("material_number", "description")).where("material is not null and description is not null")
    slips = spark.createDataFrame([("08847", "PCN CRSPP MPL OR 6/25 OZ BAG"), ("08847", "PCNCRSPMPLORG6/25OZBAG")], "material string, description string")
    got = learn_vocabulary(lines.union(slips).groupBy("material", "description").agg({"*": "count"}).withColumnRenamed("count(1)", "n"))
    shown = {w for t in ITEMS if t != "15059" for w in ITEMS[t].split(" {}")[0].split()}
    assert {w: got.full.get(w) for w in shown} == {w: FULL.get(w, w) for w in shown} and got.packages == {"BAG", "BOX", "CAN"}
    assert not {"CRSPP", "OR", "PCNCRSPMPLORG"} & set(got.full)


def test_slips_and_glued_runs_are_no_words():
    v = vocabulary_of([("PECAN", 900, 0, 9), ("PECANN", 9, 0, 9), ("PEC", 9, 0, 9), ("CRISP", 500, 0, 9), ("PECANCRISP", 400, 0, 9), ("BAG", 50, 40, 9)], [("PEC", "PECAN", 9)])
    assert v.full == {"PECAN": "PECAN", "CRISP": "CRISP"} and v.packages == {"BAG"} and vocabulary_of([], []).full == {}


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_search_in_the_case_is_exact(seed):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = random.Random(seed)
    vector = lambda: rng.getrandbits(64) - 2**63
    items = [(rng.randrange(3), f"{rng.randrange(100_000):05d}" if rng.random() < 0.8 else "d|X", rng.choice((0, vector())), rng.choice(("", "6x25")), rng.choice((None, 20.0, 37.5)), None) for _ in range(40)]
    claims = []
    for i in range(40):
        case, item, v, pack, price, _ = rng.choice(items)
        near = functools.reduce(lambda x, k: x ^ (1 << k), rng.sample(range(63), rng.randrange(1, 16)), v) if v else 0
        five = "".join(rng.choice("0123456789") if rng.random() < 0.4 else c for c in item) if item.isdigit() and rng.random() < 0.5 else None
        four = item[1:] if five is None and item.isdigit() and rng.random() < 0.3 else None
        claims.append((i, rng.choice((case, 2)), rng.choice((0, near)), rng.choice(("", pack, "9x9")), five, four, item if rng.random() < 0.2 else None, rng.choice((None, price))))
    got = near_pairs(
        spark.createDataFrame(claims, "claim_line_id long, case_id long, c_v long, c_pack string, five string, four string, sku_item string, claim_price double"),
        spark.createDataFrame(items, "case_id long, item string, v long, pack string, price double, net double"),
    )
    cell = lambda p: math.floor(math.log(p) / 0.02)
    want = set()
    for i, case, v, pack, five, four, sku, price in claims:
        for c, item, w, p, q, _ in items:
            words = v and w and bin((v ^ w) & (2**64 - 1)).count("1") <= 11 and (not pack or not p or pack == p)
            code = len(item) == 5 and ((five and sum(x == y for x, y in zip(five, item)) >= 3) or (four and item[1:] == four))
            cheap = five is None and four is None and sku is None and price and q and (not pack or not v) and abs(cell(price) - cell(q)) <= 1
            if c == case and (words or code or sku == item or cheap):
                want.add((i, case, item))
    assert {tuple(r) for r in got.select("claim_line_id", "case_id", "item").collect()} == want


def test_confidence_is_calibrated(spark):
    """Claims of noisy codes, words and prices: as many are right as high confidences say; lower ones may understate, as the choice within the case adds to them."""
    rng = random.Random(11)
    names = list(ITEMS)
    claims, truth = [], {}
    for i in range(1, 1501):
        case = rng.randrange(1, 31)
        m = rng.choice([x for k, x in enumerate(names) if x != "15059" and (case + k) % 3])
        text, pack, price = ITEMS[m].split("|")
        code = "10073180" + m if rng.random() < 0.5 else "10073180" + "".join(rng.choice("0123456789") if rng.random() < 0.3 else c for c in m) if rng.random() < 0.7 else None
        words = text.format("").split()[: rng.randrange(1, 6)] if rng.random() < 0.7 else []
        claims.append((i, case, None, None, code, " ".join(words) + (" " + pack if rng.random() < 0.5 else "") if words else None, float(price) * rng.choice((1.0, 1.0, 0.97, 1.4)) if rng.random() < 0.7 else None))
        truth[i] = (case, m)
    t = tables(spark, claims)
    il = {r.invoice_line_id: (r.case_id, r.material_number) for r in t[2].collect()}
    got = [(r.confidence, il[r.target_line_id] == truth[r.claim_line_id]) for r in match_items(*t).where("claim_line_id < 10000 and target_table = 'invoice_lines'").collect()]
    assert len(got) > 700
    for lo, hi, understates in ((0.5, 0.95, 0.2), (0.95, 1.01, 0.05)):
        part = [x for x in got if lo <= x[0] < hi]
        said, right = sum(c for c, _ in part) / len(part), sum(ok for _, ok in part) / len(part)
        assert len(part) >= 30 and said - 0.05 < right < said + understates, (lo, len(part), said, right)


def test_weights_follow_the_counts():
    counts = [(1, 1, 1, 900.0), (7, 4, 3, 900.0), (1, 3, 1, 30.0), (7, 1, 3, 5.0), (0, 0, 0, 10.0)]
    prior, w = learned_weights(counts)
    assert w["words"][1] > 2 and w["words"][7] < -2 and w["code"][1] > 2 and w["code"][4] < -2 and w["price"][1] > 0 > w["price"][3]
    assert w["words"][0] == w["code"][0] == w["price"][0] == 0 and abs(prior) < 5 and learned_weights([])
