import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.operators.units import BLOCK_ROWS, convert_units, decisions, decode_units, readings, unit_sizes, viterbi

UOM = [("EA", "count", "case", 1.0), ("CS", "count", "case", 1.0), ("CTN", "count", "case", 1.0), ("LY", "count", "case", 10.0), ("PL", "count", "case", 60.0), ("PC", "count", "piece", 1.0),
       ("DZ", "count", "piece", 12.0), ("TH", "count", "piece", 1000.0), ("LB", "weight", "pound", 1.0), ("KG", "weight", "pound", 2.2046226218487757), ("OZ", "weight", "pound", 0.0625)]
IL = "invoice_line_id long, material_number string, description string, quantity double, unit_label string, unit_price double, level double, unit string"
SL = "shipped_line_id long, material_number string, description string, cases double, weight double, weight_uom string, raw_text string, block long"


def run(spark, il=(), sl=()):
    uom = spark.createDataFrame(UOM, "uom string, dimension string, base_unit string, factor double")
    got = convert_units(spark.createDataFrame(list(il), IL), spark.createDataFrame(list(sl), SL), uom).collect()
    return sorted((r.src_table[0], r.line_id, r.measure, r.amount_milli) for r in got)


def test_invoice_units(spark):
    d = "PCN CRSP MPL ORG 4/6-1.5 OZ PACK"
    il = [
        (1, "1", d, 24.0, "pcs", 1.0, 0.0, "x"), (2, "1", d, 2.0, "EA", 24.0, 0.0, "x"), (3, "1", d + " (QTY IN PCS)", 36.0, None, 1.0, 0.0, "x"), (4, "1", d + " sold by the dozen", 3.0, None, 12.0, 0.0, "x"),
        (5, "1", d + " per pallet", 0.5, None, 1440.0, 0.0, "x"), (6, "1", d + " /PC", 3.0, "Case", 24.0, 0.0, "x"), (7, "1", d, 3.0, None, 24.0, 0.0, "x"), (8, "1", d, 2.0, "Bundle 10 cs", 240.0, 0.0, "x"),
        (9, "1", None, 48.0, "PIECE", 1.0, 0.0, "x"), (10, "1", d, None, "PC", 1.0, 0.0, "x"), (11, None, None, 5.0, "PC", None, 0.0, "x"), (12, "1", d, 0.5, "M pcs", 1000.0, 0.0, "x"), (12, "1", d, 0.5, "M pcs", 1000.0, 0.0, "x"),
    ]
    assert run(spark, il) == [("i", 1, "cases", 1000), ("i", 3, "cases", 1500), ("i", 4, "cases", 1500), ("i", 5, "cases", 30000), ("i", 8, "cases", 20000), ("i", 9, "cases", 2000), ("i", 11, "cases", None), ("i", 12, "cases", 20833), ("i", 12, "cases", 20833)]


def test_unknown_label_is_decoded_from_the_level(spark):
    d = "PCN CRSP MPL ORG 6/25 OZ BAG"
    il = [(i, "7", d, 5.0, "CS", 60.0, 0.0, "x") for i in range(1, 9)] + [(9, "7", d, 12.0, "zak", 10.0, 0.0, "x"), (10, "7", d, 12.0, "zak", 3600.0, 0.0, "x"), (11, "7", d, 12.0, "zak", 60.0, 0.0, "x")]
    assert run(spark, il) == [("i", 9, "cases", 2000), ("i", 10, "cases", 720000)]


def test_wrong_and_missing_labels_are_decoded_from_the_level(spark):
    d = "PCN CRSP MPL ORG 4/6-1.5 OZ BAG"  # 24 pieces
    il = [(i, "7", d, 5.0, "CS", 60.0, 0.0, "x") for i in range(1, 9)]
    il += [(9, "7", d, 48.0, "CS", 2.5, 0.0, "x"), (10, "7", d, 48.0, None, 2.5, 0.0, "x"), (11, "7", d, 48.0, "PC", 2.4, 0.0, "x")]  # a price by the piece
    il += [(12, "7", d, 5.0, "PC", 61.0, 0.0, "x"), (13, "7", d, 5.0, "EA", 30.0, 0.0, "x"), (14, "7", d, 5.0, None, 90.0, 0.0, "x")]  # a price by the case; half and one and a half of it are prices
    assert run(spark, il) == [("i", i, "cases", 2000) for i in (9, 10, 11)]
    uom = spark.createDataFrame(UOM, "uom string, dimension string, base_unit string, factor double")
    sizes = unit_sizes(uom)
    told = {(r.basis, r.readings, r.n_overruled) for r in decisions(decode_units(readings(spark.createDataFrame(il, IL), spark.createDataFrame([], SL), sizes), sizes)).collect()}
    assert told == {("stated", 12, 2), ("none", 2, 1)}


def test_a_run_of_unlabelled_rows_switches_once(spark):
    d = "PCN CRSP MPL ORG 6/25 OZ BAG"
    # four doubtful prices, between piece and case, belong to the run of pieces that they follow
    il = [(i, "7", d, 6.0, "CS", 60.0, 0.0, "x") for i in range(1, 12)] + [(i, "7", d, 6.0, "PC", 10.0, 0.0, "x") for i in range(20, 24)] + [(i, "7", d, 6.0, "zak", 24.4, 0.0, "x") for i in range(24, 28)]
    assert run(spark, il) == [("i", i, "cases", 1000) for i in range(20, 28)]


def test_chains_go_on_over_the_border_of_a_block(spark):
    d = "PCN CRSP MPL ORG 6/25 OZ BAG"
    il = [(BLOCK_ROWS - 2, "7", d, 6.0, "PC", None, 0.0, "x"), (BLOCK_ROWS - 1, "7", d, 6.0, "PC", None, 0.0, "x"), (BLOCK_ROWS, "7", d, 6.0, "zak", None, 0.0, "x")]
    assert run(spark, il) == [("i", BLOCK_ROWS + k, "cases", 1000) for k in (-2, -1, 0)]


def test_shipped_units(spark):
    d = "ORGANIC MPL PCN CRSP BAG 6/25 OZ"
    sl = [
        (1, "8", d, 12.0, 5.75, None, f"00008  {d}  lot 707900400  12 PC  5.75 kgs  CO844623", 0), (2, "8", d, 7.0, 16.0, "oz.", f"00008 {d} 707900400 16.00 7cs CO844623", 0),
        (3, "8", d, 3.0, 1448.0, None, f"3LYR | {d} | 00008 | wt 1,448.00 oz. | 555 | 707900400", 0), (4, "8", d, 3.0, None, "KG", None, 0), (5, None, "", 1.0, 1.0, "LB", "", 0), (6, None, None, None, None, None, "y" * 100_000, 0),
    ]
    assert run(spark, sl=sl) == [("s", 1, "cases", 2000), ("s", 1, "weight", 12677), ("s", 2, "weight", 1000), ("s", 3, "cases", 30000), ("s", 3, "weight", 90500)]
    assert run(spark) == []


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.lists(st.floats(-5, 0), min_size=3, max_size=3), min_size=1, max_size=5), min_size=1, max_size=4))
def test_viterbi_against_brute_force(chains):
    import itertools

    emission = np.array([x for c in chains for x in c])
    start = np.array([i == 0 for c in chains for i in range(len(c))])
    path, _ = viterbi(emission, start, 1.5)
    at = 0
    for c in chains:
        cost = lambda p: sum(c[i][s] for i, s in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(cost(p) for p in itertools.product(range(3), repeat=len(c)))
        assert abs(cost(list(path[at : at + len(c)])) - best) < 1e-9
        at += len(c)
