"""Quantities in different units: a hidden Markov model per device with the unit as hidden state.

A device is what is measured again and again, here a trade item on one measure. Its hidden state
is the unit of the recorded value; the observed log value is the log of a level of the device that
is smooth (the median over what its readings state) minus the log of the unit's size. What a unit
column or the line's own text says enters the emission as evidence of a strength of its own: a
column outweighs a text, a text outweighs the base unit that stands where nothing is said. The jump
of a value against the level is evidence too, which has to be some eightfold to outweigh a column.
Viterbi decoding so reads missing and unknown labels from the level, and overrules wrong ones.

Devices are decoded in blocks of row ids, so that a device with a third of all rows is many groups;
a block also reads the rows around it, so that chains go on over its borders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut

#: Unit codes of uom_codes and the ways they are written (letters and digits only, lower case).
COUNT_WORDS = {
    "EA": ("ea", "each"),
    "CS": ("cs", "case", "cases"),
    "CTN": ("ctn", "carton", "cartons", "ctns"),
    "LY": ("ly", "lyr", "lyrs", "layer", "layers"),
    "PL": ("pl", "plt", "pal", "pallet", "pallets", "plts"),
    "PC": ("pc", "pcs", "pce", "piece", "pieces"),
    "DZ": ("dz", "doz", "dzn", "dozen"),
    "TH": ("th", "thoupcs", "per1000pcs", "1000pc", "1000pcs", "mpcs", "thousand"),
}
WEIGHT_WORDS = {
    "LB": ("lb", "lbs", "lbr", "pound", "pounds"),
    "KG": ("kg", "kgs", "kgm", "kilo", "kilos", "kilogram", "kilograms"),
    "G": ("g", "gr", "grm", "gram", "grams"),
    "OZ": ("oz", "ounce", "ounces", "onz"),
    "CWT": ("cwt", "hundredwt", "hundredweight"),
    "TN": ("tn", "stn", "ton", "tons", "shortton", "shorttons"),
}

#: Log-probabilities lost by a state that the column, the text or the base unit speaks against, by a
#: value away from the level at most, and by a switch; SPREAD is that of log values around the level at least.
#: A column therefore yields to a jump of exp(SPREAD * sqrt(2 * (COLUMN_SAYS + 2 * SWITCH))), eightfold.
COLUMN_SAYS, TEXT_SAYS, BASE_SAYS = 30.0, 20.0, 10.0
LEVEL_CAP, SWITCH, SPREAD = 60.0, 3.0, 0.25
#: Standard deviations between the quartiles of a normal distribution.
QUARTILES = 1.349
#: What a state of no size, such as a bundle without a number, loses.
NEVER = 1000.0

#: Row ids of a block, and those around it that are read along. A row that prefers its state by more
#: than two switches parts a chain exactly, so the border tells only in a run of doubtful rows longer than that.
BLOCK_ROWS, AROUND = 1 << 16, 1 << 12


def _squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def _look_up(words: dict[str, tuple[str, ...]], key: Column) -> Column:
    m = F.create_map(*(F.lit(x) for code, ws in words.items() for w in ws for x in (w, code)))
    return F.try_element_at(m, key)


def count_unit(label: Column) -> Column:
    """Code of a count label; 'CS*n' for n cases in one; '?' for a label in no vocabulary; null for none."""
    k = _squash(label)
    many = F.regexp_extract(k, r"^(?:bundle|bdl|pack)?(?:cs|case|cases)?x?(\d+)(?:cs|case|cases)?$", 1)
    bundle = (many != "") & k.rlike("cs|case")
    return F.when(F.coalesce(k, F.lit("")) == "", None).otherwise(F.coalesce(_look_up(COUNT_WORDS, k), F.when(bundle, F.concat(F.lit("CS*"), many)), F.lit("?")))


def weight_unit(label: Column) -> Column:
    """Code of a weight label; '?' for a label in no vocabulary; null for none."""
    k = _squash(label)
    return F.when(F.coalesce(k, F.lit("")) == "", None).otherwise(F.coalesce(_look_up(WEIGHT_WORDS, k), F.lit("?")))


def pieces_per_case(*texts: Column) -> Column:
    """Product of the counts before the ounces in the first text that has a pack; null if none has one."""
    sep = r"\s*(?:CT)?\s*[-/X]\s*"
    out = None
    for t in texts:
        u = F.upper(t)
        pack = lambda n: F.regexp_extract(u, r"(?:(\d+)" + sep + r")?(?:(\d+)" + sep + r")?(\d+)(?:\s*CT\s*|\s*[-/X]\s*)\d+(?:\.\d+)?\s*OZ", n)  # noqa: B023, E731
        n = [F.coalesce(F.try_to_number(F.nullif(pack(i), F.lit("")), F.lit("9" * 9)).cast("double"), F.lit(1.0)) for i in (1, 2, 3)]
        one = F.when(pack(3) != "", n[0] * n[1] * n[2])
        out = one if out is None else F.coalesce(out, one)
    return out


def unit_in_description(description: Column) -> Column:
    """Unit said behind the pack of a description, such as ``(QTY IN PCS)`` or ``per pallet``; null if none."""
    tail = F.lower(F.regexp_extract(description, r"(?i)OZ\s*(?:TUBE|BAG|BOX|CAN|POUCH|STICK|PACK)?((?:[\s(/=-].*)?)$", 1))
    words = F.regexp_replace(tail, r"\b(qty|in|sold|by|the|full|per|of|a)\b", " ")
    code = count_unit(words)
    return F.when(code != "?", code)


_NUM = r"(\d[\d,]*(?:\.\d+)?)"
_WORD = r"\s?([A-Za-z](?:[A-Za-z.]| (?=[A-Za-z]))*)?"
_BUNDLE = r"\s?(\d+[ -]?[A-Za-z]+|[A-Za-z](?:[A-Za-z.]| (?=[A-Za-z]))*(?:\d+ [A-Za-z]+| ?x \d+)?)?"

#: The printed rows of a bill of lading: (mark that only this layout has, pattern, group of the
#: count's unit, group of the weight's unit). The last layout has no mark.
PRINTED_ROWS = (
    ("|", rf"^\s*{_NUM}{_BUNDLE}\s*\|.*\|\s*wt\s*{_NUM}{_WORD}\s*\|", 2, 4),
    (" lot ", rf"\blot\s+\S+\s\s+{_NUM}{_BUNDLE}\s\s+{_NUM}{_WORD}(?:\s\s+\S+)?\s*$", 2, 4),
    ("", rf"\s\d{{6,}}\s{_NUM}{_WORD}\s{_NUM}{_BUNDLE}(?:\s\S+)?\s*$", 4, 2),
)


def units_in_printed_row(raw: Column) -> tuple[Column, Column]:
    """Units of (count, weight) as printed in a shipped line; null where none is printed."""
    count = weight = None
    for mark, pattern, c, w in PRINTED_ROWS:
        hit = raw.contains(mark)
        count = (F.when if count is None else count.when)(hit, F.regexp_extract(raw, pattern, c))
        weight = (F.when if weight is None else weight.when)(hit, F.regexp_extract(raw, pattern, w))
    known = lambda c: F.when(c != "?", c)
    return known(count_unit(count)), known(weight_unit(weight))


def _item(material: Column, description: Column) -> Column:
    """Key of the measured item: material without leading zeros, else the sorted words of the description."""
    m = F.nullif(F.regexp_replace(F.trim(material), r"^0+", ""), F.lit(""))
    words = F.array_join(F.array_sort(F.split(F.upper(F.trim(description)), r"\s+")), " ")
    return F.coalesce(m, F.concat(F.lit("d:"), words), F.lit(""))


def unit_sizes(uom_codes: DataFrame) -> list[tuple[str, str, float]]:
    """(uom, base_unit, factor) of the code table, which has a few rows."""
    return [(r["uom"], r["base_unit"], float(r["factor"])) for r in uom_codes.select("uom", "base_unit", "factor").collect() if r["uom"] is not None]


def stated_factor(said: Column, base: str, ppc: Column, sizes) -> Column:
    """Base units in one of the stated unit, the base unit if none is stated; null for an unknown one."""
    said = F.coalesce(said, F.lit(base))
    known = F.create_map(*(F.lit(x) for u, _, f in sizes for x in (u, f)))
    per = F.coalesce(F.try_element_at(known, said), F.regexp_extract(said, r"^CS\*(\d+)$", 1).try_cast("double"))
    return F.when(said.isin([u for u, b, _ in sizes if b == "piece"]), per / ppc).otherwise(per)


def readings(invoice_lines: DataFrame, shipped_lines: DataFrame, sizes) -> DataFrame:
    """One row per recorded value: src_table, line_id, measure, value, device, observed, said, said_by, ppc.

    ``observed`` is the log of the quantity that has a smooth level per base unit: price per
    recorded unit of an invoiced item, weight and count of a shipped one against each other.
    Null values give no reading.
    """
    il, sl = invoice_lines, shipped_lines
    pos = lambda c: F.when(c > 0, F.log(c))
    col_u, text_u = count_unit(F.col("unit_label")), unit_in_description(F.col("description"))
    invoiced = il.where(F.col("quantity").isNotNull()).select(
        F.lit("invoice_lines").alias("src_table"), F.col("invoice_line_id").cast("long").alias("line_id"), F.lit("cases").alias("measure"),
        F.col("quantity").cast("double").alias("value"), F.concat(F.lit("i:"), _item(F.col("material_number"), F.col("description"))).alias("device"),
        (-pos(F.col("unit_price"))).alias("observed"), F.coalesce(col_u, text_u).alias("said"),
        F.when(col_u.isNotNull(), "column").when(text_u.isNotNull(), "text").alias("said_by"), pieces_per_case(F.col("description")).alias("ppc"),
    )
    raw_c, raw_w = units_in_printed_row(F.col("raw_text"))
    col_w = weight_unit(F.col("weight_uom"))
    base = sl.select(
        F.col("shipped_line_id").cast("long").alias("line_id"), F.col("cases").cast("double").alias("cases"), F.col("weight").cast("double").alias("weight"),
        _item(F.col("material_number"), F.col("description")).alias("item"), raw_c.alias("raw_c"), raw_w.alias("raw_w"), col_w.alias("col_w"),
        pieces_per_case(F.col("description"), F.col("raw_text")).alias("ppc"),
    )
    said_w = F.coalesce("col_w", "raw_w")
    case_log = pos(F.col("cases") * stated_factor(F.col("raw_c"), "CS", F.col("ppc"), sizes))
    pound_log = pos(F.col("weight") * stated_factor(said_w, "LB", F.col("ppc"), sizes))
    both = F.explode(F.array(
        F.struct(F.lit("cases").alias("measure"), F.col("cases").alias("value"), (pos(F.col("cases")) - pound_log).alias("observed"),
                 F.col("raw_c").alias("said"), F.when(F.col("raw_c").isNotNull(), "text").alias("said_by")),
        F.struct(F.lit("weight").alias("measure"), F.col("weight").alias("value"), (pos(F.col("weight")) - case_log).alias("observed"),
                 said_w.alias("said"), F.when(F.col("col_w").isNotNull(), "column").when(F.col("raw_w").isNotNull(), "text").alias("said_by")),
    )).alias("r")
    shipped = base.select("line_id", "item", "ppc", both).where(F.col("r.value").isNotNull()).select(
        F.lit("shipped_lines").alias("src_table"), "line_id", F.col("r.measure").alias("measure"), F.col("r.value").alias("value"),
        F.concat(F.substring("r.measure", 1, 1), F.lit(":"), F.col("item")).alias("device"), F.col("r.observed").alias("observed"),
        F.col("r.said").alias("said"), F.col("r.said_by").alias("said_by"), "ppc",
    )
    return invoiced.unionByName(shipped)


def viterbi(emission: np.ndarray, start: np.ndarray, switch: float, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best state paths of many chains laid end to end in ``emission`` (rows, states) of log-scores.

    ``start`` marks the first row of each chain; a first row that goes on a chain of the previous
    call takes that chain's scores from ``before``. Returns the states, and the scores behind the
    last row. All chains advance together, one step a turn.
    """
    n, s = emission.shape
    state = np.zeros(n, dtype=np.int64)
    if n == 0:
        return state, before if before is not None else np.zeros(s)
    first = np.flatnonzero(start | (np.arange(n) == 0))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    back = np.zeros((n, s), dtype=np.int8)
    score = np.zeros((len(first), s))
    if before is not None and not start[0]:
        prior = before
        k = int(np.flatnonzero(first == 0)[0])
        stay, move = prior, prior.max() - switch
        score[k] = np.maximum(stay, move)
    score += emission[first]
    alive = len(first)
    for t in range(1, int(length[0])):
        while length[alive - 1] <= t:
            alive -= 1
        rows = first[:alive] + t
        live = score[:alive]
        best = live.argmax(axis=1)
        move = live[np.arange(alive), best] - switch
        jump = move[:, None] > live
        back[rows] = np.where(jump, best[:, None], np.arange(s)[None, :])
        score[:alive] = np.where(jump, move[:, None], live) + emission[rows]
    now = score.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        on = np.searchsorted(-length, -t, side="left")  # chains longer than t
        rows = first[:on] + t
        state[rows] = now[:on]
        if t:
            now[:on] = back[rows, now[:on]]
    tail = score[int(np.argmax(first + length))]
    return state, tail - tail.max()


def decode_units(read: DataFrame, sizes) -> DataFrame:
    """Readings with their decoded unit: src_table, line_id, measure, value, said, ``unit`` and ``factor`` (base units in one unit).

    Pieces per case come from the reading's own text, else from the device's other readings; with
    neither, ``factor`` of a piece unit is null. ``sizes`` is that of ``unit_sizes``.
    """
    in_base = {u: f for u, _, f in sizes}
    piece = {u for u, b, _ in sizes if b == "piece"}
    count_states = [u for u, b, _ in sizes if b in ("case", "piece")] + ["CS*n"]
    weight_states = [u for u, b, _ in sizes if b == "pound"]

    # the level: median over the readings by what they state or by the base unit, pre-aggregated per device
    per = F.when(F.col("measure") == "weight", stated_factor(F.col("said"), "LB", F.col("ppc"), sizes)).otherwise(stated_factor(F.col("said"), "CS", F.col("ppc"), sizes))
    level = read.groupBy("device").agg(
        F.percentile_approx(F.when(per > 0, F.col("observed") + F.log(per)), [0.25, 0.5, 0.75], 1000).alias("q"), F.max("ppc").alias("device_ppc"),
    )
    # a device whose readings do not agree has a level that tells little
    level = level.select("device", "device_ppc", F.col("q")[1].alias("level"), F.greatest(F.lit(SPREAD), (F.col("q")[2] - F.col("q")[0]) / QUARTILES).alias("spread"))
    own = F.floor(F.col("line_id") / BLOCK_ROWS)
    near = F.array_distinct(F.array(own, F.floor((F.col("line_id") - AROUND) / BLOCK_ROWS), F.floor((F.col("line_id") + AROUND) / BLOCK_ROWS)))
    with_level = read.join(level, "device", "left").select("*", own.alias("own"), F.explode(near).alias("block"))
    chained = with_level.repartition("device", "block").sortWithinPartitions("device", "block", "line_id", "value")

    def decode(batches):
        last, tail, tail_states = None, None, None
        for pdf in batches:
            n = len(pdf)
            key = (pdf["device"] + "|" + pdf["block"].astype(str)).to_numpy(dtype=object)
            weight = pdf["measure"].to_numpy() == "weight"
            said = pdf["said"].to_numpy(dtype=object)
            by = pdf["said_by"].to_numpy(dtype=object)
            ppc = pdf["ppc"].fillna(pdf["device_ppc"]).to_numpy(dtype=float)
            observed, lev, spread = (pdf[c].to_numpy(dtype=float) for c in ("observed", "level", "spread"))
            unit = np.empty(n, dtype=object)
            factor = np.full(n, np.nan)
            for kind, states in ((False, count_states), (True, weight_states)):
                at = np.flatnonzero(weight == kind)
                if not len(at):
                    continue
                index = {u: i for i, u in enumerate(states)}
                size = np.ones((len(at), len(states)))
                for u, i in index.items():
                    size[:, i] = in_base.get(u, 1.0)
                    if u in piece:
                        size[:, i] /= ppc[at]
                sub = said[at]
                bundle = np.array([float(x[3:]) if isinstance(x, str) and x.startswith("CS*") else np.nan for x in sub])
                if "CS*n" in index:
                    size[:, index["CS*n"]] = bundle
                with np.errstate(divide="ignore", invalid="ignore"):
                    miss = np.abs(observed[at, None] + np.log(size) - lev[at, None]) / spread[at, None]
                emission = -np.minimum(np.nan_to_num(miss * miss / 2, nan=LEVEL_CAP), LEVEL_CAP)
                base = index["LB" if kind else "CS"]
                code = np.array([index.get("CS*n" if isinstance(x, str) and x.startswith("CS*") else x, -1) if isinstance(x, str) else base for x in sub])
                cost = np.where(pd.isna(sub), BASE_SAYS, np.where(by[at] == "column", COLUMN_SAYS, TEXT_SAYS))
                stated = np.flatnonzero(code >= 0)
                emission[stated] -= cost[stated, None]
                emission[stated, code[stated]] += cost[stated]
                if "CS*n" in index:  # no bundle without a stated size
                    emission[np.isnan(bundle), index["CS*n"]] -= NEVER
                k = key[at]
                start = np.append(True, k[1:] != k[:-1])
                goes_on = tail is not None and at[0] == 0 and k[0] == last and tail_states == kind
                start[0] = not goes_on
                path, tail_now = viterbi(emission, start, SWITCH, tail if goes_on else None)
                unit[at] = [states[p] if states[p] != "CS*n" else s for p, s in zip(path, sub)]
                factor[at] = size[np.arange(len(at)), path]
                if at[-1] == n - 1:
                    keep = (k[-1], tail_now, kind)
            last, tail, tail_states = keep if n else (last, tail, tail_states)
            out = pd.DataFrame({"src_table": pdf["src_table"], "line_id": pdf["line_id"], "measure": pdf["measure"], "value": pdf["value"], "said": pdf["said"], "unit": unit, "factor": factor})
            yield out[(pdf["own"] == pdf["block"]).to_numpy()]

    return chained.mapInPandas(decode, "src_table string, line_id bigint, measure string, value double, said string, unit string, factor double")


#: Units that are one base unit.
ONE = ("EA", "CS", "CTN", "LB")


def converted(decoded: DataFrame) -> DataFrame:
    """Recorded values whose unit is not one base unit, in thousandths of cases or pounds, rounded half up.

    Null values have no row. Zero and negative values are converted like others. A piece unit
    without any pack text gives a null amount. Repeated lines count each; ties cannot arise, as a
    chain is ordered by row id; empty tables give no rows; a null material or description makes
    the other the device; other columns are ignored.
    """
    # a double a hair below a half comes from binary fractions of decimal values
    milli = F.floor(F.col("value") * F.col("factor") * 1000 + F.lit(0.5 + 1e-6)).cast("long")
    return decoded.where(~F.col("unit").isin(*ONE)).select("src_table", "line_id", "measure", F.when(~F.isnan("factor"), milli).alias("amount_milli"))


def decisions(decoded: DataFrame) -> DataFrame:
    """measure, basis, readings, n_overruled: how many readings state a known unit, an unknown one or
    none, and how many of each were decoded to another unit than the one stated or the base unit."""
    base = F.when(F.col("measure") == "weight", "LB").otherwise("CS")
    basis = F.when(F.col("said").isNull(), "none").when(F.col("said") == "?", "unknown").otherwise("stated")
    return decoded.groupBy("measure", basis.alias("basis")).agg(F.count(F.lit(1)).alias("readings"), F.count_if(F.col("unit") != F.when(F.col("said").isNull() | (F.col("said") == "?"), base).otherwise(F.col("said"))).alias("n_overruled"))


def convert_units(invoice_lines: DataFrame, shipped_lines: DataFrame, uom_codes: DataFrame) -> DataFrame:
    """src_table, line_id, measure, amount_milli of every recorded value that is not in base units; see ``converted``."""
    sizes = unit_sizes(uom_codes)
    # the patterns of the readings run once, not once for the level and once for the chains
    return converted(decode_units(cut(readings(invoice_lines, shipped_lines, sizes)), sizes))
