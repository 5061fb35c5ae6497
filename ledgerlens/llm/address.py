"""Same postal address written differently.

Texts are parsed into components: company and its site number, house number, unit, direction,
street tokens, street type, city, state, postcode. Candidates come from a deletion-neighbourhood
index on the street's tokens inside blocks of the postcode and of neighbouring localities: a token
is indexed by its forms with one letter removed, a long one by those of its first and last letters,
which two edits cannot both reach. A candidate pair is judged by the optimal assignment of its
street tokens and of its names, with hard vetoes on house number, unit, direction, numbered street,
street type, state, postcode and city. What is linked forms places, in which no veto may remain: a
text that lacks what its place disagrees on leaves it and joins the one place that all its partners
are in. Texts without a street join the one place of their company's site, or are one of their own.
Texts with number, street and locality are linked within one house number only, so their places are
settled where the texts of that number are; only the other texts take rounds over all of them.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut, fresh_cut

# fixed values: abbreviations of United States addresses
STREET_TYPES = {
    "LANE": "LN", "LN": "LN", "ROAD": "RD", "RD": "RD", "STREET": "ST", "STR": "ST", "ST": "ST", "COURT": "CT", "CT": "CT", "DRIVE": "DR", "DRV": "DR", "DR": "DR",
    "PARKWAY": "PKWY", "PARKWY": "PKWY", "PKWY": "PKWY", "PKY": "PKWY", "BOULEVARD": "BLVD", "BOUL": "BLVD", "BLVD": "BLVD", "AVENUE": "AVE", "AVE": "AVE", "AV": "AVE",
    "WAY": "WAY", "HIGHWAY": "HWY", "HWY": "HWY", "PLACE": "PL", "TERRACE": "TER", "TER": "TER", "CIRCLE": "CIR", "CIR": "CIR",
}
DIRECTIONS = {"NORTH": "N", "N": "N", "NO": "N", "SOUTH": "S", "S": "S", "SO": "S", "EAST": "E", "E": "E", "WEST": "W", "W": "W"}
CITY_WORDS = {"JCT": "JUNCTION", "SPGS": "SPRINGS", "HTS": "HEIGHTS", "FLS": "FALLS", "MT": "MOUNT", "FT": "FORT"}
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
ORDINALS = {
    "FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH", "EIGHTH": "8TH", "NINTH": "9TH", "TENTH": "10TH", "ELEVENTH": "11TH", "TWELFTH": "12TH",
    "THIRTEENTH": "13TH", "FOURTEENTH": "14TH", "FIFTEENTH": "15TH", "SIXTEENTH": "16TH", "SEVENTEENTH": "17TH", "EIGHTEENTH": "18TH", "NINETEENTH": "19TH",
}
TENS = {"TWENT": 20, "THIRT": 30, "FORT": 40, "FIFT": 50, "SIXT": 60, "SEVENT": 70, "EIGHT": 80, "NINET": 90}

_DESK = r"(?:INBOUND|OUTBOUND|RECEIVING|SHIPPING|LOGISTICS|DELIVER(?:Y|IES)|GOODS[ -]IN|DOCK|WAREHOUSE)"
_NOTES = re.compile(
    rf"\b(?:C/O|ATTN|ATTENTION)\b:?\s+{_DESK}(?:\s+(?:DESK|DEPT\.?|DEPARTMENT|OFFICE|CLERK|MANAGER|TEAM)\b)?|\b(?:C/O|ATTN|ATTENTION|CARE OF)\b[^,;/|]*"
    r"|\b(?:REAR|FRONT|SIDE|MAIN|TRUCK)\s+(?:GATE|DOCK|DOOR|ENTRANCE)\b|\b(?:DOCK|BAY|GATE)\s+(?:(?:DOOR|NO\.?)\s+)?#?\d+\b|\bU\.?S\.?A\.?(?=\W|$)|\bUNITED STATES(?: OF AMERICA)?\b"
)
_BOX = re.compile(r"\b(?:P\.?\s?O\.?|POST OFFICE)\s?BOX\s+#?0*(\d+)\b")
_SITE = re.compile(r"(?:\bD\.?\s?C\.?\s*#?\s*0*(\d{1,3})\b|\bDIST(?:RIBUTION|\.)?\s+(?:CENTER|CTR\.?)\s+(?:NO\.?\s*|#\s*)?0*(\d{1,3})\b|#\s*0*(\d{1,4})\b|\bNO\.?\s*0+(\d{1,3})\b|\bNO\.?\s+(\d{3})\b|\bNO\.?\s*(\d{1,3})\b(?=\s*(?:[,;/|]|$)))")
_COUNTY = re.compile(r"\b(?:COUNTY|CNTY\.?|CO\.?|CTY\.?)\s+(?:ROAD|RD\.?)\s+(\d+)\b|\bC\.?R\.?\s+(\d+)\b")
_UNIT = re.compile(r"\b(?:SUITE|STE\.?|UNIT|APT\.?|BLDG\.?|ROOM|RM\.?)\s+#?([A-Z0-9]+)\b")
_STATE_NAMES = re.compile(r"\b(" + "|".join(sorted(map(re.escape, STATES), key=len, reverse=True)) + r")\b")
_CODES = set(STATES.values())

PARTS = "num string, unit string, dir string, street string, stype string, city string, state string, zip string, brand string, site string"
_FIELDS = [x.split()[0] for x in PARTS.split(", ")]


def _ordinal(w: str) -> str:
    if w in ORDINALS:
        return ORDINALS[w]
    for stem, n in TENS.items():
        if w == stem + "IETH":
            return f"{n}TH"
    return w


def parse_address(text: str) -> dict[str, str]:
    """Components of one address text, '' where missing; the street's tokens are parted by spaces."""
    out = _parse(text, True)
    if out["site"] and not out["num"] and (other := _parse(text, False))["stype"]:
        return other  # what looked like the site's number is the house number
    return out


def _parse(text: str, with_site: bool) -> dict[str, str]:
    out = dict.fromkeys(_FIELDS, "")
    t = re.sub(r"\s*\n\s*|\s*;\s*|\s+/\s+|\s*,\s*|\s*\|\s*", " | ", text.upper().strip())
    t = re.sub(r"[^\S\n]+", " ", t)
    t = _NOTES.sub(" | ", t)
    box = _BOX.search(t)
    t = _BOX.sub(" | ", t)
    if m := _UNIT.search(t):
        out["unit"] = m[1]
        t = t[: m.start()] + " | " + t[m.end() :]
    t = _COUNTY.sub(lambda m: f"COUNTYROAD{m[1] or m[2]} CNTYRD", t)
    t = _STATE_NAMES.sub(lambda m: " %" + STATES[m[1]] + " ", t)
    if with_site and (m := _SITE.search(t)):
        out["site"] = next(g for g in m.groups() if g)
        t = t[: m.start()] + " @ " + t[m.end() :]
    words = [w for w in re.sub(r"[.]", " ", t).replace("&", " & ").split()]
    # a postcode of nine digits is unmistakable; else it is a number of five digits that no street follows
    for i, w in enumerate(words):
        if re.fullmatch(r"\d{5}-\d{4}", w):
            out["zip"], words[i] = w[:5], "|"
    # street: house number, then at most five words up to a street type
    best = None
    for i, w in enumerate(words):
        if not re.fullmatch(r"\d{1,5}", w):
            continue
        name, d, ty, j = [], "", "", i + 1
        while j < len(words) and j <= i + 6 and words[j] not in ("|", "@") and not words[j].startswith("%"):
            x = words[j]
            if x == "CNTYRD":
                ty = "CR"
                j += 1
                break
            if x in STREET_TYPES and name:
                ty = STREET_TYPES[x]
                j += 1
                break
            if x in DIRECTIONS and not name and not d:
                d = DIRECTIONS[x]
            elif x.isdigit():
                break
            else:
                name.append(_ordinal(x))
            j += 1
        if name and (ty or j >= len(words) or words[j] in ("|", "@")):
            score = (bool(ty), -len(name))
            if best is None or score > best[0]:
                best = (score, i, j, name, d, ty)
    if best is not None and (best[5] or len(best[3]) <= 3):
        _, i, j, name, d, ty = best
        if j < len(words) and words[j] in DIRECTIONS and not d and ty:
            d = DIRECTIONS[words[j]]
            j += 1
        out |= {"num": words[i].lstrip("0") or "0", "street": " ".join(name), "stype": ty, "dir": d}
        words[i:j] = ["|"]
    elif box:  # a post office box is a place of its own kind
        out |= {"num": box[1], "street": "POBOX", "stype": "BOX"}
    if not out["zip"]:
        for i in range(len(words) - 1, -1, -1):
            if re.fullmatch(r"\d{5}", words[i]):
                out["zip"], words[i] = words[i], "|"
                break
    # the rest in chunks; a chunk with the state behind it is the city, one with the site behind it the company
    chunks: list[tuple[list[str], str]] = []
    now: list[str] = []
    for w in words + ["|"]:
        if w == "|" or w == "@":
            if now:
                chunks.append((now, w))
            elif w == "@" and chunks:  # the site number after a separator
                chunks[-1] = (chunks[-1][0], "@")
            now = []
        else:
            now.append(w)
    company, city = [], []
    split: list[tuple[list[str], str]] = []
    for ws, end in chunks:  # a company without a separator behind it
        k = max((i for i, w in enumerate(ws) if w in COMPANY_WORDS or len(w) == 1), default=-1)
        split += [(ws, end)] if end == "@" or k < 0 or k + 1 == len(ws) else [(ws[: k + 1], "|"), (ws[k + 1 :], end)]
    for ws, end in split:
        state = next((k for k in range(len(ws) - 1, -1, -1) if ws[k].startswith("%") or (ws[k] in _CODES and (k == len(ws) - 1 or len(ws) == k + 1))), None)
        if state is not None and end != "@" and not any(w in COMPANY_WORDS for w in ws):
            out["state"] = ws[state].lstrip("%")
            ws = ws[:state]
            if ws:
                city.append(ws)
        elif end == "@" or any(w in COMPANY_WORDS for w in ws):
            company.append(ws)
        elif all(re.fullmatch(r"[A-Z'’-]+", w) for w in ws):
            city.append(ws)
    if len(city) > 1:  # a company without a mark of its own stands first or last; the city is next to the state
        rest = [c for c in city if len(c) <= 2]
        company += [c for c in city if c not in rest]
        if len(rest) > 1:
            company += rest[:-1]
            rest = rest[-1:]
        city = rest or city[-1:]
    if city:
        out["city"] = "".join(CITY_WORDS.get(w, w) for w in city[-1])
    if company:
        out["brand"] = company[0][0]
    return out


#: fixed values: words that only a company's name holds
COMPANY_WORDS = frozenset(
    "FOODS FOOD STORES STRS STORE INC LLC LTD WAREHOUSE WHSE WHOLESALE WHSL MARKETS MARKET MKTS MKT GROCERY GROCERS DIST DISTRIBUTION CENTER CTR DC CLUB PANTRY RETAIL GROUP FRESH TRADING COOPERATIVE SUPERMARKETS PROVISIONS HALLS & CASH CARRY CO COMPANY".split()
)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours, or ``most`` if that is less."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= most:
        return most
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return min(one[-1], most)


def deletions(s: str) -> set[str]:
    """The token and its forms with one letter removed."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


#: Letters from which a token may have two edits, and the letters of its start and end that are indexed.
LONG, END = 9, 4


def token_forms(t: str) -> set[str]:
    """What a street token is indexed by: tokens within one edit share a form, of long ones those
    within two, of which either the first or the last letters have one at most. A number only itself."""
    if any(c.isdigit() for c in t):
        return {t}
    out = deletions(t) if len(t) < LONG else set()
    if len(t) >= LONG - 2:
        out |= {"^" + f for f in deletions(t[:END])} | {"$" + f for f in deletions(t[-END:])}
    return out


def best_assignment(worth: list[list[float]]) -> float:
    """Greatest total of ``worth`` when every row takes at most one column and every column serves one row; exact."""
    best = {0: 0.0}
    for row in worth:
        new = dict(best)
        for used, total in best.items():
            for k, w in enumerate(row):
                if w > 0 and not used >> k & 1 and new.get(used | 1 << k, -1.0) < total + w:
                    new[used | 1 << k] = total + w
        best = new
    return max(best.values())


#: Least agreement of the assigned components of one place, of at most 1.
LEAST = 0.6
#: Components by which a pair can be vetoed, as bits.
VETOES = {k: 1 << i for i, k in enumerate(("unit", "dir", "stype", "state", "zip", "city", "num", "street"))}
#: Too far apart to be linked, but both may be slips of one spelling between them; so no veto for a place.
SLIP = 1 << len(VETOES)


def _tokens_alike(x: str, y: str) -> float:
    """1 for equal tokens, less by a third an edit; 0 for different ones."""
    if x == y:
        return 1.0
    if any(c.isdigit() for c in x + y):
        return 0.0
    d = edits(x, y)
    return 1 - d / 3 if d <= (2 if min(len(x), len(y)) >= LONG else 1) else 0.0


def streets_alike(a: str, b: str) -> float:
    """Agreement of two streets from 0 to 1 by the optimal assignment of their tokens, 0 if they are different.

    Every token of the shorter one has to find its own in the other; streets that differ only by
    spaces are equal. Numbered tokens have to be equal and on both sides.
    """
    if a == b:
        return 1.0
    whole = _tokens_alike(a.replace(" ", ""), b.replace(" ", ""))
    x, y = sorted((a.split(), b.split()), key=len)
    if sorted(t for t in x if t[0].isdigit()) != sorted(t for t in y if t[0].isdigit()):
        return whole
    alike = [[_tokens_alike(p, q) for q in y] for p in x]
    if not all(any(row) for row in alike):
        return whole
    total = best_assignment(alike)
    return max(whole, total / len(y) if total > len(x) - 1 else 0.0)


def streets_apart(a: str, b: str) -> bool:
    """Whether no third spelling can be within reach of both streets."""
    x, y = a.replace(" ", ""), b.replace(" ", "")
    return any(c.isdigit() for c in x + y) or edits(x, y, 5) > (4 if min(len(x), len(y)) >= LONG else 2)


def assignment(a, b) -> tuple[float, int]:
    """(agreement of two parsed addresses from 0 to 1, VETOES and SLIP against it).

    Components are assigned to those of their kind, the tokens of the street among each other, city
    and company so that their total is best, as they may change roles. A component that one side
    lacks neither helps nor harms; a street token does if postcode, city or company do not stand in.
    """
    veto = 0
    for k in ("num", "unit", "dir", "stype", "state"):
        if a[k] and b[k] and a[k] != b[k]:
            veto |= VETOES[k]
    got = most = 0.0
    shares = street = a["street"] and b["street"]
    if street:
        alike = streets_alike(a["street"], b["street"])
        apart = not alike and streets_apart(a["street"], b["street"])
        dropped = len(a["street"].split()) != len(b["street"].split()) and a["street"].replace(" ", "") != b["street"].replace(" ", "")
        if not alike:
            veto |= VETOES["street"] if apart else SLIP
        got, most = got + 3 * alike, most + 3
    near = same_zip = False
    if a["zip"] and b["zip"]:
        d = edits(a["zip"], b["zip"])
        if d > 1:
            veto |= VETOES["zip"] if d > 2 else SLIP
        else:
            near = same_zip = True
        got, most = got + max(0, 2 - d), most + 2
    same_city = False
    if a["city"] and b["city"]:
        alike = lambda x, y: max(0.0, 1 - edits(x, y) / 4) if x and y and edits(x, y) <= 2 else 0.0
        # names: the city of one may be read as the company of the other
        worth = best_assignment([[alike(a["city"], b["city"]), alike(a["city"], b["brand"])], [alike(a["brand"], b["city"]), 0.0]])
        if not worth:
            veto |= VETOES["city"] if edits(a["city"], b["city"], 4) > 3 else SLIP
        else:
            near = same_city = True
        got, most = got + 2 * min(1.0, worth), most + 2
    same_brand = bool(a["brand"]) and a["brand"] == b["brand"]
    if same_brand and a["state"] and b["state"]:
        near = True
    site = bool(a["site"]) and a["site"] == b["site"] and same_brand
    if site:
        got, most = got + 1, most + 1
    if veto:
        return 0.0, veto
    if street and dropped and not (same_zip + same_city + site >= 2):
        return 0.0, 0
    return (got / most if (near or site if shares else site and near) else 0.0), 0


@lru_cache(maxsize=20_000)
def street_forms(street: str) -> frozenset[str]:
    """What a street is indexed by: the forms of its tokens, and of all of them as one word that another text writes."""
    return frozenset(f for t in {*street.split(), street.replace(" ", "")} for f in token_forms(t))


def localities(p) -> list[str]:
    """The blocks in which texts of one house number are compared."""
    blocks = {"z": "".join(sorted(p["zip"])), "c": p["city"][:2], "s": p["state"], "b": p["brand"]}
    return [k + v for k, v in blocks.items() if v]


class Near:
    """Finds the earlier ones of the texts of one house number that a text is compared with: those with
    a street that shares a form, in one of its localities, and those of the company's site.

    It holds the forms of each different street once.
    """

    def __init__(self) -> None:
        self.streets, self.by_form, self.rows = {}, defaultdict(list), defaultdict(list)

    def add(self, i: int, p) -> list[int]:
        """The earlier ones, in order; ``i`` is an earlier one from now on."""
        street = p["street"]
        if street not in self.streets:
            forms = street_forms(street)
            self.streets[street] = {t for f in forms for t in self.by_form.get(f, ())}
            for t in self.streets[street]:
                self.streets[t].add(street)
            self.streets[street].add(street)
            for f in forms:
                self.by_form[f].append(street)
        blocks = localities(p)
        keys = [(street, b) for b in blocks]
        asked = [(t, b) for t in self.streets[street] for b in blocks]
        if p["brand"] and p["site"]:
            keys.append((p["brand"], p["site"], "@"))
            asked.append(keys[-1])
        found = sorted({j for k in asked for j in self.rows.get(k, ())})
        for k in keys:
            self.rows[k].append(i)
        return found


def parse_all(texts: DataFrame) -> DataFrame:
    """text, the number that equal components share, whether a street and locality anchor it, whether
    it names a place at all, VETOES that it lacks, and its components."""

    def run(batches):
        for pdf in batches:
            rows = [parse_address(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=_FIELDS)
            out.insert(0, "text", pdf["text"].to_numpy())
            out["lacks"] = [sum(bit for k, bit in VETOES.items() if not r[k]) for r in rows]
            yield out

    parsed = texts.mapInPandas(run, f"text string, {PARTS}, lacks int")
    sig = F.xxhash64(*(F.col(f) for f in _FIELDS))
    local = (F.col("city") != "") | (F.col("zip") != "")
    anchored = (F.col("num") != "") & (F.col("street") != "") & local
    placed = anchored | ((F.col("brand") != "") & (F.col("site") != "") & local)
    return parsed.select("text", sig.alias("sig"), anchored.alias("anchored"), placed.alias("placed"), "lacks", *_FIELDS)


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, comp: least node of each connected component; links (a, b) in either direction.

    Every round lets a node take the least label of its neighbours and of its label's label, and
    ends when nothing changes; each round's labels are checkpointed without the plan's size estimates, which every round would
    multiply with each other.
    """
    both = fresh_cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = fresh_cut(nodes.select("node", F.col("node").alias("comp")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("low", "comp")).alias("mid"))
        hop = step.alias("x").join(step.select(F.col("node").alias("n2"), F.col("mid").alias("far")), F.col("x.mid") == F.col("n2"), "left")
        new = fresh_cut(hop.select("node", "was", F.least("mid", F.coalesce("far", "mid")).alias("comp")))
        moved = new.where(F.col("was") != F.col("comp")).limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _comps_of(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``edges`` (a, b, ...) with the components ca and cb of their ends, where both have one."""
    ends = [comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in ("a", "b")]
    return edges.join(ends[0], "a").join(ends[1], "b")


def _joined(nodes: DataFrame, links: DataFrame, comps: DataFrame) -> DataFrame:
    """node, comp of those ``nodes`` whose links into ``comps`` all lead to one component."""
    either = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    reached = either.join(nodes.select("node"), "node").join(comps.select(F.col("node").alias("to"), "comp"), "to")
    return reached.groupBy("node").agg(F.min("comp").alias("comp"), F.max("comp").alias("last")).where(F.col("comp") == F.col("last")).select("node", "comp")


def settle(nodes: DataFrame, links: DataFrame, vetoes: DataFrame) -> DataFrame:
    """node, comp: components in which no veto remains.

    ``nodes`` has node and lacks, ``links`` a, b and score, ``vetoes`` a, b and veto, the components
    that speak against the pair. Where a component holds a vetoed pair, the nodes that lack what it
    is about leave it, and come back where all that they are linked to is one component. Where full
    nodes are still chained across a veto, only links of full agreement stay.
    """
    comps = components(nodes, links)

    def broken(comps):
        return fresh_cut(_comps_of(vetoes, comps).where("ca = cb").groupBy(F.col("ca").alias("comp")).agg(F.bit_or("veto").alias("veto")))

    bad = broken(comps)
    if bad.isEmpty():
        return comps
    state = comps.join(bad, "comp", "left").join(nodes.select("node", "lacks"), "node")
    leaves = F.coalesce(F.col("veto").bitwiseAND(F.col("lacks")) != 0, F.lit(False))
    away = fresh_cut(state.where(leaves).select("node"))
    stay = fresh_cut(state.where(~leaves).select("node"))
    kept = links.join(stay.withColumnRenamed("node", "a"), "a", "left_semi").join(stay.withColumnRenamed("node", "b"), "b", "left_semi")
    comps = components(stay, kept)
    still = broken(comps)
    if not still.isEmpty():
        sure = _comps_of(kept, comps).join(still.select(F.col("comp").alias("ca"), F.lit(True).alias("split")), "ca", "left").where(F.col("split").isNull() | (F.col("score") >= 1)).select("a", "b")
        comps = components(stay, sure)
    for _ in range(2):  # the second time along those that came back
        back = _joined(away.join(comps, "node", "left_anti"), links, comps)
        comps = fresh_cut(comps.unionByName(back))
    return comps


def settle_here(lacks: dict[int, int], links: list[tuple[int, int, float]], vetoes: tuple) -> dict[int, int]:
    """What ``settle`` says of nodes that are all at hand: node -> component. ``vetoes`` has the columns a, b and veto."""

    def labels(nodes, links):
        root = {n: n for n in nodes}

        def find(n):
            while root[n] != n:
                root[n] = n = root[root[n]]
            return n

        for a, b, _ in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {n: find(n) for n in root}

    def broken(comps):
        bad: dict[int, int] = defaultdict(int)
        for a, b, veto in zip(*vetoes):
            if a in comps and comps[a] == comps.get(b):
                bad[comps[a]] |= veto
        return bad

    comps = labels(lacks, links)
    if not (bad := broken(comps)):
        return comps
    stay = [n for n, lack in lacks.items() if not bad.get(comps[n], 0) & lack]
    away = lacks.keys() - set(stay)
    kept = [x for x in links if x[0] not in away and x[1] not in away]
    comps = labels(stay, kept)
    if still := broken(comps):
        comps = labels(stay, [x for x in kept if comps[x[0]] not in still or x[2] >= 1])
    for _ in range(2):  # the second time along those that came back
        reached = defaultdict(set)
        for a, b, _score in links:
            for n, to in ((a, b), (b, a)):
                if n in away and n not in comps and to in comps:
                    reached[n].add(comps[to])
        comps |= {n: min(to) for n, to in reached.items() if len(to) == 1}
    return comps


#: What is said of pairs: a, b, the number of their anchored ends, score and veto. With ``strong`` = 2: the place b of the anchored text a.
SAID = "a long, b long, strong int, score double, veto int"


def _groups(batches, by: list[str]):
    """Lists of rows that agree in ``by``, of batches that are sorted by it."""
    rows = (r for pdf in batches for r in pdf.to_dict("records"))
    for _, group in itertools.groupby(rows, key=lambda r: [r[c] for c in by]):
        yield list(group)


def _frames(rows):
    for some in itertools.batched(rows, 10_000):
        yield pd.DataFrame(some, columns=[x.split()[0] for x in SAID.split(", ")])


def _telling(score: float, veto: int) -> bool:
    return score >= LEAST or bool(veto & (SLIP - 1))


def of_one_number(batches):
    """SAID of texts with a street, sorted by house number: the places of the anchored ones, and the pairs of the others."""

    def said():
        for group in _groups(batches, ["num"]):
            near, links, vetoes = Near(), [], (array("q"), array("q"), array("H"))
            for i, q in enumerate(group):
                for j in near.add(i, q):
                    p = group[j]
                    score, veto = assignment(p, q)
                    if not _telling(score, veto):
                        continue
                    strong = int(p["anchored"]) + int(q["anchored"])
                    if strong < 2:
                        yield p["sig"], q["sig"], strong, score, veto
                    elif score > 0:
                        links.append((p["sig"], q["sig"], score))
                    else:
                        for column, x in zip(vetoes, (p["sig"], q["sig"], veto & (SLIP - 1))):
                            column.append(x)
            for node, comp in settle_here({r["sig"]: r["lacks"] for r in group if r["anchored"]}, links, vetoes).items():
                yield node, comp, 2, 1.0, 0

    return _frames(said())


def of_one_site(batches):
    """SAID of texts with a company's site, sorted by it: those pairs with an end that is not anchored that are not of one house number."""

    def said():
        for group in _groups(batches, ["brand", "site"]):
            weak = [not r["anchored"] for r in group]
            some = [j for j, w in enumerate(weak) if w]
            for i, q in enumerate(group):
                for j in range(i) if weak[i] else itertools.takewhile(lambda j: j < i, some):
                    p = group[j]
                    if p["num"] == q["num"] and p["num"] and p["street"] and q["street"]:
                        continue
                    score, veto = assignment(p, q)
                    if _telling(score, veto):
                        yield p["sig"], q["sig"], int(p["anchored"]) + int(q["anchored"]), score, veto

    return _frames(said())


def places(texts: DataFrame) -> DataFrame:
    """text, place: the place of each distinct text that can be placed."""
    parsed = cut(parse_all(texts.where(F.col("text").isNotNull() & (F.trim("text") != "")).select("text").distinct()))
    sigs = cut(parsed.drop("text").dropDuplicates(["sig"]))
    facts = sigs.select("sig", "anchored", "lacks", *_FIELDS)
    numbered = facts.where("num <> '' and street <> ''").repartition("num").sortWithinPartitions("num", "sig")
    sited = facts.where("brand <> '' and site <> ''").repartition("brand", "site").sortWithinPartitions("brand", "site", "sig")
    judged = fresh_cut(numbered.mapInPandas(of_one_number, SAID).unionByName(sited.mapInPandas(of_one_site, SAID)))
    strong = judged.where("strong = 2").select(F.col("a").alias("node"), F.col("b").alias("comp"))
    pairs = judged.where("strong < 2")
    links, vetoes = pairs.where("score > 0"), pairs.where(F.col("veto").bitwiseAND(F.lit(SLIP - 1)) > 0)
    node = sigs.select(F.col("sig").alias("node"), "anchored", "placed", "lacks")
    # texts without street or locality: what belongs together goes to the one place that it fits, and is one of its own if it fits none
    weak = node.where(~F.col("anchored"))
    loose = settle(weak, links.where("strong = 0"), vetoes.where("strong = 0"))
    out = links.where("strong = 1")
    reach = out.select(F.col("a").alias("node"), F.col("b").alias("to")).union(out.select(F.col("b").alias("node"), F.col("a").alias("to")))
    reach = reach.join(loose.withColumnRenamed("comp", "group"), "node").join(strong.select(F.col("node").alias("to"), "comp"), "to")
    ends = fresh_cut(reach.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")))
    grouped = loose.join(ends, loose["comp"] == ends["group"], "left").select("node", "comp", "low", "high")
    own = grouped.where("low is null").join(weak.where("placed").select("node"), "node", "left_semi").select("node", "comp")
    one = grouped.where("low = high").select("node", F.col("low").alias("comp"))
    each = _joined(grouped.where("low < high").select("node"), out, strong)
    placed = strong.unionByName(own).unionByName(one).unionByName(each)
    return parsed.select("text", "sig").join(placed, F.col("sig") == F.col("node")).select("text", F.col("comp").alias("place"))


def same_places(texts: DataFrame) -> DataFrame:
    """Pairs of different texts of one place: ship_to_a < ship_to_b in byte order.

    ``texts`` has one column ``text``. Null and blank texts give no row, repeated ones count once.
    A text that names neither a street or box in a locality nor a company's site in one, or that
    fits several places, is in no pair. Texts that differ in spaces or case only are different
    texts of one place. Texts of any length are read whole.
    """
    p = places(texts)
    a, b = p.select(F.col("text").alias("ship_to_a"), "place"), p.select(F.col("text").alias("ship_to_b"), "place")
    return a.join(b, "place").where(F.col("ship_to_a") < F.col("ship_to_b")).select("ship_to_a", "ship_to_b")
