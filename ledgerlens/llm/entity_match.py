"""Matching trade items across sources without a shared key.

Claim lines, invoice lines and shipped lines name the same item of a case in codes and words of
their own. The words, their abbreviations and the words for packages are learned from the lines:
descriptions of one material use them for each other. Attributes become fixed bit vectors: the
letter pairs of a description's normalised words (64 bits) and the digits of an item code by place
(50 bits). Close vectors are found exactly by multi-index Hamming hashing inside the case: vectors
within the radius agree in at least one of their chunks. What is close is compared field by field
with Dice scores; the weight of a field's score is the log-likelihood ratio of its level, learned
from pairs that another field decides, and the weights add up to a calibrated confidence.
"""

from __future__ import annotations

import math
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut

_PACK = re.compile(r"(?:(\d+)\s*(?:CT)?\s*[-/X]\s*)?(?:(\d+)\s*(?:CT)?\s*[-/X]\s*)?(\d+)(?:\s*CT\s*|\s*[-/X]\s*)(\d+(?:\.\d+)?)\s*OZ")

#: Bits of a description vector that may differ, and the chunks it is cut into: one more, so that one is equal.
WORD_RADIUS = 11
WORD_CHUNKS = WORD_RADIUS + 1
#: Places of an item code that may differ.
CODE_PLACES = 2


def _near_forms(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def split_pack(text: str) -> tuple[list[str], str, bool, list[str]]:
    """(words, pack, whether the pack leads, words behind a pack that ends the text) of a description in capitals."""
    m = _PACK.search(text)
    if not m:
        return re.findall(r"[A-Z]+", text), "", False, []
    pack = "x".join(str(int(g)) for g in m.groups()[:3] if g) + "x" + m[4]
    # a pack leads the text or ends it; what follows one that ends it is package and unit
    leads = not text[: m.start()].strip(" ,-")
    head, tail = text[: m.start()], text[m.end() :]
    return re.findall(r"[A-Z]+", tail if leads else head), pack, leads, [] if leads else re.findall(r"[A-Z]+", tail)


class Vocabulary:
    """Words of the trade with their full forms, and words for packages, as the lines themselves use them."""

    def __init__(self, full: dict[str, str], packages=()):
        self.full, self.packages = full, frozenset(packages)
        self._longest_first = sorted(full, key=lambda w: (-len(w), w))
        self._forms: dict[str, set[str]] = {}
        for w in full:
            if len(w) >= 4:
                for f in _near_forms(w):
                    self._forms.setdefault(f, set()).add(full[w])
        self._seen: dict[str, str] = {}

    def normal(self, w: str) -> str:
        """The full word of a word, an abbreviation, or one letter off either; else the word itself."""
        if w in self.full:
            return self.full[w]
        if len(w) < 3:
            return w
        if w not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            hit = set().union(*(self._forms.get(f, ()) for f in _near_forms(w)))
            self._seen[w] = next(iter(hit)) if len(hit) == 1 else w
        return self._seen[w]

    def segment(self, w: str) -> list[str]:
        """Words of a glued run, longest first; the rest of a run that does not end in a word is kept."""
        out = []
        while w:
            x = next((x for x in self._longest_first if w.startswith(x)), None) or next((x for x in self.packages if w.startswith(x)), None)
            if x is None:
                out.append(w)
                break
            out.append(x)
            w = w[len(x) :]
        return out

    def cut_off(self, w: str, certain: bool) -> bool:
        """Whether the last word of a text is the start of another one; in a text that is ``certain`` to be cut also if it is a word."""
        longer = {self.full[x] for x in self.full if x.startswith(w) and x != w}
        return bool(longer - {self.full.get(w)}) and (certain or w not in self.full)


def abbreviates(a: str, b: str) -> bool:
    """Whether ``a`` is made of letters of ``b`` in order, the first one among them."""
    at = iter(b)
    return len(a) < len(b) and a[0] == b[0] and all(c in at for c in a)


def vocabulary_of(words: list[tuple[str, int, int, int]], shared: list[tuple[str, str, int]], typo: int = 20, together: float = 0.6, behind: float = 0.2) -> Vocabulary:
    """The vocabulary from counts: (word, lines, lines that have it behind the pack, materials), and (a, b, materials that have both).

    A word that is ``typo`` times rarer than one a letter away, or than one it is the start of, is
    a slip of it; one that is put together from others is a glued run. Of the words that ``a`` may
    abbreviate it is the one that most of its materials have, and at least a share ``together``.
    A word of which a share ``behind`` stands behind the pack is a package.
    """
    packages = {w for w, n, after, _ in words if after >= behind * n}
    lines = {w: n for w, n, _, _ in words if w not in packages and len(w) > 1 and w not in ("CT", "OZ")}
    forms: dict[str, int] = {}
    for w, n in lines.items():
        for f in _near_forms(w) | {w[:k] for k in range(2, len(w))}:
            forms[f] = max(forms.get(f, 0), n)
    kept = {w for w, n in lines.items() if max((forms.get(f, 0) for f in (_near_forms(w) if len(w) > 3 else {w})), default=0) < typo * n}

    def glued(w: str) -> bool:
        ends = {0}
        for k in range(2, len(w) + 1):
            if any(w[i:k] in kept | packages and k - i > 1 and k - i < len(w) for i in ends):
                ends.add(k)
        return len(w) in ends

    kept -= {w for w in kept if len(w) >= 8 and glued(w)}
    materials = {w: m for w, _, _, m in words}
    best: dict[str, tuple[float, str]] = {}
    for a, b, n in shared:
        if a in kept and b in kept and abbreviates(a, b) and n >= together * materials[a]:
            best[a] = max(best.get(a, (0.0, "")), (n / materials[a], b))
    full = {}
    for w in kept:
        x = w
        while x in best:  # longer each time
            x = best[x][1]
        full[w] = x
    return Vocabulary(full, packages)


#: Least share of the lines, and lines, that hold a word of the vocabulary; so there are at most some hundred thousand of them.
WORD_SHARE, WORD_LINES = 1e-5, 5


def learn_vocabulary(texts: DataFrame) -> Vocabulary:
    """The vocabulary of ``texts`` (material, description, n): see ``vocabulary_of``."""

    def words(batches):
        for pdf in batches:
            rows = []
            for m, t, n in zip(pdf["material"], pdf["description"], pdf["n"]):
                found, _, _, tail = split_pack(t.upper())
                rows += [(m, w, int(n), 0) for w in set(found)] + [(m, w, int(n), int(n)) for w in tail[:1]]
            yield pd.DataFrame(rows, columns=["material", "word", "n", "behind"])

    per = cut(texts.mapInPandas(words, "material string, word string, n long, behind long").groupBy("material", "word").agg(F.sum("n").alias("n"), F.sum("behind").alias("behind")))
    lines = texts.agg(F.sum("n")).first()[0] or 0
    often = per.groupBy("word").agg(F.sum("n").alias("n"), F.sum("behind").alias("behind"), F.count(F.lit(1)).alias("m")).where(F.col("n") >= max(WORD_LINES, WORD_SHARE * lines))
    often = cut(often)
    of = per.join(often.select("word"), "word").select("material", "word", F.substring("word", 1, 1).alias("letter"))
    letters = F.concat(F.lit("^"), F.regexp_replace("a", "(.)", "$1.*"))
    both = of.withColumnRenamed("word", "a").join(of.withColumnRenamed("word", "b"), ["material", "letter"]).where((F.length("a") < F.length("b")) & F.rlike("b", letters))
    shared = both.groupBy("a", "b").count()
    return vocabulary_of([tuple(r) for r in often.select("word", "n", "behind", "m").collect()], [tuple(r) for r in shared.collect()])


def describe(text: str | None, vocabulary: Vocabulary) -> tuple[str, str, int]:
    """(normalised words in order, pack, bit vector) of a description; pack '' if cut off or missing."""
    if not text:
        return "", "", 0
    found, pack, leads, _ = split_pack(text.upper())
    if found and (not pack or leads) and vocabulary.cut_off(found[-1], certain=not pack):
        found.pop()
    words, packages = [], vocabulary.packages
    for w in found:
        if w in packages or (len(w) == 2 and pack and any(p.startswith(w) for p in packages)):
            continue
        n = vocabulary.normal(w)
        words += [n] if n != w or w in vocabulary.full or len(w) < 8 else [vocabulary.normal(x) for x in vocabulary.segment(w) if x not in packages]
    known = sorted({w for w in words if w in vocabulary.full})
    rest = sorted({w for w in words if w not in vocabulary.full and len(w) >= 4})
    return " ".join(known + rest), pack, word_bits(known + rest)


def word_bits(words) -> int:
    """64 bits, one for each letter pair of each word, as a signed number."""
    v = 0
    for w in words:
        p = f"_{w}_"
        for i in range(len(p) - 1):
            v |= 1 << (zlib.crc32(p[i : i + 2].encode("utf-8", "surrogatepass") + b"%d" % (i == 0)) % 64)
    return v - (1 << 64) if v >> 63 else v


def material_code(c: Column) -> Column:
    """Material of five digits or more; null where there is no digit."""
    d = F.regexp_replace(F.regexp_replace(c, r"[^0-9]", ""), r"^0+", "")
    return F.when(d != "", F.when(F.length(d) < 5, F.lpad(d, 5, "0")).otherwise(d))


def sku_key(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), r"[^A-Z0-9]", ""), F.lit(""))


def claim_codes(upc: Column) -> tuple[Column, Column, Column]:
    """(item code of five digits, its last four digits, customer sku) that a claim's code holds.

    Conventions: a case code of 13 or 15 digits ends in the item code; a consumer code of 12
    digits that starts with 0 holds it before the check digit; a case code of 12 digits lost the
    item code's first digit. Codes of one repeated digit are placeholders.
    """
    d = F.regexp_replace(upc, r"[^0-9]", "")
    n = F.length(d)
    sku = sku_key(upc)
    filler = d.rlike(r"^(\d)\1*$") | (n == 0)
    letters = sku.rlike(r"^[A-Z]{2}\d{6}$")
    five = F.when(filler | letters, None).when(n.isin(13, 14, 15), F.substring(d, -5, 5)).when((n == 12) & d.startswith("0"), F.substring(d, 7, 5))
    four = F.when(~filler & (n == 12) & ~d.startswith("0") & ~letters, F.substring(d, -4, 4))
    return five, four, F.when(letters | ((n == 7) & ~filler), sku)


#: Width of a cell of log prices, by which prices alone propose an item.
PRICE_CELL = 0.02


def _word_chunks(v: Column) -> list[Column]:
    """Chunks of a 64-bit vector: of vectors within the radius one is equal."""
    edge = [64 * i // WORD_CHUNKS for i in range(WORD_CHUNKS + 1)]
    return [F.shiftrightunsigned(v, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edge, edge[1:])]


def _code_chunks(c: Column) -> list[Column]:
    """Chunks of a five-digit code, whose vector has one bit for each digit at each place: two places apart are at most two of the three."""
    return [F.substring(c, 1, 2), F.substring(c, 3, 2), F.substring(c, 5, 1)]


def _kind(name: str, i: int) -> str:
    """Name of a chunk: its place counts but for prices; code_1 is the chunk of a code with that place alone."""
    return name if name == "price" else name.replace("_", "") if "_" in name else f"{name}{i}"


def _keys(case: Column, **kinds: tuple[Column, list[Column]]) -> Column:
    """One hash per case, kind and chunk, of the kinds that hold; hashes that meet by chance are told apart by the comparison in full."""
    parts = [F.when(ok, F.array(*(F.hash(case, F.lit(_kind(kind, i)), c.cast("string")) for i, c in enumerate(chunks)))).otherwise(F.array().cast("array<int>")) for kind, (ok, chunks) in kinds.items()]
    return F.explode(F.array_distinct(F.flatten(F.array(*parts))))


def _cell(price: Column) -> Column:
    return F.floor(F.log(price) / PRICE_CELL)


def near_pairs(claims: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of ``claims`` and ``items`` of those items of a claim's case that may be what it claims.

    Multi-index hashing inside the case: both sides are hashed by the chunks of their description
    vector, of which close vectors share one, of their code, and, where a claim has little else, by
    cells of the price; code endings and skus are chunks of a code too. Pairs with a key in common
    are compared in full. Exact within the radii. A case of any size is as many keys as its vectors
    have chunks; only numbers of rows are shuffled by key.
    """
    claims = claims.withColumn("weak_price", F.when(_weak(), F.col("claim_price")))
    claims = claims.withColumn("_c", F.xxhash64(*(F.col(f"`{c}`") for c in claims.columns)))
    items = items.withColumn("_i", F.xxhash64("case_id", "item")).withColumnRenamed("case_id", "_case")
    coded = F.length("item") == 5
    left = claims.select("_c", _keys(
        F.col("case_id"), word=(F.col("c_v") != 0, _word_chunks(F.col("c_v"))), code=(F.length("five") == 5, _code_chunks(F.col("five"))),
        code_1=(F.col("four").isNotNull(), [F.substring("four", 2, 2)]), code_0=(F.length("sku_item") == 5, [F.substring("sku_item", 1, 2)]), sku=(F.length("sku_item") != 5, [F.col("sku_item")]),
        price=(F.col("weak_price").isNotNull(), [_cell(F.col("weak_price")) + d for d in (-1, 0, 1)])).alias("key"))
    right = items.select("_i", _keys(
        F.col("_case"), word=(F.coalesce("v", F.lit(0)) != 0, _word_chunks(F.col("v"))), code=(coded, _code_chunks(F.col("item"))), sku=(~coded, [F.col("item")]),
        price=(F.col("price") > 0, [_cell(F.col("price")), _cell(F.coalesce("net", "price"))])).alias("key"))
    some_pack = (F.col("c_pack") == "") | (F.coalesce("pack", F.lit("")) == "") | (F.col("c_pack") == F.col("pack"))
    near = (F.col("c_v") != 0) & (F.col("v") != 0) & (F.bit_count(F.col("c_v").bitwiseXOR(F.col("v"))) <= WORD_RADIUS) & some_pack
    places = sum((F.substring("five", i, 1) == F.substring("item", i, 1)).cast("int") for i in range(1, 6))
    by_code = coded & ((places >= 5 - CODE_PLACES) | (F.substring("item", 2, 4) == F.col("four")))
    priced = (F.abs(_cell(F.col("weak_price")) - _cell(F.col("price"))) <= 1) | (F.abs(_cell(F.col("weak_price")) - _cell(F.coalesce("net", "price"))) <= 1)
    meets = F.coalesce(near, F.lit(False)) | F.coalesce(by_code, F.lit(False)) | F.coalesce(F.col("sku_item") == F.col("item"), F.lit(False)) | F.coalesce(priced & (F.col("price") > 0), F.lit(False))
    met = left.join(right, "key").select("_c", "_i").distinct()
    return met.join(claims.distinct(), "_c").join(items, "_i").where((F.col("case_id") == F.col("_case")) & meets).drop("_c", "_i", "_case", "weak_price")


def _weak() -> Column:
    """Claims that neither a code nor words and pack describe; their price proposes items."""
    return F.col("five").isNull() & F.col("four").isNull() & F.col("sku_item").isNull() & (F.col("claim_price") > 0) & ((F.col("c_pack") == "") | (F.col("c_v") == 0))


_DESCRIBED = "words string, pack string, v long"


def _described(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows of ``df`` with words, pack and vector of their description."""
    names = df.columns

    def run(batches):
        for pdf in batches:
            d = [describe(t if isinstance(t, str) else None, vocabulary) for t in pdf["description"]]
            out = pdf[names].copy()
            out["words"], out["pack"], out["v"] = [x[0] for x in d], [x[1] for x in d], [x[2] for x in d]
            yield out

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + _DESCRIBED)


#: What the item of a line starts with that no material names.
OWN = "d|"
#: Greatest distance of log prices of one item in a case, and between cases.
SAME_PRICE, USUAL_PRICE = 0.0005, 0.05


def case_lines(invoice_lines: DataFrame, shipped_lines: DataFrame, uom_codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Vocabulary]:
    """(lines, catalogue, vocabulary): lines with their item, items with words, pack and vector, and the words of the lines.

    An item is a material; the catalogue describes it by its longest description, which is pre-
    aggregated per material. A line without a material takes the item that its description names,
    and is an item of its own wording if none has it, of none if it has no wording; ``items_in_case``
    looks for these in their case, by ``sku`` too. Prices are those of a case by the stated unit
    if there is a code table ``uom_codes``, else as recorded.
    """
    # step by step, as each step uses the one before more than once
    priced = invoice_lines.withColumn("_net", F.col("unit_price") + F.try_divide(F.col("off_invoice_promo"), F.col("quantity"))).withColumn("_cases", F.lit(1.0))
    if uom_codes is not None:
        from ledgerlens.operators import units

        priced = priced.withColumns({"_said": F.coalesce(units.count_unit(F.col("unit_label")), units.unit_in_description(F.col("description"))), "_pack": units.pieces_per_case(F.col("description"))})
        priced = priced.withColumn("_cases", F.coalesce(units.stated_factor(F.col("_said"), "CS", F.col("_pack"), units.unit_sizes(uom_codes)), F.lit(1.0)))
    parts = [
        priced.select(F.lit("invoice_lines").alias("target_table"), F.col("invoice_line_id").cast("long").alias("target_line_id"), "case_id", "material_number", F.lit(None).cast("string").alias("sku"), "description",
                             F.try_divide(F.col("unit_price"), F.col("_cases")).alias("price"), F.try_divide(F.col("_net"), F.col("_cases")).alias("net")),
        shipped_lines.where(F.coalesce("belongs_to_primary_shipment", F.lit(True))).select(
            F.lit("shipped_lines").alias("target_table"), F.col("shipped_line_id").cast("long").alias("target_line_id"), "case_id", "material_number", sku_key(F.col("customer_sku")).alias("sku"), "description",
            F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("net")),
    ]
    both = parts[0].unionByName(parts[1]).where(F.col("case_id").isNotNull()).select("*", material_code(F.col("material_number")).alias("material")).drop("material_number")
    texts = cut(both.where(F.col("material").isNotNull() & F.col("description").isNotNull()).groupBy("material", "description").agg(F.count(F.lit(1)).alias("n")))
    vocabulary = learn_vocabulary(texts)
    longest = texts.groupBy("material").agg(F.max(F.struct(F.length("description").alias("n"), F.col("description").alias("t"))).alias("d"))
    catalogue = cut(_described(longest.select(F.col("material").alias("item"), F.col("d.t").alias("description")), vocabulary).drop("description"))
    named = catalogue.where(F.col("pack") != "").groupBy("words", "pack").agg(F.min("item").alias("named"))
    loose = _described(both.where(F.col("material").isNull() & F.col("description").isNotNull()).select("description").distinct(), vocabulary)
    loose = cut(loose.where(F.col("words") != "").join(named, ["words", "pack"], "left").select(
        "description", F.coalesce("named", F.concat(F.lit(OWN), F.concat_ws("|", "words", "pack"))).alias("loose_item"), F.col("named").isNull().alias("own"), "words", "pack", "v"))
    lines = both.withColumn("wording", F.when(F.col("material").isNull(), F.col("description"))).join(loose.select(F.col("description").alias("wording"), "loose_item"), "wording", "left")
    item = F.coalesce("material", "loose_item")
    lines = lines.select("target_table", "target_line_id", "case_id", item.alias("item"), F.when(item.isNull() | item.startswith(OWN), F.col("sku")).alias("sku"), "price", "net")
    own = loose.where("own").select(F.col("loose_item").alias("item"), "words", "pack", "v").dropDuplicates(["item"])
    return lines, catalogue.unionByName(own), vocabulary


def items_in_case(lines: DataFrame, catalogue: DataFrame, sku_items: DataFrame) -> DataFrame:
    """``lines`` without sku, where those of no material take an item of their case if one alone fits.

    A sku that is shipped under a material names it. Else the words of a line must lie inside those
    of the item, with no other pack, and its price must be the one of the item in the case, or near
    the item's usual one where the case has none; a line without words goes by its price alone. Of
    several that fit the one with the closest words is taken, and none of equals. Lines that find
    none keep their own wording as item; those without wording are left out.
    """
    loose = F.col("item").isNull() | F.col("item").startswith(OWN)
    named = lines.where(~loose).drop("sku")
    open_ = lines.where(loose).join(sku_items, "sku", "left").drop("sku")
    by_sku = open_.where(F.col("sku_item").isNotNull()).withColumn("item", F.col("sku_item")).drop("sku_item")
    open_ = cut(open_.where(F.col("sku_item").isNull()).drop("sku_item"))
    line = ["target_table", "target_line_id", "case_id"]
    told = open_.select(*line, "item", F.col("price").alias("l_price")).join(catalogue.where(F.col("item").startswith(OWN)).select("item", F.col("v").alias("l_v"), F.col("pack").alias("l_pack")), "item", "left").drop("item")
    told = told.withColumns({"l_v": F.coalesce("l_v", F.lit(0)), "l_pack": F.coalesce("l_pack", F.lit(""))})
    near = named.join(open_.select("case_id").distinct(), "case_id", "left_semi")
    log = lambda c: F.when(F.col(c) > 0, F.log(c))
    items = near.groupBy("case_id", "item").agg(F.array_compact(F.collect_set(log("price"))).alias("here"))
    usual = named.groupBy("item").agg(F.percentile_approx(log("price"), 0.5).alias("usual"))
    p = told.join(items, "case_id").join(usual, "item").join(catalogue, "item", "left")
    bits = lambda c: F.bit_count(F.col(c))
    common = F.bit_count(F.col("l_v").bitwiseAND(F.coalesce("v", F.lit(0))))
    dice = F.round(F.coalesce(F.try_divide(2.0 * common, bits("l_v") + bits("v")), F.lit(0.0)), 6)
    own = log("l_price")
    priced = F.when(F.size("here") > 0, F.exists("here", lambda x: F.abs(x - own) <= SAME_PRICE)).otherwise(F.abs(F.col("usual") - own) <= USUAL_PRICE)
    pack_fits = (F.col("l_pack") == "") | (F.coalesce("pack", F.lit("")) == "") | (F.col("l_pack") == F.col("pack"))
    # without a price words have to be enough, without words the price
    fits = F.when(F.col("l_v") == 0, F.coalesce(priced, F.lit(False))).otherwise((F.try_divide(1.0 * common, bits("l_v")) >= 0.95) & pack_fits & F.coalesce(priced, F.lit(True)))
    fitting = p.where(fits).groupBy(*line).agg(F.array_sort(F.collect_set(F.struct((-dice).alias("d"), "item"))).alias("f"))
    alone = (F.size("f") == 1) | (F.col("f")[0]["d"] < F.try_element_at("f", F.lit(2))["d"])
    found = open_.join(fitting.where(alone).select(*line, F.col("f")[0]["item"].alias("found")), line, "left").withColumn("item", F.coalesce("found", "item")).drop("found")
    return named.unionByName(by_sku).unionByName(found).where(F.col("item").isNotNull())


def claims_with_case(claim_lines: DataFrame, invoices: DataFrame, bols: DataFrame | None = None) -> DataFrame:
    """Claim lines with the case they belong to: their own, else that of their invoice number, else of their order number (on invoices, then on bills)."""
    from ledgerlens.operators.orphans import number_key

    def to_case(table: DataFrame, field: str, name: str, out: str) -> DataFrame:
        return table.select(number_key(F.col(field)).alias(name), "case_id").where(F.col(name).isNotNull() & F.col("case_id").isNotNull()).groupBy(name).agg(F.min("case_id").alias(out))

    five, four, sku = claim_codes(F.col("upc"))
    c = claim_lines.select(
        F.col("claim_line_id").cast("long").alias("claim_line_id"), F.col("case_id").alias("own_case"), F.when(F.col("case_id").isNull(), number_key(F.col("claim_invoice_number"))).alias("inv"),
        F.when(F.col("case_id").isNull(), number_key(F.col("claim_po_number"))).alias("po"), five.alias("five"), four.alias("four"), sku.alias("sku"), "description", F.col("unit_price").alias("claim_price"),
    )
    lost = c.where(F.col("own_case").isNull()).join(to_case(invoices, "invoice_number", "inv", "case_1"), "inv", "left").join(to_case(invoices, "po_number", "po", "case_2"), "po", "left")
    lost = lost.join(to_case(bols, "po_number", "po", "case_3"), "po", "left") if bols is not None else lost.withColumn("case_3", F.lit(None).cast("long"))
    found = lost.select("claim_line_id", F.coalesce("case_1", "case_2", "case_3").alias("case_id"), "five", "four", "sku", "description", "claim_price").where(F.col("case_id").isNotNull())
    return c.where(F.col("own_case").isNotNull()).select("claim_line_id", F.col("own_case").alias("case_id"), "five", "four", "sku", "description", "claim_price").unionByName(found)


def _levels(p: DataFrame) -> DataFrame:
    """Candidate pairs with the levels of their fields' Dice scores; 0 is 'cannot tell'."""
    bits = lambda c: F.bit_count(F.col(c))
    common = F.bit_count(F.col("c_v").bitwiseAND(F.col("v")))
    dice = F.try_divide(2.0 * common, bits("c_v") + bits("v"))
    inside = F.try_divide(1.0 * common, bits("c_v"))
    pack_known = (F.col("c_pack") != "") & (F.col("pack") != "")
    same_pack = pack_known & (F.col("c_pack") == F.col("pack"))
    words = (
        F.when((F.col("c_v") == 0) & (F.col("c_pack") == ""), 0)
        .when(pack_known & ~same_pack, F.when(dice >= 0.92, 6).otherwise(7))
        .when(same_pack, F.when(dice >= 0.92, 1).when(dice >= 0.7, 3).when((F.col("c_v") == 0) | (inside >= 0.95), 4).otherwise(7))
        .when(dice >= 0.92, 2).when(inside >= 0.95, 5).otherwise(7)
    )
    places = sum((F.substring("five", i, 1) == F.substring("item", i, 1)).cast("int") for i in range(1, 6))
    swapped = (F.array_sort(F.split("five", "")) == F.array_sort(F.split("item", ""))) & (places == 3)
    code = (
        F.when(F.length("item") != 5, 0)
        .when(F.col("five").isNotNull(), F.when(places == 5, 1).when(F.col("five_known"), 4).when((places == 4) | swapped | (F.levenshtein("five", "item") == 1), 3).otherwise(4))
        .when(F.col("four").isNotNull(), F.when(F.substring("item", 2, 4) == F.col("four"), 2).when(F.levenshtein("four", F.substring("item", 2, 4)) <= 1, 3).otherwise(4))
        .when(F.col("sku_item").isNotNull(), F.when(F.col("sku_item") == F.col("item"), 1).otherwise(4))
        .otherwise(0)
    )
    off = F.least(*(F.abs(F.log(F.col("claim_price")) - F.log(F.col(x))) for x in ("price", "net")))
    price = F.when(off.isNull(), 0).when(off <= 0.011, 1).when(off <= 0.05, 2).otherwise(3)
    return p.select("claim_line_id", "case_id", "item", words.alias("words_level"), code.alias("code_level"), price.alias("price_level"))


def learned_weights(counts: list[tuple[int, int, int, float]]) -> tuple[float, dict[str, dict[int, float]]]:
    """(prior log-odds, log-likelihood ratio of each level of each field) from the counts of level triples.

    A field's ratios are learned where the other fields decide: words where the code says same or
    other, codes where the words do, prices where both agree. Counts are smoothed by one.
    """
    same_code, other_code, same_words, other_words = (1,), (4,), (1,), (6, 7)

    def ratios(field: int, levels, yes, no) -> dict[int, float]:
        y = {x: 1.0 + sum(c[3] for c in counts if c[field] == x and yes(c)) for x in levels}
        n = {x: 1.0 + sum(c[3] for c in counts if c[field] == x and no(c)) for x in levels}
        ys, ns = sum(y[x] for x in levels if x), sum(n[x] for x in levels if x)
        return {x: 0.0 if x == 0 else math.log((y[x] / ys) / (n[x] / ns)) for x in levels}

    words = ratios(0, range(8), lambda c: c[1] in same_code, lambda c: c[1] in other_code)
    code = ratios(1, range(5), lambda c: c[0] in same_words, lambda c: c[0] in other_words)
    price = ratios(2, range(4), lambda c: c[0] in same_words and c[1] in same_code, lambda c: c[0] in other_words and c[1] in other_code)
    weights = {"words": words, "code": code, "price": price}
    # the prior: the share of pairs that are matches, as the weights themselves say (expectation maximisation)
    total = sum(c[3] for c in counts)
    p = 0.5
    for _ in range(200 if total else 0):
        odds = p / (1 - p)
        at = [odds * math.exp(words[c[0]] + code[c[1]] + price[c[2]]) for c in counts]
        new = min(max(sum(c[3] * o / (1 + o) for c, o in zip(counts, at)) / total, 0.01), 0.99)
        p, moved = new, abs(new - p)
        if moved < 1e-9:
            break
    return math.log(p / (1 - p)), weights


def match_items(
    claim_lines: DataFrame, invoices: DataFrame, invoice_lines: DataFrame, shipped_lines: DataFrame, bols: DataFrame | None = None, uom_codes: DataFrame | None = None, least: float = 0.5
) -> DataFrame:
    """claim_line_id, target_table, target_line_id, confidence: the lines of a claim's case that are its item.

    A claim gets the item of its case with the highest confidence of ``least`` or more, and with it
    every line of that item, also those that say it only by sku, cut-off words or price; of ties all. Null or placeholder codes, null or cut-off descriptions
    and null prices take no part in the comparison; a claim whose case is unknown, or with nothing
    to compare, gives no row. Lines of another shipment never match; a null in that mark counts as
    the primary shipment. Repeated claims and lines count each; empty tables give no rows; texts
    of any length are read whole; other columns are ignored.
    """
    lines, catalogue, vocabulary = case_lines(invoice_lines, shipped_lines, uom_codes)
    lines = cut(lines)
    catalogue = cut(catalogue)
    sku_items = shipped_lines.select(sku_key(F.col("customer_sku")).alias("sku"), material_code(F.col("material_number")).alias("m")).where(F.col("sku").isNotNull() & F.col("m").isNotNull())
    sku_items = sku_items.groupBy("sku", "m").agg(F.count(F.lit(1)).alias("n")).groupBy("sku").agg(F.max_by("m", F.struct("n", "m")).alias("sku_item"))
    lines = cut(items_in_case(lines, catalogue, sku_items))
    claims = cut(_described(claims_with_case(claim_lines, invoices, bols), vocabulary).withColumnsRenamed({"words": "c_words", "pack": "c_pack", "v": "c_v"}).drop("description"))
    by_sku = claims.where(F.col("sku").isNotNull()).select("sku").distinct().join(sku_items, "sku")
    # a code that is another item's is no mistyped one
    known = claims.where(F.col("five").isNotNull()).select("five").distinct().join(catalogue.select(F.col("item").alias("five")), "five", "left_semi").withColumn("five_known", F.lit(True))
    claims = cut(claims.join(by_sku, "sku", "left").join(known, "five", "left").withColumn("five_known", F.coalesce("five_known", F.lit(False))))
    in_case = lines.groupBy("case_id", "item").agg(F.max("price").alias("price"), F.max("net").alias("net"))

    facts = claims.select("claim_line_id", "case_id", "five", "five_known", "four", "sku_item", "c_pack", "c_v", "claim_price")
    levels = cut(_levels(near_pairs(facts, in_case.join(catalogue.select("item", "v", "pack"), "item", "left"))))

    counts = [(r[0], r[1], r[2], float(r[3])) for r in levels.groupBy("words_level", "code_level", "price_level").agg(F.count(F.lit(1))).collect()]  # at most 160 rows
    prior, weights = learned_weights(counts)
    logit = F.lit(prior)
    for name, table in weights.items():
        m = F.create_map(*(F.lit(x) for k, w in table.items() for x in (k, float(w))))
        logit = logit + F.element_at(m, F.col(f"{name}_level"))
    scored = levels.select("claim_line_id", "case_id", "item", (1 / (1 + F.exp(-logit))).alias("confidence")).where(F.col("confidence") >= least)
    best = scored.groupBy("claim_line_id").agg(F.max("confidence").alias("top"))
    chosen = scored.join(best, "claim_line_id").where(F.col("confidence") == F.col("top")).select("claim_line_id", "case_id", "item", "confidence")
    return chosen.join(lines, ["case_id", "item"]).select("claim_line_id", "target_table", "target_line_id", "confidence")
