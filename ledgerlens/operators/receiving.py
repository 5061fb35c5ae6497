"""Receiving evidence: folding records in order, and the geometry of stamps on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import plausible_cases

RECORD = "struct<stamp:boolean,notes:string,shipped:double,received:double,shortage:boolean,exceptions:array<string>>"


def _clean(r: Column) -> Column:
    """A record without counts of cases that cannot be."""
    keep = lambda c: F.when(plausible_cases(c), c)
    return F.struct(
        F.coalesce(r["stamp"], F.lit(False)).alias("stamp"), r["notes"].alias("notes"), keep(r["shipped"]).alias("shipped"), keep(r["received"]).alias("received"),
        F.coalesce(r["shortage"], F.lit(False)).alias("shortage"), F.coalesce(r["exceptions"], F.array().cast("array<string>")).alias("exceptions"),
    )


def _merge(a: Column, b: Column) -> Column:
    shipped, received = F.coalesce(a["shipped"], b["shipped"]), F.coalesce(a["received"], b["received"])
    known = F.coalesce(F.contains(a["notes"], b["notes"]), F.lit(False))
    notes = F.when(F.coalesce(b["notes"], F.lit("")) == "", a["notes"]).when(F.coalesce(a["notes"], F.lit("")) == "", b["notes"]).when(known, a["notes"]).otherwise(F.concat(a["notes"], F.lit("; "), b["notes"]))
    short = F.when(shipped.isNotNull() & received.isNotNull(), received.cast("bigint") < shipped.cast("bigint")).otherwise(a["shortage"] | b["shortage"])
    return F.struct(
        (a["stamp"] | b["stamp"]).alias("stamp"), notes.alias("notes"), shipped.alias("shipped"), received.alias("received"), short.alias("shortage"),
        F.array_union(a["exceptions"], b["exceptions"]).alias("exceptions"),
    )


def fold_receiving(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key, folded over its records in ``order``.

    records: key, order, stamp, notes, shipped, received, shortage, exceptions. Counts outside 0
    to 19,999 are dropped; the first count given wins; notes are joined unless already
    contained; shortage follows the counts if both are known; exceptions are united in order. A
    single record comes out as it went in, implausible counts included. Records of a key beyond
    the first thousands would be one array; keys are documents with a few pages each.
    """
    r = F.struct("stamp", "notes", "shipped", "received", F.col("shortage"), F.col("exceptions")).cast(RECORD)
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), r.alias("r"))))
    all_of = records.groupBy(key).agg(sorted_rows.alias("all"))
    rest = F.slice("all", 2, F.size("all"))
    folded = F.aggregate(rest, _clean(F.col("all")[0]["r"]).cast(RECORD), lambda acc, x: _merge(acc, _clean(x["r"]).cast(RECORD)).cast(RECORD))
    out = F.when(F.size("all") == 1, F.col("all")[0]["r"]).otherwise(folded)
    return all_of.select(key, F.size("all").alias("n_records"), out.alias("r")).select(key, "n_records", "r.*")


# Phrases that anchor a receiving stamp.
STAMP_ANCHORS = (
    r"RECEIV(?:ING|ER)\s*STAMP", r"TOTAL\s*#?\s*O?F?\s*CASES?\s*ON\s*BOL", r"TOTAL\s*#?\s*O?F?\s*CASES?\s*REC[VD']*D", r"OVER[\s/]*SHORT\s*CASES?", r"RECEIVER\s*PRINTED\s*NAME", r"RECEIVER\s*SIGNATURE",
)


def stamp_regions(ocr_lines: DataFrame, pad: int = 40) -> DataFrame:
    """Box of the stamp on each page: page_id, x1, y1, x2, y2, n_anchors.

    ocr_lines: page_id, text, x1, y1, x2, y2, page_w, page_h. The boxes of the lines that name an
    anchor are united and widened, downwards most; a box is at most 98 % of the page wide and 40 %
    high, and none is given below 100 by 60. Null texts and boxes anchor nothing.
    """
    hit = ocr_lines.where(F.col("text").rlike("(?i)" + "|".join(STAMP_ANCHORS)) & F.col("x1").isNotNull())
    u = hit.groupBy("page_id").agg(*(F.min(c).alias(c) for c in ("x1", "y1")), *(F.max(c).alias(c) for c in ("x2", "y2")), F.count(F.lit(1)).alias("n_anchors"), F.first("page_w").alias("w"), F.first("page_h").alias("h"))
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("bigint")
    down = whole(F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")) * F.when(F.col("n_anchors") <= 2, 11).otherwise(2))
    left, top = F.greatest(F.lit(0), whole(F.col("x1")) - 2 * pad), F.greatest(F.lit(0), whole(F.col("y1")) - pad)
    right = F.least(whole(F.col("w") * 0.98), F.least(F.col("w"), whole(F.col("x2")) + 4 * pad))
    bottom = F.least(F.col("h"), whole(F.col("y2")) + down)
    box = u.select("page_id", left.cast("bigint").alias("x1"), top.cast("bigint").alias("y1"), right.cast("bigint").alias("x2"), F.least(bottom, top + whole(F.col("h") * 0.40)).cast("bigint").alias("y2"), "n_anchors")
    return box.where((F.col("x2") - F.col("x1") >= 100) & (F.col("y2") - F.col("y1") >= 60))


def lines_in_region(ocr_lines: DataFrame, regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """Text of the lines of which half or more lies in their page's region, in reading order.

    ``scale`` is the region's resolution over that of the lines. Columns: page_id, n_lines, text,
    confidence (mean). Lines are read by rows of eight points (half to even), then from the left.
    """
    r = regions.select("page_id", *(F.col(c) / scale for c in ("x1", "y1", "x2", "y2"))).toDF("page_id", "rx1", "ry1", "rx2", "ry2")
    wide = F.least("x2", "rx2") - F.greatest("x1", "rx1")
    high = F.least("y2", "ry2") - F.greatest("y1", "ry1")
    area = F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    inside = ocr_lines.join(r, "page_id").where((wide > 0) & (high > 0) & (wide * high / area >= 0.5))
    row = F.struct((F.bround(F.col("y1") / 8, 0) * 8).alias("row"), F.col("x1").alias("x"), F.col("line_no").alias("n"), F.col("text").alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(row)), lambda s: s["t"])
    return inside.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(texts, "\n").alias("text"), F.avg("confidence").alias("confidence"))


def fuse_counts(seen: Column, read: Column) -> Column:
    """The count a picture gave if it can be, else the one the text gave if it can be, else null."""
    return F.coalesce(F.when(plausible_cases(seen), seen.try_cast("double").cast("bigint")), F.when(plausible_cases(read), read.try_cast("double").cast("bigint")))


def best_stamp_pages(pages: DataFrame) -> DataFrame:
    """The page of each document with the most counts, stamp and picture read; of ties the first.

    pages: doc_id, page_number, shipped, received, over_short, stamp, pictured.
    """
    score = sum(F.col(c).isNotNull().cast("int") for c in ("shipped", "received", "over_short")) + sum(F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("stamp"), F.col("pictured")))
    best = pages.groupBy("doc_id").agg(F.max(F.struct(score.alias("score"), (-F.col("page_number")).alias("early"))).alias("b"))
    return best.select("doc_id", (-F.col("b.early")).alias("page_number"), F.col("b.score").alias("score"))


def other_shipment_pages(pages: DataFrame) -> DataFrame:
    """Pages whose header is of another shipment than the first page's: doc_id, page_number, is_other.

    pages: doc_id, page_number, bol_number, po_number, ship_to. Headers agree if either has none of
    the three, or every field that both give is the same beyond case and spaces and at least one is given by both.
    """
    from pyspark.sql import Window

    norm = lambda c: F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", " "))
    fields = ("bol_number", "po_number", "ship_to")
    sig = pages.select("doc_id", "page_number", F.struct(*(norm(F.col(c)).alias(c) for c in fields)).alias("s"))
    # one row of each document goes to all: a document has few pages
    w = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = sig.withColumn("p", F.first("s").over(w))
    empty = lambda s: (F.col(f"{s}.bol_number") == "") & (F.col(f"{s}.po_number") == "") & (F.col(f"{s}.ship_to") == "")
    shared = [(F.col(f"s.{c}") != "") & (F.col(f"p.{c}") != "") for c in fields]
    differs = [m & (F.col(f"s.{c}") != F.col(f"p.{c}")) for m, c in zip(shared, fields)]
    agree = empty("s") | empty("p") | (~(differs[0] | differs[1] | differs[2]) & (shared[0] | shared[1] | shared[2]))
    return both.select("doc_id", "page_number", (~agree).alias("is_other"))
