"""Invoices of EDI messages: one row per IDOC and per goods line, from the shredded objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as E
from ledgerlens.operators import nested

# Envelopes of invoices, and item categories of goods; a line without a category counts as goods.
ENVELOPES = ("INVOIC02", "INVOIC01")
GOODS = ("", "TAN", "ZTAN", "TAS")


def _segments(idocs: DataFrame, *below: str) -> DataFrame:
    """The segments at the paths ``below`` an IDOC: idoc_id, idoc_seq, line_seq (of a line's), name, ordinal, fields."""
    objects, bridge = nested.shred(idocs, "idoc_id", "payload", ENVELOPES, [f"{e}/IDOC/{b}" for e in ENVELOPES for b in below])
    own = bridge.join(objects.drop("name"), "object_id")
    return own.select(F.col("record_id").alias("idoc_id"), F.col("ordinals")[1].alias("idoc_seq"), F.try_element_at("ordinals", F.lit(3)).alias("line_seq"), "name", "ordinal", "fields")


def _field(name: str) -> Column:
    return F.nullif(nested.field(F.col("fields"), name), F.lit(""))


def _first(value: Column, seg: str, key: str | None = None, code: str | None = None) -> Column:
    """``value`` of the first segment ``seg``, of those whose ``key`` is ``code`` if given."""
    hit = F.col("name") == seg
    return F.min_by(value, F.when(hit if key is None else hit & (_field(key) == code), F.col("ordinal")))


def _partner() -> Column:
    """'NAME1, STRAS, ORT01 REGIO PSTLZ' of what is given."""
    city = F.nullif(F.concat_ws(" ", *map(_field, ("ORT01", "REGIO", "PSTLZ"))), F.lit(""))
    return F.nullif(F.concat_ws(", ", _field("NAME1"), _field("STRAS"), city), F.lit(""))


def _goods(category: Column, quantity: Column) -> Column:
    return F.upper(F.coalesce(category, F.lit(""))).isin(*GOODS) & F.coalesce(quantity != 0, F.lit(False))


def idoc_headers(idocs: DataFrame) -> DataFrame:
    """Number, date, order, delivery, partners, terms and totals of each IDOC by qualifier.

    Of several segments with a qualifier the first counts. The bill-to is the payer, else the
    ordering party; the ship-to is that of the header, else the only one of the goods lines. The
    total is the net payable sum, else the grand total where that is missing or 0.
    """
    seg = _segments(idocs, "E1EDK01", "E1EDK02", "E1EDKA1", "E1EDK18", "E1EDS01", "E1EDP01", "E1EDP01/E1EDPA1")
    amount = E.parse_trailing_minus(_field("SUMME"))
    per_idoc = seg.where(F.col("name").isin("E1EDK01", "E1EDK02", "E1EDKA1", "E1EDK18", "E1EDS01")).groupBy("idoc_id", "idoc_seq").agg(
        _first(_field("BELNR"), "E1EDK01").alias("invoice_number"), _first(_field("BELNR"), "E1EDK02", "QUALF", "001").alias("po_number"), E.iso_date(_first(_field("DATUM"), "E1EDK02", "QUALF", "009")).alias("invoice_date"),
        _first(_field("BELNR"), "E1EDK02", "QUALF", "012").alias("delivery_number"),
        F.coalesce(F.nullif(_first(amount, "E1EDS01", "SUMID", "Z01"), F.lit(0.0)), _first(amount, "E1EDS01", "SUMID", "010")).alias("total_amount"), _first(amount, "E1EDS01", "SUMID", "011").alias("subtotal"),
        F.when(F.count_if((F.col("name") == "E1EDKA1") & (_field("PARVW") == "RG")) > 0, _first(_partner(), "E1EDKA1", "PARVW", "RG")).otherwise(_first(_partner(), "E1EDKA1", "PARVW", "AG")).alias("bill_to"),
        _first(_partner(), "E1EDKA1", "PARVW", "WE").alias("head_ship"),
        F.when(F.count_if((F.col("name") == "E1EDK18") & (_field("QUALF") == "005")) > 0, _first(_field("ZTERM_TXT"), "E1EDK18", "QUALF", "005")).otherwise(_first(_field("ZTERM_TXT"), "E1EDK18")).alias("terms_of_payment"),
    )
    line = seg.where(F.col("name").isin("E1EDP01", "E1EDPA1")).groupBy("idoc_id", "idoc_seq", "line_seq").agg(
        F.max(F.when(F.col("name") == "E1EDP01", _goods(_field("PSTYV"), E.parse_trailing_minus(_field("MENGE"))))).alias("goods"), _first(_partner(), "E1EDPA1", "PARVW", "WE").alias("ship"))
    ships = line.where("goods and ship is not null").groupBy("idoc_id", "idoc_seq").agg(F.min("ship").alias("low"), F.max("ship").alias("high"))
    out = per_idoc.join(ships, ["idoc_id", "idoc_seq"], "left")
    return out.withColumn("ship_to", F.coalesce("head_ship", F.when(F.col("low") == F.col("high"), F.col("low")))).drop("head_ship", "low", "high")


def idoc_lines(idocs: DataFrame) -> DataFrame:
    """One row per goods line with a quantity: quantity and unit, item codes and words by qualifier, rates by name, amounts.

    Lines of a service category are left out. Of several rates of a name the last counts. The
    promotion is that of the rate, else of gross less net, over the quantity, as a negative amount.
    """
    seg = _segments(idocs, "E1EDP01", "E1EDP01/E1EDP19", "E1EDP01/E1EDP05", "E1EDP01/E1EDP26")
    line = lambda k: F.max(F.when(F.col("name") == "E1EDP01", _field(k)))
    rate = E.parse_trailing_minus(_field("KRATE"))
    told = F.lower(F.coalesce(_field("KOTXT"), F.lit("")))
    kind = F.when(told.contains("gross value"), "gross").when(told.rlike("off[ -]invoice|promo"), "promo").when(told.contains("net value"), "net")
    last = lambda k: F.max_by(rate, F.when((F.col("name") == "E1EDP05") & (kind == k) & rate.isNotNull(), F.col("ordinal")))
    code = lambda k, q: _first(_field(k), "E1EDP19", "QUALF", q)
    paid = lambda q: _first(E.parse_trailing_minus(_field("BETRG")), "E1EDP26", "QUALF", q)
    out = seg.groupBy("idoc_id", "idoc_seq", "line_seq").agg(
        line("POSEX").alias("line_no"), E.parse_trailing_minus(line("MENGE")).alias("quantity"), code("IDTNR", "001").alias("customer_sku"), code("IDTNR", "002").alias("material_number"), code("IDTNR", "003").alias("upc"),
        last("gross").alias("gross_price"), last("net").alias("net_price"), line("PSTYV").alias("category"), F.coalesce(line("MENEE"), F.lit("EA")).alias("unit_label"), code("KTEXT", "002").alias("description"),
        code("IDTNR_EXTERNAL", "002").alias("gtin"), last("promo").alias("promo_price"), F.coalesce(F.nullif(paid("010"), F.lit(0.0)), paid("003")).alias("gross_value"),
    )
    off = F.round(F.col("gross_price") - F.col("net_price"), 4)
    promo = F.when(F.col("promo_price").isNotNull(), -F.round(F.abs("promo_price") * F.col("quantity"), 2)).when(off > 0, -F.round(off * F.col("quantity"), 2))
    return out.where(_goods(F.col("category"), F.col("quantity"))).drop("category").withColumns({"unit_price": F.coalesce(F.nullif("net_price", F.lit(0.0)), "gross_price"), "off_invoice_promo": promo})
