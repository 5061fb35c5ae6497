"""Orphan references: keys that point to rows which are absent, deleted or not yet loaded.

Method: the distinct non-null foreign keys, each with its earliest reference, are anti-joined
against the parent keys that were live by then; only the surviving keys are joined back to
their referring rows. Both sides of the anti-join hold one row per key, so a key that holds a
third of the rows is one row there (it is aggregated map-side before the shuffle). The join back
streams referring rows against one row per orphan key, which adaptive skew join splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``child.field`` names ``parent.parent_field``."""

    child: str
    child_id: str
    field: str
    parent: str
    parent_field: str


#: The references of the trade tables.
TRADE_REFERENCES = (
    Reference("invoices", "invoice_id", "po_number", "bols", "po_number"),
    Reference("invoices", "invoice_id", "delivery_number", "bols", "bol_number"),
    Reference("pods", "pod_id", "referenced_bol", "bols", "bol_number"),
    Reference("pods", "pod_id", "referenced_po", "invoices", "po_number"),
)


def number_key(c: Column) -> Column:
    """The digits of a decorated number without leading zeros; null where none is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^0-9]", ""), r"^0+", ""), F.lit(""))


def utc_clock(c: Column) -> Column:
    """The instant as it reads on a UTC clock, whatever the session's time zone."""
    return F.to_utc_timestamp(c, F.current_timezone())


def find_orphans(tables: dict[str, DataFrame], references=TRADE_REFERENCES) -> DataFrame:
    """One row per referring row whose parent was not live when it was loaded.

    Columns: src_table, ref_field, src_id, orphan_kind, ref_month. ``orphan_kind`` is ``late`` if
    a live parent came later, else ``deleted`` if only voided parents exist, else ``missing``.

    Null keys, and values without a digit other than 0, are no references and give no row. A null
    ``loaded_at`` of a referring row is before every parent (orphan, ref_month null); one of a
    parent never counts as loaded. Repeated rows count each; empty tables give no rows (an empty
    parent makes all references ``missing``); other columns are ignored.
    """
    refs = parents = None
    for k, r in enumerate(references):
        child, parent = tables[r.child], tables[r.parent]
        one = child.select(
            F.lit(k).alias("ref"), number_key(F.col(r.field)).alias("key"),
            F.col(r.child_id).cast("long").alias("src_id"), F.col("loaded_at").alias("ref_at"),
        ).where(F.col("key").isNotNull())
        voided = F.col("voided_at") if "voided_at" in parent.columns else F.lit(None).cast("timestamp")
        live = voided.isNull()
        own = parent.select(
            F.lit(k).alias("ref"), number_key(F.col(r.parent_field)).alias("key"),
            F.when(live, F.col("loaded_at")).alias("live_at"), (~live).alias("gone"),
        ).where(F.col("key").isNotNull())
        refs = one if refs is None else refs.unionByName(one)
        parents = own if parents is None else parents.unionByName(own)

    foreign = refs.groupBy("ref", "key").agg(F.min(F.coalesce("ref_at", F.timestamp_micros(F.lit(-(2**62))))).alias("first_ref"))
    known = parents.groupBy("ref", "key").agg(F.min("live_at").alias("live_at"), F.max("gone").alias("gone"))
    f, p = foreign.alias("f"), known.alias("p")
    same = (F.col("f.ref") == F.col("p.ref")) & (F.col("f.key") == F.col("p.key"))
    orphan_keys = f.join(p, same & (F.col("p.live_at") <= F.col("f.first_ref")), "left_anti")
    status = orphan_keys.alias("f").join(p, same, "left").select("f.ref", "f.key", "p.live_at", F.coalesce("p.gone", F.lit(False)).alias("gone"))

    name = lambda attr: F.element_at(F.array(*(F.lit(getattr(r, attr)) for r in references)), F.col("ref") + 1)
    return (
        refs.join(status, ["ref", "key"])
        .where(F.col("live_at").isNull() | F.col("ref_at").isNull() | (F.col("live_at") > F.col("ref_at")))
        .select(
            name("child").alias("src_table"), name("field").alias("ref_field"), "src_id",
            F.when(F.col("live_at").isNotNull(), "late").when(F.col("gone"), "deleted").otherwise("missing").alias("orphan_kind"),
            F.date_format(utc_clock(F.col("ref_at")), "yyyy-MM").alias("ref_month"),
        )
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, kind and month."""
    return orphans.groupBy("src_table", "ref_field", "orphan_kind", "ref_month").agg(F.count(F.lit(1)).alias("n_orphans"))
