"""Nested records to related flat tables, with Merkle subtree identities.

Every object of a payload is canonicalised and hashed bottom-up: its identity is the digest of its
name, its sorted scalar fields and the identities of its children in order. Identical objects are
stored once (``objects``): their fields leave a parsing task once and are shuffled apart from the
occurrences. Every occurrence is kept as a bridge row with its parent, its ordinal among siblings
of the same name and the ordinals of all its ancestors (``bridge``).
"""

from __future__ import annotations

import hashlib
import json
import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut

SHRED_SCHEMA = "record_id bigint, occ int, parent_occ int, path string, ordinals array<int>, name string, ordinal int, object_id string, fields string"

#: XML attributes that say how a sender laid out a segment and nothing about its content.
LAYOUT_ATTRIBUTES = ("SEGMENT", "BEGIN")

_OPEN = re.compile(r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)(?=[\s/>])")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _from_xml(text: str, envelope: str):
    """The envelopes as (name, fields, children)."""
    bare = re.sub(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>", lambda m: " " * len(m[0]), text, flags=re.S)
    first = _OPEN.search(bare)
    if first is None:
        return []
    end = text.rfind(">")
    # what stands behind the envelope may hold a ">" of its own: cut at the last closing tag of the root
    for m in re.finditer(r"</(?:[\w.-]+:)?" + re.escape(first[1]) + r"\s*>", text):
        end = m.end() - 1
    if re.search(rf"<(?:[\w.-]+:)?{re.escape(envelope)}[\s/>]", bare[end + 1 :]):  # another envelope begins and is cut off
        return []
    body = text[first.start() : end + 1]
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        try:  # several documents one behind the other
            root = ElementTree.fromstring("<_>" + re.sub(r"<\?xml.*?\?>|<!DOCTYPE[^>\[]*>", "", body, flags=re.S) + "</_>")
        except ElementTree.ParseError:
            return []

    def tops(el):
        if isinstance(el.tag, str) and _local(el.tag) == envelope:
            yield el
        else:
            for c in el:
                yield from tops(c)

    def node(el, segment: bool):
        fields = {f"@{_local(k)}": v.strip() for k, v in el.attrib.items() if _local(k) not in LAYOUT_ATTRIBUTES}
        children = []
        for c in el:
            if not isinstance(c.tag, str):
                continue
            if len(c) or (segment and _local(c.tag).startswith("E1")):
                children.append(node(c, segment))
            else:
                fields.setdefault(_local(c.tag), (c.text or "").strip())
        return _local(el.tag), fields, children

    return [node(top, True) for top in tops(root)]


class _Pairs(list):
    """An object of a JSON text as its pairs, so that repeated keys are kept."""


def _from_json(text: str, envelope: str):
    decode = json.JSONDecoder(object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=str, strict=False).raw_decode
    opening = re.compile(r'"\s*\{|\{|\[\s*[{"]')
    values = []
    start = opening.search(text)
    while start is not None:
        try:
            value, upto = decode(text, start.start())
        except ValueError:
            # text before the envelope may hold a bracket of its own, on another line; what follows a broken envelope is part of it
            if envelope in text[: start.start()] and not values:
                return []
            start = opening.search(text, start.end())
            continue
        for _ in range(4):  # JSON as a string of JSON
            if not isinstance(value, str):
                break
            try:
                value, _end = decode(value.strip())
            except ValueError:
                return []
        values.append(value)
        start = opening.search(text, upto)

    def seek(v):
        if isinstance(v, _Pairs):
            for k, x in v:
                if k.rpartition(":")[2] == envelope:
                    yield from (y for y in (x if isinstance(x, list) and not isinstance(x, _Pairs) else [x]) if isinstance(y, _Pairs))
                else:
                    yield from seek(x)
        elif isinstance(v, list):
            for x in v:
                yield from seek(x)

    def scalar(v) -> str:
        return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v).strip()

    def node(name: str, v: _Pairs):
        fields, children = {}, []
        for key, x in v:
            k = key.rpartition(":")[2]
            if k.lstrip("@") in LAYOUT_ATTRIBUTES:
                continue
            for y in x if isinstance(x, list) and not isinstance(x, _Pairs) else [x]:
                if isinstance(y, _Pairs):
                    children.append(node(k, y))
                elif k.startswith("E1"):
                    children.append((k, {}, []))
                else:
                    fields.setdefault(k, scalar(y))
        return name, fields, children

    return [node(envelope, v) for v in seek(values)]


def parse_payload(text: str | None, envelope: str) -> list:
    """The envelopes of an XML or JSON payload as (name, fields, children), in document order; none if it is not well-formed.

    The format is told from the text itself, as a recorded format may be missing or wrong.
    """
    if not text:
        return []
    lt = _OPEN.search(text)
    brace = text.find("{")
    if lt is not None and (brace < 0 or lt.start() < brace or "<?xml" in text[:brace]):
        return _from_xml(text, envelope)
    return _from_json(text, envelope) if brace >= 0 else []


def _digest(name: str, fields: str, children: list[str]) -> str:
    return hashlib.blake2b("\x1f".join([name, fields, *children]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


_canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode


def _walk(trees, record_id: int | None, rows: list, objects: dict[str, tuple[str, str]], wanted) -> None:
    """Appends one row per object, parents first, of the ``wanted`` paths if given; fills ``objects`` with what they hold.

    The children of a payload's envelopes are numbered through.
    """
    count = 0

    def visit(node, parent: int, path: str, ordinals: list[int], ordinal: int, seen: dict[str, int]) -> str:
        nonlocal count
        name, fields, children = node
        occ, count = count, count + 1
        here, mine = f"{path}/{name}" if path else name, [*ordinals, ordinal]
        row = None
        if wanted is None or here in wanted:
            row = [record_id, occ, parent, here, mine, name, ordinal, ""]
            rows.append(row)
        ids = []
        for c in children:
            seen[c[0]] = k = seen.get(c[0], 0) + 1
            ids.append(visit(c, occ, here, mine, k, {}))
        text = _canonical(fields)
        me = _digest(name, text, ids)
        if row is not None:
            row[7] = me
            objects[me] = (name, text)
        return me

    through: dict[str, int] = {}
    for k, tree in enumerate(trees):
        visit(tree, -1, "", [], k + 1, through)


def shred(df: DataFrame, record_id: str, payload: str, envelope: str | tuple[str, ...], paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The nested payloads of ``df`` as (objects, bridge).

    objects: object_id, name, fields (canonical JSON text of the scalar fields), one row per
    distinct object. bridge: record_id, occ, parent_occ, path, ordinals, name, ordinal,
    object_id, one row per occurrence; occ numbers the objects of a record in document order and
    parent_occ is -1 for the envelope; ordinals are those of the envelope, ..., the object itself.
    With ``paths`` only objects at these come out, with the same identities and numbers.

    A payload may hold several envelopes, whose children are numbered through. Null, empty, cut-off
    or malformed payloads and those of another envelope (of several names, the first that a payload
    has) give no rows; text
    around the envelope, comments, namespaces, attributes of the layout and the declared format do
    not matter. Empty and null fields read ''; of a repeated field the first counts. Repeated
    rows give the same bridge rows again under their own record_id; a null record_id is kept.
    Payloads of any length are read whole; other columns are ignored.
    """

    envelopes = (envelope,) if isinstance(envelope, str) else envelope

    wanted = None if paths is None else frozenset(paths)

    def parse(batches):
        told: set[str] = set()
        for batch in batches:
            rows: list = []
            objects: dict[str, tuple[str, str]] = {}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trees = next((x for e in envelopes if (x := parse_payload(t, e))), ())
                _walk(trees, i, rows, objects, wanted)
                if len(rows) >= 20_000:
                    yield _record_batch(rows, objects, told)
                    rows, objects = [], {}
            if rows:
                yield _record_batch(rows, objects, told)

    parsed = cut(df.select(F.col(record_id).cast("long").alias("record_id"), F.col(payload).alias("payload")).mapInArrow(parse, SHRED_SCHEMA))
    objects = parsed.where(F.col("fields").isNotNull()).groupBy("object_id").agg(F.first("name").alias("name"), F.first("fields").alias("fields"))
    return objects, parsed.where(F.col("occ").isNotNull()).drop("fields")


_COLUMNS = [x.split()[0] for x in SHRED_SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.string(), pa.string()]


def _record_batch(rows: list, objects: dict[str, tuple[str, str]], told: set[str]) -> pa.RecordBatch:
    """Occurrences, and the objects that this task has not told yet, as rows without an occurrence."""
    if len(told) > 1_000_000:  # telling an object again is harmless
        told.clear()
    new = {k: v for k, v in objects.items() if k not in told}
    told.update(new)
    columns = [list(c) for c in zip(*rows)] + [[None] * len(rows)]
    for name, values in (("name", [v[0] for v in new.values()]), ("object_id", list(new)), ("fields", [v[1] for v in new.values()])):
        columns[_COLUMNS.index(name)] += values
    n = len(rows) + len(new)
    return pa.RecordBatch.from_arrays([pa.array(c + [None] * (n - len(c)), t) for c, t in zip(columns, _TYPES)], names=_COLUMNS)


def field(c: Column, name: str) -> Column:
    """A scalar field of an object's canonical text; '' when absent."""
    return F.coalesce(F.get_json_object(c, f"$.{name}"), F.lit(""))


#: Segment, its code field and its value field.
INVOICE_SEGMENTS = {"E1EDP01": ("POSEX", "MENGE"), "E1EDP19": ("QUALF", "IDTNR"), "E1EDP05": ("KOTXT", "KRATE")}


def invoice_segments(idocs: DataFrame, envelope: str = "INVOIC02") -> DataFrame:
    """Lines of the IDOCs, their item codes and their prices, each with the place of its parent.

    Columns: idoc_id, idoc_seq, line_seq, segment_name, seg_seq, code, val.
    """
    line = f"{envelope}/IDOC/E1EDP01"
    objects, wanted = shred(idocs, "idoc_id", "payload", envelope, [line, *(f"{line}/{s}" for s in INVOICE_SEGMENTS if s != "E1EDP01")])
    objects = objects.select("object_id", "name", F.from_json("fields", "map<string,string>").alias("f"))
    code = val = None
    for s, (c, v) in INVOICE_SEGMENTS.items():
        hit = F.col("name") == s
        pair = [F.coalesce(F.try_element_at("f", F.lit(x)), F.lit("")) for x in (c, v)]
        code = F.when(hit, pair[0]) if code is None else code.when(hit, pair[0])
        val = F.when(hit, pair[1]) if val is None else val.when(hit, pair[1])
    objects = objects.select("object_id", code.alias("code"), val.alias("val"))
    return wanted.join(objects, "object_id").select(
        F.col("record_id").alias("idoc_id"), F.col("ordinals")[1].alias("idoc_seq"), F.col("ordinals")[2].alias("line_seq"),
        F.col("name").alias("segment_name"), F.when(F.col("name") == "E1EDP01", 0).otherwise(F.col("ordinal")).alias("seg_seq"), "code", "val",
    )
