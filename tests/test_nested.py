import json

from ledgerlens.operators.nested import invoice_segments, parse_payload, shred

SCHEMA = "idoc_id long, payload string, payload_format string, name string, ordinal int"
LINE = {"POSEX": "10", "MENGE": "2.0", "E1EDP19": [{"QUALF": "002", "IDTNR": " 05278 "}, {"QUALF": "001"}], "E1EDP05": {"KOTXT": "Gross", "KRATE": None}}
DOC = {"INVOIC02": {"IDOC": [{"E1EDP01": [LINE, LINE]}, {"E1EDP01": LINE}]}}
XML = (
    '[page 1]\n<?xml version="1.0"?><!-- <E1EDP01/> --><n:INVOIC02 xmlns:n="u"><IDOC BEGIN="1"><E1EDP01 SEGMENT="1"><POSEX>10</POSEX><MENGE>2.0</MENGE>'
    "<E1EDP19><QUALF>002</QUALF><IDTNR><![CDATA[ 05278 ]]></IDTNR></E1EDP19><E1EDP19><QUALF>001</QUALF></E1EDP19><E1EDP05><KOTXT>Gross</KOTXT></E1EDP05>"
    "</E1EDP01></IDOC></n:INVOIC02>\n-- end --> of transmission"
)


def rows(spark, *payloads):
    df = spark.createDataFrame([(i, p, "txt", "x", 1) for i, p in enumerate(payloads)], SCHEMA)
    return sorted(tuple(r) for r in invoice_segments(df).collect())


def test_json_and_xml_read_alike(spark):
    got = rows(spark, json.dumps({"INVOIC02": {"IDOC": {"E1EDP01": LINE}}}), XML, json.dumps(json.dumps({"INVOIC02": {"IDOC": {"E1EDP01": LINE}}})))
    one = [(1, 1, "E1EDP01", 0, "10", "2.0"), (1, 1, "E1EDP05", 1, "Gross", ""), (1, 1, "E1EDP19", 1, "002", "05278"), (1, 1, "E1EDP19", 2, "001", "")]
    assert got == [(i, *r) for i in range(3) for r in one]


def test_identical_objects_are_stored_once_and_every_occurrence_kept(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC), None, "x", 1), (1, json.dumps(DOC), None, "x", 1)], SCHEMA)
    objects, bridge = shred(df, "idoc_id", "payload", "INVOIC02")
    assert objects.where("name = 'E1EDP01'").count() == 1
    assert bridge.where("name = 'E1EDP01'").count() == 6
    assert sorted(tuple(r.ordinals) for r in bridge.where("name = 'E1EDP01'").distinct().collect()) == [(1, 1, 1), (1, 1, 2), (1, 2, 1)]
    # the bridge alone leads from every child to its parent
    joined = bridge.distinct().alias("c").join(bridge.distinct().alias("p"), "record_id").where("c.parent_occ = p.occ")
    assert joined.count() == bridge.distinct().count() - 1


def test_what_gives_nothing(spark):
    whole = json.dumps(DOC)
    assert rows(spark, None, "", whole[:-3], XML[:200], "<ORDERS05><IDOC><E1EDP01/></IDOC></ORDERS05>", '{"INVOIC01": {"IDOC": {"E1EDP01": {}}}}', "x" * 100_000, "{", "<") == []
    assert rows(spark) == []


def test_repeated_keys_and_numbers_as_written():
    (_, _, children), = parse_payload('note {a}\n{"INVOIC02": {"IDOC": {"N": 1.50, "E1EDP01": {"POSEX": 1}, "E1EDP01": null}}}', "INVOIC02")
    (_, idoc, lines), = children
    assert idoc == {"N": "1.50"} and [x[1] for x in lines] == [{"POSEX": "1"}, {}]


def test_several_envelopes_are_numbered_through(spark):
    one = "<INVOIC02><IDOC><E1EDP01><POSEX>{}</POSEX></E1EDP01></IDOC></INVOIC02>"
    two = [json.dumps({"batch": [{"INVOIC02": {"IDOC": {"E1EDP01": {"POSEX": "1"}}}}, {"INVOIC02": {"IDOC": {"E1EDP01": {"POSEX": "2"}}}}]}), f"<all>{one.format(1)}{one.format(2)}</all>", f'<?xml version="1.0"?>{one.format(1)}\n<?xml version="1.0"?>{one.format(2)} end',
           json.dumps({"INVOIC02": {"IDOC": {"E1EDP01": {"POSEX": "1"}}}}) + "\n" + json.dumps({"INVOIC02": {"IDOC": {"E1EDP01": {"POSEX": "2"}}}})]
    assert rows(spark, *two) == [(i, k, 1, "E1EDP01", 0, str(k), "") for i in range(4) for k in (1, 2)]
    objects, bridge = shred(spark.createDataFrame([(1, two[1], None, "x", 1)], SCHEMA), "idoc_id", "payload", "INVOIC02")
    assert [(r.occ, r.parent_occ, r.ordinals) for r in bridge.where("name = 'IDOC'").orderBy("occ").collect()] == [(1, 0, [1, 1]), (4, 3, [2, 2])]
    assert rows(spark, one.format(1) + one.format(2)[:-9]) == []
