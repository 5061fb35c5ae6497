import json

from ledgerlens.extract.edi import idoc_headers, idoc_lines

LINE = {"POSEX": "10", "MENGE": "4.000", "PSTYV": "TAN", "E1EDP19": [{"QUALF": "001", "IDTNR": "77"}, {"QUALF": "002", "IDTNR": "08847", "KTEXT": "PCN CRSP"}], "E1EDP05": [{"KOTXT": "Gross Value", "KRATE": "20.70"}, {"KOTXT": "Off-invoice & allowance", "KRATE": "1.20-"}, {"KOTXT": "Net Value for Item", "KRATE": "19.50"}], "E1EDP26": [{"QUALF": "003", "BETRG": "78.00"}, {"QUALF": "010", "BETRG": "82.80"}], "E1EDPA1": {"PARVW": "WE", "NAME1": "Dock 3"}}
IDOC = {
    "EDI_DC40": {"MESTYP": "INVOIC"}, "E1EDK01": {"BELNR": "90"}, "E1EDKA1": [{"PARVW": "AG", "NAME1": "Lowmere", "STRAS": "1 Main St", "ORT01": "Penddale", "PSTLZ": "30455"}], "E1EDK02": [{"QUALF": "001", "BELNR": "45"}, {"QUALF": "009", "DATUM": "20240423"}],
    "E1EDK18": [{"QUALF": "001", "ZTERM_TXT": "other"}, {"QUALF": "005", "ZTERM_TXT": "2% 30"}],
    "E1EDP01": [LINE, LINE | {"POSEX": "20", "PSTYV": "YB99"}, {"POSEX": "30", "MENGE": "2", "E1EDP05": [{"KOTXT": "Gross Value", "KRATE": "5"}, {"KOTXT": "Net Value for Item", "KRATE": "4.5"}]}, LINE | {"POSEX": "40", "MENGE": "0.000"}],
    "E1EDS01": [{"SUMID": "011", "SUMME": "90"}, {"SUMID": "010", "SUMME": "88"}],
}


def test_partners_terms_totals_and_goods_lines(spark):
    other = IDOC | {"E1EDKA1": [{"PARVW": "RG", "NAME1": "Payer"}, *IDOC["E1EDKA1"], {"PARVW": "WE", "NAME1": "Shed"}], "E1EDS01": [{"SUMID": "Z01", "SUMME": "86.5"}, {"SUMID": "010", "SUMME": "88"}]}
    xml = "<INVOIC01><IDOC><E1EDK01><BELNR>91</BELNR></E1EDK01><E1EDP01><POSEX>1</POSEX><MENGE>3</MENGE></E1EDP01></IDOC></INVOIC01>"
    f = spark.createDataFrame([(1, json.dumps({"INVOIC02": {"IDOC": IDOC}})), (2, json.dumps({"INVOIC01": {"IDOC": other}})), (3, xml), (4, "<ORDERS05><IDOC/></ORDERS05>")], "idoc_id long, payload string")
    h = {r.idoc_id: (r.invoice_number, r.bill_to, r.ship_to, r.terms_of_payment, r.subtotal, r.total_amount) for r in idoc_headers(f).collect()}
    assert h == {1: ("90", "Lowmere, 1 Main St, Penddale 30455", "Dock 3", "2% 30", 90.0, 88.0), 2: ("90", "Payer", "Shed", "2% 30", None, 86.5), 3: ("91", None, None, None, None, None)}
    got = {(r.idoc_id, r.line_no): (r.quantity, r.unit_label, r.material_number, r.unit_price, r.off_invoice_promo, r.gross_value) for r in idoc_lines(f).collect()}
    assert got == {(i, "10"): (4.0, "EA", "08847", 19.5, -4.8, 82.8) for i in (1, 2)} | {(i, "30"): (2.0, "EA", None, 4.5, -1.0, None) for i in (1, 2)} | {(3, "1"): (3.0, "EA", None, None, None, None)}
