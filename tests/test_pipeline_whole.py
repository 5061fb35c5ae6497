from ledgerlens.plans.pipeline import run_cases

BILL = "STRAIGHT BILL OF LADING\nBOL NUMBER: {}\n{}  PCN CRSP MPL ORG  10073180088472  1  12.5  {}  S1\n"
IDOC = "<INVOIC02><IDOC><E1EDK01><BELNR>90403395</BELNR></E1EDK01><E1EDP01><POSEX>10</POSEX><MENGE>4</MENGE><E1EDP19><QUALF>002</QUALF><IDTNR>08847</IDTNR></E1EDP19><E1EDP05><KOTXT>Gross Value</KOTXT><KRATE>20.00</KRATE></E1EDP05></E1EDP01></IDOC></INVOIC02>"


def test_a_case_is_extracted_and_linked_whole(spark, tmp_path):
    a, b = tmp_path / "in" / "case_1", tmp_path / "in" / "case_2"
    a.mkdir(parents=True)
    b.mkdir()
    (a / "invoice_90403395.txt").write_text(IDOC)
    (a / "bol.txt").write_text(BILL.format(123456, "08847", 7) + "\f" + BILL.format(999999, "08847", 5))
    (a / "pod.txt").write_text("Proof of Delivery of the goods named on the order\nPO # 4500012345\nBOL NUMBER: 123456\n")
    (a / "claim.txt").write_text("Associated Deductions\nInvoice number 90403395\nDeduction amount (-) $ 60.00\nPCN CRSP\n1007318008847\nItem invoiced/Not received 3 $ 20.00\n")
    (b / "claim.txt").write_text("Associated Deductions\nNo results were found here\nAssociated Promotions\nORAD late  $ 0.00 $ 150.00\n")
    t = run_cases(spark, str(tmp_path / "in"))
    assert [(r.invoice_number, r.subtotal) for r in t["sales_invoice"].collect()] == [("90403395", None)]
    assert [(r.material_number, r.quantity, r.pos) for r in t["sales_invoice_lines"].collect()] == [("08847", 4.0, 1)]
    assert {(r.page_number, r.cases, r.belongs_to_primary_shipment) for r in t["bill_of_lading_lines"].collect()} == {(1, 7.0, True), (2, 5.0, False)}
    assert [(r.bol_number, r.total_cases) for r in t["bill_of_lading"].collect()] == [("123456", 7.0)]
    assert [(r.referenced_po, r.referenced_bol, r.shipped) for r in t["proof_of_delivery"].collect()] == [("4500012345", "123456", None)]
    got = {r.case_id.rsplit("/", 1)[1]: r for r in t["links"].collect()}
    assert {k: (r.claim_type, r.adj_amount, r.invoice_pos, r.bol_cases) for k, r in got.items()} == {"case_1": ("shortage", -60.0, 1, 7.0), "case_2": ("compliance", -150.0, None, None)}


def test_noise_and_project_folders_are_no_cases_and_pods_fold(spark, tmp_path):
    root = tmp_path / "in"
    for name, texts in {"case_1": ("CASES SHIPPED 40\nProof of Delivery Receiver signature", "Proof of Delivery\nCASES RECEIVED 35\nReceiver signature"), "node_modules/x": ("a", "b"), "tool": ("c", "d"), "lone": ("Proof of Delivery Receiver signature",)}.items():
        (root / name).mkdir(parents=True)
        for k, t in enumerate(texts):
            (root / name / f"pod_{k}.txt").write_text(t)
    (root / "tool" / "Makefile").write_text("all:")
    t = run_cases(spark, str(root), least_files=2)
    assert {r.case_id.rsplit("/", 1)[1] for r in t["documents"].collect()} == {"case_1"}
    assert {(r.path.split("/in/")[1], r.reason) for r in t["skipped"].collect() if "pod" in r.path} == {(f"{d}/pod_{k}.txt", "not in a case folder") for d, n in (("node_modules/x", 2), ("tool", 2), ("lone", 1)) for k in range(n)}
    assert [(r.n_records, r.shipped, r.received, r.shortage) for r in t["receiving"].collect()] == [(2, 40.0, 35.0, True)]
    assert {r.case_id.rsplit("/", 1)[1] for r in run_cases(spark, str(root))["documents"].collect()} == {"case_1", "lone"}


def test_a_model_reads_what_no_other_tier_does(spark, tmp_path):
    case = tmp_path / "in" / "case_1"
    case.mkdir(parents=True)
    (case / "invoice_90403395.txt").write_text(IDOC)
    (case / "invoice_2.txt").write_text("Bill-To-Party\nDocument Number 77\n0010  08847 PCN CRSP  4 EA  20.00  80.00 USD\n")
    (case / "invoice_3.txt").write_text("Bill-To-Party\nDocument Number 78\nfour cases of pecan crisp, twenty each\n")
    (case / "note.txt").write_text("nothing that any rule knows")
    asked = []

    def ask(kind, docs):
        asked.append(kind)
        return docs.where(docs["text"].contains("four cases")).selectExpr("doc_id", "1 as pos", "cast(4 as double) as quantity", "cast(20 as double) as unit_price")

    t = run_cases(spark, str(tmp_path / "in"), ask=ask)
    path = {r.doc_id: r.path.rsplit("/", 1)[1] for r in t["documents"].collect()}
    got = {path[r.doc_id]: (r.extraction_method, r.extraction_confidence, r.quantity) for r in t["sales_invoice_lines"].collect()}
    assert got == {"invoice_90403395.txt": ("edi", 0.92, 4.0), "invoice_2.txt": ("text", 0.95, 4.0), "invoice_3.txt": ("model", 0.6, 4.0)} and "sales_invoice" in asked
    assert [path[r.doc_id] for r in t["unknown"].collect()] == ["note.txt"]
