from pyspark.sql import functions as F

from ledgerlens.plans.pipeline import run_cases, write
from ledgerlens.sources import files
from ledgerlens.streaming import ingest


def folder(tmp_path):
    a = tmp_path / "in" / "case_1"
    a.mkdir(parents=True)
    (a / "invoice_9040.txt").write_text("Bill-To-Party Document Number 90403395\n10  11023 RSTD  4 EA  115.20  460.80 USD\n")
    (a / "copy_invoice_9040.txt").write_bytes((a / "invoice_9040.txt").read_bytes())
    (a / "pod.txt").write_bytes("Proof of Delivery caf\xe9\nat the receiving dock\nCASES SHIPPED 120\fCASES RECEIVED 110 and signed by the clerk on duty there".encode("cp1252"))
    (a / "bol.pdf").write_bytes(b"%PDF")
    (a / "x.docx").write_bytes(b"x")
    (a / ".hidden.txt").write_text("x")
    return str(tmp_path / "in")


def test_cases_from_files(spark, tmp_path):
    out = str(tmp_path / "out")
    t = run_cases(spark, folder(tmp_path), out)
    docs = {r.path.rsplit("/", 1)[1]: r.doc_type for r in t["documents"].collect()}
    assert docs == {"invoice_9040.txt": "sales_invoice", "copy_invoice_9040.txt": "sales_invoice", "pod.txt": "proof_of_delivery"}
    assert spark.read.parquet(f"{out}/sales_invoice_lines").count() == 2
    assert [(r.shipped, r.received) for r in spark.read.parquet(f"{out}/proof_of_delivery").collect()] == [(120, 110)]
    rep = spark.read.parquet(f"{out}/reports").first()
    assert rep.documents_missing == ["bill_of_lading", "deduction_claim", "remittance_advice"] and len(rep.warnings) == 1 and rep.best["sales_invoice"].endswith("copy_invoice_9040.txt")


def test_files_without_text_do_not_vanish(spark, tmp_path):
    root = folder(tmp_path)
    for name, files_in in {"only_pdf": ("invoice_1234.pdf",), "only_skipped": ("x.docx",)}.items():
        (tmp_path / "in" / name).mkdir()
        for f in files_in:
            (tmp_path / "in" / name / f).write_bytes(b"%PDF")
    t = run_cases(spark, root)
    assert {(r.path.rsplit("/", 1)[1], r.kind, r.doc_type, r.confidence) for r in t["unresolved"].collect()} == {("bol.pdf", "pdf", "bill_of_lading", 0.0), ("invoice_1234.pdf", "pdf", "sales_invoice", 0.0)}
    rep = {r.case_id.rsplit("/", 1)[1]: r for r in t["reports"].collect()}
    assert {k: (r.n_documents, len(r.warnings or []), [x.split(" :: ")[0] for x in r.documents_unresolved]) for k, r in rep.items()} == {"case_1": (3, 1, ["bill_of_lading"]), "only_pdf": (0, 0, ["sales_invoice"]), "only_skipped": (0, 1, [])}
    assert len(rep["only_pdf"].documents_missing) == 4
    # an engine that returns no row for a file
    none = run_cases(spark, root, read_pictures=lambda d: d.where(~F.col("path").endswith("bol.pdf")).select("path", "content_id", F.lit("x").alias("text")))
    assert [r.path.rsplit("/", 1)[1] for r in none["unresolved"].collect()] == ["bol.pdf"]


def test_pictures_are_read_by_an_engine_that_is_handed_in(spark, tmp_path):
    t = run_cases(spark, folder(tmp_path), read_pictures=lambda d: d.select("path", "content_id", F.lit("STRAIGHT BILL OF LADING\nBOL NUMBER: 123456 and some more words to read").alias("text")))
    assert [r.bol_number for r in t["bill_of_lading"].collect()] == ["123456"]


def test_triage_and_case_folders(spark):
    p = spark.createDataFrame([(x,) for x in ("c/a.PDF", "c/b.txt", "c/.x.txt", "c/n", "c/t.tmp", "d/a.pdf", "e/venv/a.pdf", "e/venv/b.pdf", "f/a.md", "f/README.md", "f/setup.py", "g/p.dist-info/a.md", "g/p.dist-info/b.md")], "path string")
    assert {(r.path, r.kind, r.reason) for r in files.triage(p).where("path like 'c/%'").collect()} == {("c/a.PDF", "pdf", None), ("c/b.txt", "text", None), ("c/n", None, "unsupported file type '(no extension)'")}
    assert [tuple(r) for r in files.case_folders(p).collect()] == [("c", 2)]


def test_pages(spark):
    long = "y" * 50
    p = files.joined_pages(files.pages(spark.createDataFrame([(1, f"{long}\fshort"), (2, None)], "doc_id long, text string")), "doc_id").orderBy("doc_id").collect()
    assert [tuple(r) for r in p] == [(1, 2, f"[page 1]\n{long}\n\n[page 2]\n", True), (2, 1, "[page 1]\n", True)]


def test_write_in_parts(spark, tmp_path):
    write(spark.range(100), str(tmp_path / "t"), key="id", parts=4)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 100 and back.select("part").distinct().count() == 4


def test_streams(spark, tmp_path):
    files_in = ingest.arriving_files(spark, folder(tmp_path))
    q = ingest.to_table(ingest.classified(ingest.distinct_contents(files_in)), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    # the copy is read once, the receipt in Windows-1252 like in a batch
    assert sorted(r.doc_type for r in got) == ["proof_of_delivery", "sales_invoice"]
    q = ingest.to_table(ingest.classified(ingest.distinct_contents(files_in)), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    assert ingest.arrivals_per_window(ingest.classified(files_in)).isStreaming
