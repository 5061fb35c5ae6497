from ledgerlens.streaming import ingest


def test_texts_of_other_encodings_stay_in_the_stream(spark, tmp_path):
    a = tmp_path / "in" / "case_1"
    a.mkdir(parents=True)
    (a / "pod.txt").write_bytes("Proof of Delivery café".encode("cp1252"))
    (a / "invoice_1234.txt").write_text("Bill-To-Party\n")
    (a / "scan.png").write_bytes(b"\xff\xfe")
    stream = ingest.classified(ingest.distinct_contents(ingest.arriving_files(spark, str(tmp_path / "in"))))
    ingest.to_table(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    got = {(r.path.rsplit("/", 1)[1], r.doc_type, r.n_readable) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert {x[:2] for x in got} == {("pod.txt", "proof_of_delivery"), ("invoice_1234.txt", "sales_invoice")}
