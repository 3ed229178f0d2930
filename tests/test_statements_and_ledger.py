import random
from datetime import date
from decimal import Decimal

from builders import invoices, money, payments
from pyspark.sql import functions as F
from remitlens import schemas
from remitlens.operators import documents, ledger
from remitlens.plans.statement_import import import_statements, judge_statements
from remitlens.sources import documents as docfiles
from remitlens.streaming.statements import import_stream

FILES = {
    "a.csv": "Txn Date,Narration,Chq/Ref No,Deposit,Withdrawal,Balance\n2026-03-01,NEFT Received from Acme Corp,AXIS123456,50000.00,,50000.00\n2026-03-01,NEFT again,AXIS123456,50000.00,,50000.00\n",
    "b.csv": "Date,Description,Ref No,Amount,Type\n15-03-2026,UPI Payment from Customer,UPI998877,2500.00,CR\n15-03-2026,x,UPI99,2500.00,ZZ\n",
    "c.csv": "Date,Particulars,Reference,Amount\n2026/03/11,Software subscription,REF102,-450.00\n",
    "d.csv": "Bank of X\nAccount 1\nFoo\n\nDate,Description,Credit,Debit\n2026-03-05,Direct deposit from client,18000.00,\n",
    "e.csv": 'Date,Narration,Credit,Debit\n2026-03-01,a,"1,25,000.00",\n05-Mar-2026,NEFT/HDFC1234567890/From Global Inc,5,\n2026-03-09,"=cmd|\'/C calc\'!A0",7,\n31-02-2026,x,7,\n2026-03-09,,7,\n'
             '2026-03-09,zz,abc,\n2026-03-09,"multi\nline, ""q""",8.005,\n,,,\n2026-03-09,both,1,1\n',
    "f.csv": "", "g.csv": "a\x00b", "h.csv": "Date,Description\n2026-01-01,x\n", "i.csv": "foo,bar\n1,2\n", "k.pdf": "Date,Description,Amount\n",
    "z.csv": "Date,Description,Ref No,Amount,Type\n15-03-2026,UPI Payment from Customer,UPI998877,2500.00,CR\n",
}


def files(spark, contents):
    return spark.createDataFrame([("c1", n, bytearray(c.encode()), None) for n, c in contents.items()],
                                 "company_id string, file_name string, content binary, bank_account_number string")


def test_layouts_errors_and_duplicates(spark):
    result = import_statements(files(spark, FILES))
    report = {r.file_name: (r.status, r.total_rows, r.imported_payments, r.skipped_debits, r.skipped_duplicates, r.failed_rows) for r in result.report.collect()}
    assert report == {
        "a.csv": ("COMPLETED", 2, 1, 0, 1, 1), "b.csv": ("COMPLETED", 2, 1, 0, 0, 1), "c.csv": ("COMPLETED", 1, 0, 1, 0, 0), "d.csv": ("COMPLETED", 1, 1, 0, 0, 0),
        "e.csv": ("COMPLETED", 8, 4, 0, 0, 4), "f.csv": ("FAILED", 0, 0, 0, 0, 0), "g.csv": ("FAILED", 0, 0, 0, 0, 0), "h.csv": ("FAILED", 0, 0, 0, 0, 0),
        "i.csv": ("FAILED", 0, 0, 0, 0, 0), "k.pdf": ("FAILED", 0, 0, 0, 0, 0), "z.csv": ("COMPLETED", 1, 0, 0, 1, 0)}
    rows = {(r.file_name, r.row_number): r for r in result.transactions.collect()}
    assert rows["e.csv", 8].narration == 'multi\nline, "q"' and rows["e.csv", 8].amount == Decimal("8.01")
    assert rows["e.csv", 4].narration.startswith("'=cmd") and rows["e.csv", 3].reference_number == "HDFC1234567890"
    assert rows["e.csv", 2].raw_row == {"Date": "2026-03-01", "Narration": "a", "Credit": "1,25,000.00", "Debit": ""}
    assert {(r.file_name, r.row_number, r.field) for r in result.errors.collect()} == {
        ("a.csv", 3, "reference_number"), ("b.csv", 3, "type_indicator"), ("e.csv", 5, "transaction_date"), ("e.csv", 6, "narration"), ("e.csv", 7, "amount"), ("e.csv", 10, "amount")}
    assert all(p.unallocated_amount == p.amount and p.status == "UNRECONCILED" for p in result.payments.collect())


def test_known_files_and_rows_are_skipped(spark):
    first = import_statements(files(spark, FILES))
    done = first.report
    again = import_statements(files(spark, FILES), batches=done, stored=first.transactions)
    assert {r.status for r in again.report.collect()} <= {"FAILED"} and again.transactions.count() == 0
    _, judged = judge_statements(files(spark, {"new.csv": FILES["b.csv"] + "\n"}), stored=first.transactions, skip_duplicates=False)
    assert sorted(r.outcome for r in judged.collect()) == ["DUPLICATE_ERROR", "INVALID"]


def test_one_fingerprint_in_most_rows(spark):
    lines = "".join(f"2026-03-01,n{i},SAMEREF1,{i}.00,\n" for i in range(1, 400))
    _, judged = judge_statements(files(spark, {f"f{n}.csv": "Date,Narration,Ref No,Credit,Debit\n" + lines for n in range(3)}))
    counts = {(r.file_name, r.outcome): r["count"] for r in judged.groupBy("file_name", "outcome").count().collect()}
    assert counts == {("f0.csv", "IMPORTED"): 1, ("f0.csv", "DUPLICATE_IN_FILE"): 398, ("f1.csv", "DUPLICATE_STORED"): 399, ("f2.csv", "DUPLICATE_STORED"): 399}


def test_stream_never_imports_a_row_twice(spark, tmp_path):
    landing, out = tmp_path / "landing" / "c1", tmp_path / "out"
    landing.mkdir(parents=True)

    def run():
        import_stream(spark, str(tmp_path / "landing"), str(out), str(tmp_path / "checkpoint"), company_of=lambda p: F.regexp_extract(p, "/([^/]+)/[^/]+$", 1)).awaitTermination()
        return spark.read.parquet(f"{out}/transactions").count(), spark.read.parquet(f"{out}/payments").count()

    (landing / "one.csv").write_text(FILES["a.csv"])
    assert run() == (1, 1)
    (landing / "two.csv").write_text(FILES["a.csv"])
    (landing / "three.csv").write_text(FILES["a.csv"].replace("Acme Corp", "Acme") + "2026-03-02,other,NEWREF99,1,,\n")
    assert run() == (2, 2)
    assert run() == (2, 2)


def test_allocations_equal_a_running_balance(spark):
    rng = random.Random(5)
    pays = payments(spark, *[dict(payment_id=f"p{i}", amount=rng.randint(50, 200), status=rng.choice(["UNRECONCILED"] * 5 + ["IGNORED"])) for i in range(12)])
    table = {r.payment_id: r for r in pays.collect()}
    asked = [("c1", f"p{0 if rng.random() < 0.4 else rng.randint(0, 12)}", n, rng.choice(["ALLOCATE", "ALLOCATE", "REVERT"]), money(rng.randint(-2, 60)), rng.choice(["INR"] * 9 + ["USD"])) for n in range(600)]
    changes = spark.createDataFrame(asked, f"company_id string, payment_id string, seq bigint, kind string, amount {schemas.MONEY}, currency string")
    applied = ledger.apply_allocations(pays, changes)
    state, want = {p: (r.allocated_amount, r.unallocated_amount, r.status) for p, r in table.items()}, {}
    for _, p, n, kind, amount, currency in asked:
        if p not in table:
            want[n] = "PAYMENT_NOT_FOUND"
            continue
        a, u, s = state[p]
        if kind == "ALLOCATE" and s == "IGNORED":
            want[n] = "PAYMENT_IGNORED"
        elif currency != "INR":
            want[n] = "CURRENCY_MISMATCH"
        elif amount <= 0:
            want[n] = "NON_POSITIVE_AMOUNT"
        elif kind == "ALLOCATE" and amount > u:
            want[n] = "EXCEEDS_UNALLOCATED"
        elif kind == "REVERT" and amount > a:
            want[n] = "EXCEEDS_ALLOCATED"
        else:
            want[n] = "ACCEPTED"
            a, u = (a + amount, u - amount) if kind == "ALLOCATE" else (a - amount, u + amount)
            s = ("RECONCILED" if u == 0 else "PARTIALLY_RECONCILED") if kind == "ALLOCATE" else ("UNRECONCILED" if a == 0 else "PARTIALLY_RECONCILED")
            state[p] = (a, u, s)
    assert {r.seq: r.verdict for r in applied.collect()} == want
    assert {r.payment_id: (r.allocated_amount, r.unallocated_amount, r.status) for r in ledger.allocated_payments(pays, applied).collect()} == state


def test_receipts_stop_at_the_balance(spark):
    inv = invoices(spark, dict(total=100), dict(total=100, status="DRAFT"))
    rows = [("c1", "i0000", 1, money(60), "INR"), ("c1", "i0000", 2, money(60), "INR"), ("c1", "i0000", 3, money(40), "INR"), ("c1", "i0000", 4, money(1), "INR"), ("c1", "i0001", 5, money(1), "INR")]
    applied = ledger.apply_receipts(inv, spark.createDataFrame(rows, f"company_id string, invoice_id string, seq bigint, amount {schemas.MONEY}, currency string"))
    assert {r.seq: r.verdict for r in applied.collect()} == {1: "ACCEPTED", 2: "EXCEEDS_OUTSTANDING", 3: "ACCEPTED", 4: "STATUS_NOT_OPEN", 5: "STATUS_NOT_OPEN"}
    assert {r.invoice_id: (r.status, r.outstanding_amount) for r in ledger.received_invoices(inv, applied).collect()} == {"i0000": ("PAID", money(0)), "i0001": ("DRAFT", money(100))}


def test_document_screening(spark):
    cases = {"a.pdf": (b"%PDF-1.4 hello", None), "late.pdf": (b"x" * 128 + b"%PDF-1.4", None), "too_late.pdf": (b"x" * 129 + b"%PDF-1.4", "UNSUPPORTED_SIGNATURE"),
             "b.png": (b"\x89PNG\r\n\x1a\n12345678", None), "c.jpeg": (b"\xff\xd8\xff\xe0abcd", None), "d.pdf": (b"\xff\xd8\xff\xe0abcd", "EXTENSION_CONTRADICTS_TYPE"),
             "e.pdf": (b"<HTML><body>x", "ACTIVE_CONTENT"), "f.exe": (b"MZ123456", "EXTENSION_NOT_ALLOWED"), "g.pdf": (b"MZ123456", "ACTIVE_CONTENT"), "h.pdf": (b"tiny", "FILE_TOO_SMALL"),
             "noext": (b"%PDF-1.4 hello", "NO_EXTENSION"), "i.pdf": (b"", "EMPTY_FILE")}
    df = spark.createDataFrame([("c1", n, bytearray(b)) for n, (b, _) in cases.items()], "company_id string, file_name string, content binary")
    assert {r.file_name: r.file_error for r in docfiles.screen_documents(df).collect()} == {n: e for n, (_, e) in cases.items()}


def test_day_zero_fails_the_document(spark):
    body = lambda d: bytearray(f"%PDF-1.4\nInvoice No: A-1\nDate {d}\nTotal: 5.00".encode())
    df = spark.createDataFrame([("c1", "a.pdf", body("00/05/2024")), ("c1", "b.pdf", body("20/05/2024")), ("c1", "c.pdf", body("20/05/2024"))], "company_id string, file_name string, content binary")
    got = {r.file_name: r.ocr_status for r in documents.process_documents(df).collect()}
    assert got == {"a.pdf": "FAILED", "b.pdf": "VALIDATION_REQUIRED"}


def test_imports_are_repeatable(spark):
    one, two = (sorted(r.payment_id for r in import_statements(files(spark, FILES)).payments.collect()) for _ in range(2))
    assert one == two and len(set(one)) == len(one)
    assert date(2026, 3, 1) in {r.payment_date for r in import_statements(files(spark, FILES)).payments.collect()}


def test_records_and_cells_are_those_of_a_csv_reader(spark):
    import csv
    import io

    from remitlens.sources import statements
    rng = random.Random(5)
    bodies = ['Date,Narration,Credit,Debit\n2026-01-01,"two\nlines",10,\n2026-01-02,PIPE 5" STEEL,20.00,\n2026-01-03,x,30,\n2026-01-04,y "z",40,\n', 'Date,Narration,Amount\n2026-01-01,"never closed,5\n2026-01-02,b,6\n']
    for _ in range(60):
        cells = lambda: rng.choice(["", "a", 'q"q', '"x"', '"x,y"', '"l1\nl2"', '"d""q"', '"a"b"c', " b ", '5"'])
        bodies.append("Date,Narration,Amount\n" + "\n".join(",".join(["2026-01-01", cells(), cells()]) for _ in range(rng.randint(1, 6))) + "\n")
    found = statements.statement_rows(statements.parse_layout(statements.screen_files(files(spark, {f"f{i:03d}.csv": b for i, b in enumerate(bodies)}))))
    got = {}
    for r in found.collect():
        got.setdefault(r.file_name, []).append((r.row_number, list(r.cells)))
    for i, body in enumerate(bodies):
        rows = list(csv.reader(io.StringIO("\n".join(line for line in body.split("\n") if line.strip()))))[1:]
        want = [(k, row) for k, row in enumerate(rows, 2) if any(v.strip() for v in row)]
        # doubled quotes after a closed quote are the one place where cells may differ
        assert sorted(got.get(f"f{i:03d}.csv", [])) == want, body


def test_amounts_that_overflow_become_null_and_do_not_stop_the_job(spark):
    from remitlens.functions import money as M
    df = spark.createDataFrame([(Decimal("999999999999.99"), Decimal("999999999999.99"))], "a decimal(14,2), b decimal(14,2)")
    inr = F.lit("INR")
    row = df.select(M.add(F.col("a"), F.col("b"), inr, inr).alias("s"), M.subtract(F.col("a"), F.col("b"), inr, inr).alias("d"), M.multiply(F.col("a"), F.lit(Decimal("3.5"))).alias("m")).first()
    assert (row.s, row.d, row.m) == (None, Decimal("0.00"), None)
    pays = payments(spark, dict(payment_id="p", amount=Decimal("999999999999.99"), unallocated_amount=Decimal("999999999999.99"), allocated_amount=0))
    ledger.allocated_payments(pays, ledger.apply_allocations(pays, spark.createDataFrame(
        [("c1", "p", 1, "REVERT", Decimal("999999999999.99"), "INR")], f"company_id string, payment_id string, seq bigint, kind string, amount {schemas.MONEY}, currency string"))).collect()


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    import pytest
    from remitlens.session import checkpoint_dir

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            checkpoint_dir(session(master))
        assert checkpoint_dir(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert checkpoint_dir(session("local[4]"))


def test_a_finished_run_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from remitlens import session
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: str(tmp_path))
    assert session.cut_lineage(spark.range(5)).count() == 5 and Path(session.run_dir(spark)).exists()
    session.clear_run(spark)
    assert list(tmp_path.iterdir()) == []


def test_index_of_fingerprints(spark, tmp_path):
    from remitlens.sources.fingerprint_index import FingerprintIndex
    keys = lambda *hs: spark.createDataFrame([("c1", h) for h in hs], "company_id string, deduplication_hash string")
    index = FingerprintIndex(spark, str(tmp_path / "i"), slots=8)
    said = lambda hs, batch: sorted(r.deduplication_hash for r in index.known(keys(*hs), batch).collect())
    assert said(["a", "b"], "1") == []
    index.add(keys("a", "b", "a"), "1")
    index.add(keys("a", "b"), "1")  # a job run again
    assert said(["a", "b", "x"], "1") == [] and said(["a", "x", "a"], "2") == ["a"] and index.entries().count() == 2
    index.add(keys("c"), "2")
    again = FingerprintIndex(spark, str(tmp_path / "i"), slots=99)
    assert again.slots == 8 and sorted(r.deduplication_hash for r in again.known(keys("a", "c"), "3").collect()) == ["a", "c"]
    small = again.compacted(str(tmp_path / "j"))
    assert sorted(r.deduplication_hash for r in small.entries().collect()) == ["a", "b", "c"]
    # a batch of one key lists the folders of one slot only
    plan = again.known(keys("a"), "3")._jdf.queryExecution().executedPlan().toString()
    slot = again._slotted(keys("a")).first().slot
    assert "slot#" in plan and "PartitionFilters" in plan and str(slot) in plan[plan.index("PartitionFilters"):]


def test_runs_of_the_searched_texts_are_never_broadcast(spark):
    """They are hundreds of rows a customer, which the size of the table doesn't tell."""
    customers = spark.createDataFrame([("c1", "k1", "Rapid Tools", "TX1", "a@x.org", None, False), ("c1", "k2", "Slow Tools", None, None, "+91", False), ("c1", "k3", "Rare", None, None, None, True)],
                                      "company_id string, customer_id string, name string, tax_id string, email string, phone string, is_archived boolean")
    aliases = spark.createDataFrame([("c1", "k2", "Éclair Trading"), ("c1", "k3", "Gone Trading")], "company_id string, customer_id string, alias_name string")
    identifiers = spark.createDataFrame([("c1", "k1", "9000")], "company_id string, customer_id string, identifier_value string")
    asked = spark.createDataFrame([("c1", q) for q in ["rapid", "tools", "éclair", "+9", "x", "gone", "9000", " ", "nothing"]] + [("c2", "rapid")], "company_id string, query string")
    found = documents.unique_search(asked, customers, aliases, identifiers)
    assert {(r.company_id, r.query): r.customer_id for r in found.collect()} == {
        ("c1", "rapid"): "k1", ("c1", "éclair"): "k2", ("c1", "+9"): "k2", ("c1", "9000"): "k1", ("c1", "x"): "k1"}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
