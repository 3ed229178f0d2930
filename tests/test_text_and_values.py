import unicodedata
import re
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from remitlens.functions import dates, masking, money as M, text as X
from remitlens.operators.documents import extract_fields


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def plain_clean(s):
    kept = "".join(c for c in unicodedata.normalize("NFKD", s or "") if unicodedata.category(c) != "Mn")
    kept = re.sub("[\x00‎‏‪-‮⁦-⁩]", "", kept).replace("&", " and ").replace("@", " at ")
    return re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z0-9\s]", " ", kept).lower()).strip()


SAMPLES = ["Acme & Co.", "Société Générale S.A", "ﬁrst ½ ① Ⅷ ㎏", "a‮b\x00c", "İstanbul ÅÄÖ ß", "", None, "  x@y  ", "ＦＵＬＬ＆ｗｉｄｔｈ", "日本 abc 한국"]


def test_clean_text_matches_the_unicode_tables(spark):
    assert column(spark, SAMPLES, X.clean_text) == [plain_clean(s) for s in SAMPLES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40).filter(lambda s: not any(0xD800 <= ord(c) <= 0xDFFF for c in s)), min_size=20, max_size=40))
def test_clean_text_on_random_text(spark, texts):
    ours = column(spark, texts, X.clean_text)
    # white space the ASCII rules turn into a space is the same either way
    assert ours == [plain_clean(s) for s in texts]


def test_legal_names(spark):
    names = ["Acme Pvt Ltd", "Acme Private Limited", "Pvt Ltd", "Company", "Tata Chemicals Ltd", "A Co Ltd", "Gmbh House"]
    assert column(spark, names, X.legal_name) == ["acme", "acme", "pvt", "company", "tata chemicals", "a co", "gmbh house"]


def test_tokens_identifiers_vpas(spark):
    assert column(spark, ["NEFT 12345 payment from Acme Traders to hdfc Acme"], lambda c: F.array_sort(X.tokens(c))) == [["acme", "traders"]]
    assert column(spark, ["12-34 56/7.8", " User.Name @OKBank ", None, "a@b@c"], X.normalize_identifier) == ["12345678", "user.name@okbank", "", "a@bc"]
    assert column(spark, ["UPI-12345-user@icici x", "pay@ybl neft@hdfc ab@cd"], X.extract_vpas) == [["user@icici", "upi-12345-user@icici"], ["ab@cd"]]
    assert column(spark, ["INVOICE-12", "inv_7/8", "BILL:9"], X.normalize_invoice_token) == ["OICE12", "78", "9"]


def test_statement_amounts_and_dates(spark):
    raw = ["1,25,000.00", "₹ 50,000.50", "$10,500.25", "=1", "12a", "1-2", "+5", "--5", "1.2.3", "1.005", "-1.005", ".5", "-", ""]
    d = lambda *v: [None if x is None else Decimal(x) for x in v]
    assert column(spark, raw, M.statement_amount) == d("125000.00", "50000.50", "10500.25", None, None, None, "5.00", None, None, "1.01", "-1.01", "0.50", None, None)
    days = ["2026-03-01", "02/03/2026", "03-03-2026", "04.03.2026", "05-Mar-2026", "5-march-2026", "Mar 31, 2026", "03/31/2026", "31-02-2026", "x"]
    want = [date(2026, 3, 1), date(2026, 3, 2), date(2026, 3, 3), date(2026, 3, 4), date(2026, 3, 5), date(2026, 3, 5), date(2026, 3, 31), date(2026, 3, 31), None, None]
    assert column(spark, days, dates.statement_date) == want


def test_document_amounts_and_dates(spark):
    raw = ["₹1,50,000.00", "Total: $150,000.00", "1,5,0", "-5", "=5", "12x", "Rs. 500/-"]
    got = column(spark, raw, M.document_amount)
    assert [(g.amount, g.currency, g.is_valid) for g in got] == [
        (Decimal("150000.00"), "INR", True), (Decimal("150000.00"), "USD", True), (None, "INR", False), (None, "INR", False), (None, "INR", False), (None, "INR", False),
        (Decimal("500.00"), "INR", True)]
    got = column(spark, ["15th January 2024", "Jan 15, 2024", "2024-05-15", "25/12/2024", "12/25/2024", "04/05/2024", "31 Feb 2024", "none", ""], dates.document_date)
    assert [(g.parsed_date, g.is_ambiguous) for g in got] == [
        (date(2024, 1, 15), False), (date(2024, 1, 15), False), (date(2024, 5, 15), False), (date(2024, 12, 25), False), (date(2024, 12, 25), False), (date(2024, 5, 4), True),
        (None, True), (None, True), (None, False)]


def test_masks(spark):
    assert column(spark, ["123456789", "123", None, ""], masking.mask_account) == ["*****6789", "****", None, None]
    assert column(spark, ["123456789", "123"], masking.mask_account_bullets) == ["••••••••6789", "123"]
    assert column(spark, ["rahul@okbank", "ab@x", "12345"], masking.mask_vpa) == ["ra***@okbank", "**@x", "*2345"]


@pytest.mark.parametrize("text,number,total,status", [
    ("Invoice No: INV-77\nBill To: Acme\nGSTIN 29ABCDE1234F1Z5\nDate 2026-01-15 due 2026-02-15\nGrand Total: INR 1180.00\nSub Total: 1000.00\nTax Amount: 180.00", "INV-77", "1180.00", False),
    ("Invoice No: 29ABCDE1234F1Z5\nGSTIN 29ABCDE1234F1Z5\nINV-900 Date 2026-01-15 Total: 10.00", "INV-900", "10.00", False),
    ("nothing here", None, None, True),
])
def test_document_fields(spark, text, number, total, status):
    row = extract_fields(spark.createDataFrame([(text,)], "text string")).collect()[0]
    assert (row.invoice_number, row.total_amount, row.is_ambiguous) == (number, None if total is None else Decimal(total), status)


def test_a_currency_code_inside_a_name_is_none(spark):
    from remitlens.functions.documents import currency_of
    cases = {"Bill To: BGBPFL & building LLP\nTotal: 5.00": "INR", "Bill To: Eurotrade, EUROPE": "INR", "AUSDB": "INR", "Total: USD 5.00": "USD", "GBP5.00": "GBP", "5.00EUR": "EUR",
             "$5": "USD", "5 £": "GBP", "EUR 1, USD 2": "USD", "ÄEUR": "INR", "": "INR"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", currency_of(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_document_patterns_are_tried_once(spark):
    """A date's month name and a document's labelled number are sought once, not for every month and every test of them."""
    from remitlens import vocab
    from remitlens.functions import documents
    texts = spark.createDataFrame([("x",)], "text string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = lambda column: texts.select(column.alias("o"))._jdf.queryExecution().analyzed().toString()
        c = F.col("text")
        dated, numbered = plan(dates.document_date(c)), plan(documents.invoice_number(c, c, c, c))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # the month decides, and year, month and day are taken from where it was found
    assert dated.count(dates._DAY_MONTH) == dated.count(dates._MONTH_DAY) == dated.count(dates._NUMERIC) == 3
    assert numbered.count(vocab.INVOICE_LABELLED) == numbered.count(vocab.INVOICE_FALLBACK) == 1
