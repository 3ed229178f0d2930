from decimal import Decimal

from builders import customers, invoices, judged, payments
from pyspark.sql import functions as F
from remitlens.operators import candidates, evidence, payer, scoring

PEOPLE = [dict(id="k1", name="Acme Industries", aliases=["ACME IND"], identifiers=[("BANK_ACCOUNT", "9876543210")]), dict(id="k2", name="Beta", identifiers=[("BANK_ACCOUNT", "1111111111")])]


def collected(spark, *rows, **pay):
    c, a, i = customers(spark, *PEOPLE)
    context = payer.customer_context(c, a, i)
    paid = judged(payments(spark, dict(pay))).withColumns({"customer_id": F.lit("k1"), "customer_is_archived": F.lit(False)})
    inv = invoices(spark, *rows)
    return evidence.collect_evidence(paid, candidates.filter_candidates(candidates.resolved_payments(paid), inv), context)


def scores(ev, **extra):
    return {r.invoice_id: r for r in scoring.assess_confidence(scoring.score_candidates(scoring.normalize_evidence(ev))).collect()}


def test_full_marks(spark):
    ev = collected(spark, dict(total=100, due_date=payments.__globals__["DAY"]), amount=100, narration="Acme Industries INV-0000", bank_account_number="9876543210")
    row = scores(ev)["i0000"]
    assert (row.confidence_score, row.confidence_level, row.has_direct_evidence, row.has_conflicting_evidence, row.has_incomplete_evidence) == (Decimal("100.00"), "VERY_HIGH", True, False, False)


def test_other_reference_suppresses_number(spark):
    ev = collected(spark, dict(total=100), dict(total=100, invoice_number="INV-0777"), amount=100, narration="INV-0777")
    got = scores(ev)
    assert got["i0000"].has_conflicting_evidence and not got["i0001"].has_conflicting_evidence
    assert got["i0001"].confidence_score - got["i0000"].confidence_score == 35


def test_account_of_another_customer_suppresses_identifier(spark):
    ev = collected(spark, dict(total=100), amount=100, bank_account_number="1111111111")
    row = ev.collect()[0]
    assert row.has_conflicting_identifiers and [i.matched_value for i in row.payment_items if i.classification == "CONFLICTING"] == ["k2"]
    assert scores(ev)["i0000"].has_conflicting_evidence


def test_quirk_reference_keeps_its_case(spark):
    upper = collected(spark, dict(total=100), amount=100, payment_reference="INV-0000")
    lower = collected(spark, dict(total=100), amount=100, payment_reference="inv-0000")
    assert scores(upper)["i0000"].confidence_score - scores(lower)["i0000"].confidence_score == 35


def test_quirk_full_name_is_sought_in_the_narration_first(spark):
    kind = lambda **pay: [i.observed_result for i in collected(spark, dict(total=1), **pay).collect()[0].payment_items if i.evidence_type == "CUSTOMER_NAME_TOKEN"]
    assert kind(payer_raw_name="Acme Industries") == ["MATCHED"]
    assert kind(payer_raw_name="Acme Industries", narration="transfer") == ["TOKEN_OVERLAP"]


def test_quirk_account_suffix(spark):
    got = collected(spark, dict(total=1), bank_account_number="6543210").collect()[0]
    assert [i.observed_result for i in got.payment_items if i.evidence_type == "BANK_ACCOUNT_IDENTIFIER"] == ["MATCHED"]


def test_items_from_outside_count_and_bad_ones_are_set_aside(spark):
    ev = collected(spark, dict(total=500), amount=100)
    fields = "company_id string, payment_id string, invoice_id string, evidence_type string, classification string, source_field string, observed_result string, description string, target_entity string, matched_value string, expected_value string, days_difference int"
    extra = spark.createDataFrame([
        ("c1", "p1", "i0000", "HISTORICAL_CUSTOMER_PATTERN", "SUPPORTING", "customer.history", "MATCHED", "pays monthly", "INVOICE", None, None, None),
        ("c1", "p1", None, "UPI_VPA_IDENTIFIER", "DIRECT", "payment.narration", "MATCHED", "vpa", "CUSTOMER", "a@b", None, None),
        ("c1", "p1", None, "UPI_VPA_IDENTIFIER", "DIRECT", "payment.narration", "MATCHED", "vpa", "CUSTOMER", "a@b", None, None),
        ("c1", "p1", "i0000", "DATE_PROXIMITY", "MISSING", "candidate.due_date", "MATCHED", "odd", "INVOICE", None, None, None),
        ("c1", "p1", "i0000", "NEW_TYPE", "DIRECT", "x", "MATCHED", "odd", "INVOICE", None, None, None)], fields)
    normalized = scoring.normalize_evidence(scoring.with_items(ev, extra))
    row = normalized.collect()[0]
    assert sorted(i.error for i in row.rejected_items) == ["MISSING_CLASS_CONTRADICTS_RESULT", "UNSUPPORTED_EVIDENCE_TYPE"]
    assert sum(i.evidence_type == "UPI_VPA_IDENTIFIER" for i in row.payment_items) == 1
    assert any(i.source == "unknown.source" for i in row.bundles[0]["items"])
    score = scoring.score_candidates(normalized).collect()[0]
    assert {c.signal_type for c in score.contributions} >= {"IDENTIFIER_MATCH", "HISTORICAL_PATTERN"}


def test_each_fact_of_a_score_is_computed_once(spark):
    """Lambdas compute a name anew wherever it stands: the plan may hold each fact once, not once for every field made of it."""
    ev = collected(spark, dict(total=100), amount=100)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        normalized = scoring.normalize_evidence(ev)
        plan = lambda df: df._jdf.queryExecution().analyzed().toString()
        before, read = plan(ev), plan(normalized)
        scored = plan(scoring.score_candidates(normalized))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # one for the items of the payment, one for those of its candidates
    assert read.count(".observed_result") - before.count(".observed_result") == 2
    # the reference of the payment is looked for once in its items, once in a candidate's and named once by the test of its origin
    assert scored.count("PAYMENT_REFERENCE") - read.count("PAYMENT_REFERENCE") == 3
