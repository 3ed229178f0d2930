import itertools
import random

from builders import customers, identified, judged, payments
from remitlens.config import PayerPolicy, SkewPolicy
from remitlens.operators import intake, payer

PEOPLE = [
    dict(id="k1", name="Acme Industries Pvt Ltd", tax_id="29ABCDE1234F1Z5", aliases=["ACME IND"], identifiers=[("BANK_ACCOUNT", "9876-5432-10"), ("UPI_VPA", "acme@okbank")]),
    dict(id="k2", name="Beta Traders", identifiers=[("VIRTUAL_ACCOUNT", "VA-77 01")]),
    dict(id="k3", name="Gamma Chemicals Limited"),
    dict(id="k9", name="Old Acme", archived=True, identifiers=[("BANK_ACCOUNT", "555555555")]),
]


def outcome(spark, **row):
    r = identified(spark, payments(spark, row), *PEOPLE).collect()[0]
    return r.payer_status, r.payer_reason, r.customer_id, float(r.payer_score)


def test_coordinates(spark):
    ok = ("IDENTIFIED", "DETERMINISTIC_COUNTERPARTY_IDENTIFIED", "k1", 100.0)
    assert outcome(spark, payer_raw_identifier="9876 543210") == ok
    assert outcome(spark, narration="UPI-12345-acme@okbank/x") == ok[:3] + (95.0,)
    assert outcome(spark, narration="IMPS 9876543210 in") == ok[:3] + (95.0,)
    assert outcome(spark, bank_account_number="va7701") == ok[:2] + ("k2", 100.0)


def test_names_and_tax(spark):
    assert outcome(spark, payer_raw_name="acme ind")[2:] == ("k1", 85.0)
    assert outcome(spark, payer_raw_name="ACME Industries Private Limited")[2:] == ("k1", 75.0)
    assert outcome(spark, payment_reference="29abcde1234f1z5") == ("AMBIGUOUS", "LOW_CONFIDENCE_COUNTERPARTY_MATCH", None, 50.0)
    assert outcome(spark, narration="transfer gamma chemicals")[0:2] == ("AMBIGUOUS", "LOW_CONFIDENCE_COUNTERPARTY_MATCH")
    assert outcome(spark, narration="NEFT TRANSFER")[1] == "NO_RECOGNIZABLE_COUNTERPARTY_EVIDENCE"


def test_conflicts(spark):
    assert outcome(spark, payer_raw_identifier="9876543210", bank_account_number="VA7701")[:2] == ("CONFLICTING", "CONFLICTING_DIRECT_IDENTIFIERS")
    assert outcome(spark, payer_raw_identifier="9876543210", payer_raw_name="Beta Traders")[:2] == ("CONFLICTING", "CONFLICTING_COORDINATE_AND_NAME")


def test_archived_and_ineligible(spark):
    assert outcome(spark, payer_raw_identifier="555555555")[0] == "UNKNOWN"
    assert outcome(spark, transaction_type="DEBIT")[:2] == ("NOT_ELIGIBLE", "DEBIT_TRANSACTION_INELIGIBLE")
    none = identified(spark, payments(spark, {}), dict(id="k1", name="x", archived=True)).collect()[0]
    assert none.payer_reason == "NO_ACTIVE_CUSTOMERS_CONFIGURED"


def test_never_across_companies(spark):
    other = [dict(p, company="c2") for p in PEOPLE]
    row = identified(spark, payments(spark, dict(payer_raw_identifier="9876543210")), *other, dict(id="z", name="zzz")).collect()[0]
    assert row.customer_id is None and row.payer_status == "UNKNOWN"


def test_input_order_does_not_matter(spark):
    rows = [dict(payment_id=f"p{i}", payer_raw_name=n, narration=t) for i, (n, t) in enumerate(itertools.product(["acme ind", None, "Beta Traders"], ["acme@okbank", "gamma chemicals", None]))]
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = identified(spark, payments(spark, *rows).repartition(3), *random.Random(seed).sample(PEOPLE, len(PEOPLE)))
        results.add(tuple(sorted((r.payment_id, r.payer_status, r.customer_id or "", str(r.payer_score)) for r in got.collect())))
    assert len(results) == 1


def test_a_rival_known_by_words_is_the_runner_up_under_any_policy(spark):
    c, a, i = customers(spark, dict(id="k1", name="Alpha Chemicals"), dict(id="k2", name="Chemicals Works India"))
    context, pays = payer.customer_context(c, a, i), judged(payments(spark, dict(payment_id="p", payer_raw_name="Alpha Chemicals", narration="for works in india")))
    near, far = (payer.identify_payers(pays, context, payer.PayerPolicy(ambiguity_delta=d)).collect()[0] for d in (15, 40))
    assert (near.payer_status, near.customer_id, near.runner_up) == ("IDENTIFIED", "k1", "Chemicals Works India")
    assert near.top_score - near.runner_up_score < 40 and (far.payer_status, far.payer_reason) == ("AMBIGUOUS", "CLOSE_SCORE_COUNTERPARTY_AMBIGUITY")


def test_plan_has_no_pairwise_join(spark):
    c, a, i = customers(spark, *PEOPLE)
    plan = payer.identify_payers(judged(payments(spark, {})), payer.customer_context(c, a, i))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Inner\n" not in plan and "Join Cross" not in plan


def test_intake_cascade(spark):
    from datetime import date
    from remitlens.config import IntakePolicy
    rows = [dict(payment_id="a", amount=0), dict(payment_id="b", currency="rs"), dict(payment_id="c", allocated_amount=-1), dict(payment_id="d", unallocated_amount=5),
            dict(payment_id="e", payment_date=date(2030, 1, 1)), dict(payment_id="f", status="RECONCILED"), dict(payment_id="g", status="IGNORED"), dict(payment_id="h", status="ODD"),
            dict(payment_id="i", status="PARTIALLY_RECONCILED", allocated_amount=40), dict(payment_id="j")]
    got = {r.payment_id: (r.intake_status, r.intake_reason, float(r.effective_amount)) for r in intake.evaluate_intake(payments(spark, *rows), IntakePolicy(as_of=date(2026, 12, 1))).collect()}
    assert got == {
        "a": ("INVALID", "NON_POSITIVE_PAYMENT_AMOUNT", 0), "b": ("INVALID", "INVALID_CURRENCY_CODE", 0), "c": ("INVALID", "NEGATIVE_ALLOCATED_BALANCE", 0),
        "d": ("INVALID", "BALANCE_CONSERVATION_BREACH", 0), "e": ("INVALID", "FUTURE_TRANSACTION_DATE", 0), "f": ("ALREADY_PROCESSED", "FULLY_RECONCILED", 0),
        "g": ("INELIGIBLE", "PAYMENT_MARKED_IGNORED", 0), "h": ("INVALID", "INVALID_PAYMENT_STATUS", 0), "i": ("ELIGIBLE", "PARTIAL_BALANCE_AVAILABLE", 60),
        "j": ("ELIGIBLE", "READY_FOR_RECONCILIATION", 100)}


WORDS = ["alpha", "bravo", "corner", "delta", "echo", "foxtrot", "golfer", "hotel"]


def test_hot_words_change_no_verdict(spark):
    """The best two are the same whether or not payments meet every customer of a hot word; hot keys cut into cells change nothing either."""
    rng = random.Random(5)
    people = [dict(id=f"k{i:03d}", name=" ".join(rng.sample(WORDS, rng.randint(1, 5))) + rng.choice(["", f" unit{i}"]), aliases=[rng.choice(WORDS)] * rng.randint(0, 1)) for i in range(80)]
    pays = payments(spark, *[dict(payment_id=f"p{i:03d}", payer_raw_name=rng.choice([None, " ".join(rng.sample(WORDS, 2))]), narration=f"transfer {' '.join(rng.sample(WORDS, rng.randint(1, 4)))} unit{rng.randint(0, 90)}") for i in range(60)])
    known = [payer.customer_context(*customers(spark, *people))][0]
    seen = []
    for hot in (None, 0, 5, 25):
        found = payer.identify_payers(judged(pays), known, PayerPolicy(hot_owners=hot))
        seen.append(sorted(map(str, found.select("payment_id", "payer_status", "payer_reason", "customer_id", "payer_score", "top_customer", "top_score", "runner_up", "runner_up_score").collect())))
    assert seen[0] == seen[1] == seen[2] == seen[3] and len(set(seen[0])) == 60
    every, cells = (sorted(map(str, payer.token_signals(pays, known, skew=SkewPolicy(min_rows=n)).collect())) for n in (50_000, 10))
    assert every == cells and len(every) > 500


def test_a_word_of_all_customers_pairs_no_one_with_everyone(spark):
    people = [dict(id=f"k{i:04d}", name=f"Acmes branch{i}") for i in range(400)]
    known = payer.customer_context(*customers(spark, *people))
    pays = payments(spark, *[dict(payment_id=f"p{i}", narration=f"acmes branch{i}" if i < 5 else "acmes") for i in range(50)])
    made = payer.token_signals(judged(pays), known, hot_owners=100)
    assert made.count() <= 3 * 50 and payer.token_signals(judged(pays), known).count() == 50 * 400
    rows = {r.payment_id: (r.top_customer, r.runner_up) for r in payer.identify_payers(judged(pays), known, PayerPolicy(hot_owners=100)).collect()}
    assert rows["p3"] == ("Acmes branch3", "Acmes branch0") and rows["p9"] == ("Acmes branch0", "Acmes branch1")
