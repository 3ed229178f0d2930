import itertools
import random
from datetime import date, timedelta

import pytest

from builders import DAY, invoices, judged, money, payments, universe
from pyspark.sql import functions as F
from remitlens.config import CandidateFilterCriteria, CandidateLimit, CombinationMatchCriteria, MultiInvoiceMatchCriteria, PolicyError, SkewPolicy
from remitlens.operators import candidates, matching, multi


def test_bound_keeps_the_exact_candidate_first(spark):
    rows = [dict(total=1000 + i) for i in range(99)] + [dict(total="5432.10")]
    pays, owed = payments(spark, dict(amount="5432.10")), invoices(spark, *rows)
    u = universe(pays, owed, CandidateFilterCriteria(max_candidates=30)).collect()[0]
    assert (len(u.candidates), u.candidates[0].invoice_id, u.is_truncated, u.exclusion_breakdown) == (30, "i0099", True, {"TRUNCATED_BY_LIMIT": 70})
    assert [c.rank for c in u.candidates] == list(range(1, 31))
    every = universe(pays, owed).collect()[0]
    assert (len(every.candidates), every.candidates[0].invoice_id, every.is_truncated, every.exclusion_breakdown) == (100, "i0099", False, {})


def test_all_reasons_are_recorded(spark):
    rows = [dict(total=100, issue_date=DAY + timedelta(3), due_date=DAY + timedelta(9)), dict(total=50), dict(total=500, issue_date=date(2024, 1, 1)),
            dict(total=500, issue_date=date(2024, 1, 1), invoice_number="OLD-9")]
    criteria = CandidateFilterCriteria(min_amount=money(80), disallow_overpayment=True)
    p = payments(spark, dict(amount=100, narration="for old-9"))
    known = candidates.resolved_payments(judged(p).withColumns({"customer_id": F.lit("k1"), "customer_is_archived": F.lit(True)}))
    got = {r.invoice_id: r.exclusion_reasons for r in candidates.excluded_candidates(known, invoices(spark, *rows), criteria).collect()}
    assert got == {"i0000": ["CUSTOMER_ARCHIVED", "NON_CAUSAL_DATE"], "i0001": ["CUSTOMER_ARCHIVED", "AMOUNT_BELOW_MINIMUM"],
                   "i0002": ["CUSTOMER_ARCHIVED", "EXCEEDS_PAYMENT_AMOUNT", "DATE_OUT_OF_WINDOW"], "i0003": ["CUSTOMER_ARCHIVED", "EXCEEDS_PAYMENT_AMOUNT"]}


def test_statuses(spark):
    p = payments(spark, dict(payment_id="a"), dict(payment_id="b", currency="USD"), dict(payment_id="c", status="IGNORED"))
    got = {r.payment_id: r.status_code for r in universe(p, invoices(spark, dict(total=5))).collect()}
    assert got == {"a": "SUCCESS", "b": "CURRENCY_MISMATCH", "c": "NOT_ELIGIBLE"}
    assert universe(payments(spark, {}), invoices(spark, dict(total=5, company_id="c2"))).collect()[0].status_code == "NO_ELIGIBLE_INVOICES"
    assert universe(payments(spark, {}), invoices(spark, dict(total=5)), customer=None).collect()[0].status_code == "CUSTOMER_UNRESOLVED"


def test_duplicate_pairs_are_gated(spark):
    known = candidates.resolved_payments(judged(payments(spark, {})).withColumns({"customer_id": F.lit("k1"), "customer_is_archived": F.lit(False)}))
    inv = invoices(spark, dict(total=5), dict(total=5, customer_id="k2"), dict(total=5, company_id="c2", invoice_id="x")).withColumnsRenamed({"company_id": "invoice_company_id", "customer_id": "invoice_customer_id"})
    pairs = known.join(inv.unionByName(inv.where("invoice_id = 'i0000'")), F.lit(True))
    u = candidates.filter_pairs(pairs).collect()[0]
    assert u.exclusion_breakdown == {"DUPLICATE_CANDIDATE": 1, "CUSTOMER_MISMATCH": 1, "TENANT_MISMATCH": 1} and u.total_retained == 1


def test_hot_customers_give_the_same_result(spark):
    rng = random.Random(3)
    inv = invoices(spark, *[dict(total=rng.randint(1, 60), customer_id=rng.choice(["k1"] * 9 + ["k2"]), due_date=DAY + timedelta(rng.randint(-60, 20)), issue_date=DAY - timedelta(rng.randint(0, 500)),
                                 currency=rng.choice(["INR", "INR", "USD"])) for _ in range(300)])
    pays = payments(spark, *[dict(payment_id=f"p{i:03d}", amount=rng.randint(1, 60), narration=f"INV-{rng.randint(0, 400):04d}") for i in range(120)])
    known = judged(pays).withColumns({"customer_id": F.when(F.col("payment_id") < "p100", "k1").otherwise("k2"), "customer_is_archived": F.lit(False)})
    resolved = candidates.resolved_payments(known)
    results = []
    for skew in (SkewPolicy(), SkewPolicy(min_rows=20, max_keys=1000), SkewPolicy(min_rows=7, max_keys=1000)):
        rows = candidates.filter_candidates(resolved, inv, CandidateFilterCriteria(max_candidates=5), skew).collect()
        assert len(rows) == 120
        results.append(sorted((r.payment_id, r.status_code, r.total_evaluated, r.total_retained, str(sorted(r.exclusion_breakdown.items())), r.overflow_exact, r.overflow_larger,
                               str([(c.rank, c.invoice_id) for c in r.candidates])) for r in rows))
    assert results[0] == results[1] == results[2]


def test_pairs_are_neither_sorted_nor_shuffled_with_their_texts(spark):
    known = candidates.resolved_payments(judged(payments(spark, {})).withColumns({"customer_id": F.lit("k1"), "customer_is_archived": F.lit(False)}))
    owed = invoices(spark, dict(total=5), dict(total=100))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(candidates.filter_candidates(known, owed, CandidateFilterCriteria(max_candidates=1)))
    pairs = known.join(owed.withColumnsRenamed({"company_id": "invoice_company_id", "customer_id": "invoice_customer_id"}), F.lit(True))
    assert plan(candidates.filter_pairs(pairs, CandidateFilterCriteria(max_candidates=1))).count("Exchange hashpartitioning") == 1


def test_generation_is_bounded_before_gates(spark):
    known = candidates.resolved_payments(judged(payments(spark, {})).withColumn("customer_id", F.lit("k1")))
    u = candidates.generate_universe(known, invoices(spark, *[dict(total=5, issue_date=DAY + timedelta(5)) for _ in range(4)]), CandidateLimit(3)).collect()[0]
    assert (u.total_eligible_invoices, u.truncated, len(u.candidates), u.status_code) == (4, True, 3, "SUCCESS")


@pytest.mark.parametrize("amount,totals,exact,partial", [
    (17000, [1000 * i for i in range(1, 31)], "EXACT_MATCH", "AMBIGUOUS_PARTIAL_MATCH"), (5000, [10000 + 1000 * i for i in range(30)], "NO_EXACT_MATCH", "AMBIGUOUS_PARTIAL_MATCH"),
    (100, [100, 100], "AMBIGUOUS_EXACT_MATCH", "NO_PARTIAL_MATCH"), (100, [150], "NO_EXACT_MATCH", "PARTIAL_MATCH"), (100, [20], "NO_EXACT_MATCH", "NO_PARTIAL_MATCH")])
def test_one_to_one(spark, amount, totals, exact, partial):
    u = universe(payments(spark, dict(amount=amount)), invoices(spark, *[dict(total=t) for t in totals]))
    assert (matching.match_exact(u).collect()[0].status, matching.match_partial(u).collect()[0].status) == (exact, partial)


def test_truncation_makes_an_unreferenced_match_ambiguous(spark):
    inv = invoices(spark, *[dict(total=100 if i == 3 else 7, due_date=DAY - timedelta(i)) for i in range(6)])
    tight = CandidateFilterCriteria(max_candidates=2)
    row = matching.match_exact(universe(payments(spark, {}), inv, tight)).collect()[0]
    assert (row.status, row.reason_code) == ("AMBIGUOUS_EXACT_MATCH", "TRUNCATED_UNIVERSE_AMBIGUITY")
    row = matching.match_exact(universe(payments(spark, dict(narration="INV-0003")), inv, tight)).collect()[0]
    assert (row.status, row.reason_code) == ("EXACT_MATCH", "EXACT_AMOUNT_WITH_REFERENCE_MATCH")


FIFO = [dict(total=10000, due_date=date(2026, 5, 1)), dict(total=25000, due_date=date(2026, 5, 15)), dict(total=15000, due_date=date(2026, 6, 1)),
        dict(total=8000, due_date=date(2026, 6, 10)), dict(total=12000, due_date=date(2026, 6, 20))]


def test_oldest_debt_first(spark):
    row = multi.match_combination(universe(payments(spark, dict(amount=35000)), invoices(spark, *FIFO))).collect()[0]
    assert (row.status, row.applied_heuristic, row.requires_review, row.total_found) == ("PRIORITIZED_COMBINATION_MATCH", "RULE_M3_FIFO_AGING", True, 2)
    assert row.matched.invoice_ids == ["i0000", "i0001"] and row.competing[0].invoice_ids == ["i0000", "i0001"]
    off = multi.match_combination(universe(payments(spark, dict(amount=35000)), invoices(spark, *FIFO)), CombinationMatchCriteria(enable_fifo_aging=False)).collect()[0]
    assert off.reason_code == "MULTIPLE_COMBINATIONS_UNRESOLVED"
    named = multi.match_combination(universe(payments(spark, dict(amount=35000, narration="inv 0002 and inv0003, inv-0004")), invoices(spark, *FIFO))).collect()[0]
    assert (named.reason_code, named.matched.invoice_ids) == ("REFERENCE_PRIORITIZED", ["i0002", "i0003", "i0004"])


@pytest.mark.parametrize("size", [2, 3, 4, 6, None])
def test_sets_equal_enumeration(spark, size):
    rng = random.Random(size or 1)
    cases = {f"p{i:02d}": (rng.randint(20, 90), [rng.randint(1, 40) for _ in range(rng.randint(2, 12))]) for i in range(25)}
    pays = payments(spark, *[dict(payment_id=p, amount=a) for p, (a, _) in cases.items()])
    inv = invoices(spark, *[dict(invoice_id=f"{p}-{j:02d}", invoice_number=f"N{p}{j:02d}", customer_id=p, total=t) for p, (_, ts) in cases.items() for j, t in enumerate(ts)])
    known = judged(pays).withColumns({"customer_id": F.col("payment_id"), "customer_is_archived": F.lit(False)})
    u = candidates.filter_candidates(candidates.resolved_payments(known), inv)
    got = {r.payment_id: (r.total_found, sorted(tuple(h.invoice_ids) for h in (r.competing or ([r.matched] if r.matched else []))))
           for r in multi.match_multi_invoice(u, MultiInvoiceMatchCriteria(max_combination_size=size)).collect()}
    for p, (amount, totals) in cases.items():
        small = [(f"{p}-{j:02d}", t) for j, t in enumerate(totals) if t < amount]
        want = sorted(tuple(i for i, _ in c) for k in range(2, (size or len(small)) + 1) for c in itertools.combinations(small, k) if sum(t for _, t in c) == amount)
        assert got[p] == (len(want), want), p


def test_flood_of_thirty(spark):
    inv = invoices(spark, *[dict(total=5000 * i) for i in range(1, 31)])
    row = multi.match_combination(universe(payments(spark, dict(amount=155000)), inv)).collect()[0]
    want = sum(1 for k in range(2, 8) for c in itertools.combinations(range(1, 31), k) if sum(c) == 31)
    assert row.total_found == want
    assert all(sum(h.invoices_outstanding_before) == money(155000) for h in row.competing)
    at_limit = multi.match_combination(universe(payments(spark, dict(amount=150000)), inv)).collect()[0]
    assert at_limit.reason_code == "EXACT_MATCH_DETECTED"


def test_five_invoices_settle_one_payment(spark):
    u = universe(payments(spark, dict(amount=500)), invoices(spark, *[dict(total=100) for _ in range(5)]))
    row = multi.match_multi_invoice(u).collect()[0]
    assert (row.status, row.total_found, len(row.matched.invoice_ids)) == ("MULTI_INVOICE_MATCH", 1, 5)
    assert row.matched.invoices_outstanding_after == [money(0)] * 5 and (row.matched.payment_unallocated_before, row.matched.payment_unallocated_after) == (money(500), money(0))
    four = multi.match_multi_invoice(u, MultiInvoiceMatchCriteria(max_combination_size=4)).collect()[0]
    assert four.reason_code == "NO_MULTI_INVOICE_COMBINATION_FOUND"


def test_equal_invoices_are_counted_without_listing(spark):
    """More sets than any list could hold: the count, the named set and the oldest debt still come out."""
    from math import comb
    inv = invoices(spark, *[dict(total=100, issue_date=DAY - timedelta(200), due_date=DAY - timedelta(i)) for i in range(100)])
    u = universe(payments(spark, dict(payment_id="a", amount=400), dict(payment_id="b", amount=5000), dict(payment_id="c", amount=200, narration="INV-0003 and INV-0007")), inv).cache()
    many = {r.payment_id: r for r in multi.match_multi_invoice(u).collect()}
    assert {p: r.total_found for p, r in many.items()} == {"a": comb(100, 4), "b": 10**18, "c": comb(100, 2)}
    assert all(r.status == "AMBIGUOUS_MULTI_INVOICE_MATCH" and r.competing == [] and not r.is_listing_complete for r in many.values())
    rows = {r.payment_id: r for r in multi.match_combination(u).collect()}
    assert (rows["a"].reason_code, rows["a"].matched.invoice_ids) == ("FIFO_AGING_PRIORITIZED", [f"i{i:04d}" for i in (96, 97, 98, 99)])
    assert (rows["c"].reason_code, rows["c"].matched.invoice_ids) == ("REFERENCE_PRIORITIZED", ["i0003", "i0007"])
    assert rows["b"].reason_code == "FIFO_AGING_PRIORITIZED" and len(rows["b"].matched.invoice_ids) == 50


def test_preferred_set_is_the_same_with_and_without_the_list(spark):
    rng = random.Random(7)
    cases = {f"p{i:02d}": (rng.randint(20, 60), [rng.randint(1, 12) for _ in range(rng.randint(6, 13))]) for i in range(30)}
    pays = payments(spark, *[dict(payment_id=p, amount=a) for p, (a, _) in cases.items()])
    inv = invoices(spark, *[dict(invoice_id=f"{p}-{j:02d}", invoice_number=f"N{p}{j:02d}", customer_id=p, total=t, due_date=DAY - timedelta(rng.randint(0, 6)))
                            for p, (_, ts) in cases.items() for j, t in enumerate(ts)])
    known = judged(pays).withColumns({"customer_id": F.col("payment_id"), "customer_is_archived": F.lit(False)})
    u = candidates.filter_candidates(candidates.resolved_payments(known), inv).cache()
    outcome = lambda r: (r.payment_id, r.status, r.reason_code, r.total_found, r.matched)
    listed, counted = ([outcome(r) for r in multi.match_combination(u, CombinationMatchCriteria(max_listed=n)).orderBy("payment_id").collect()] for n in (None, 1))
    assert listed == counted and len({r[2] for r in listed}) >= 3
    sets = multi.multi_invoice_sets(u).groupBy("payment_id").count().collect()
    assert {r[0]: r[1] for r in sets} == {r.payment_id: r.total_found for r in multi.match_multi_invoice(u).collect() if r.total_found}


def test_order_of_input_does_not_matter(spark):
    seen = set()
    for seed in range(3):
        rows = [dict(r, invoice_id=f"i{n}", invoice_number=f"INV-{n}") for n, r in enumerate(FIFO)]
        random.Random(seed).shuffle(rows)
        row = multi.match_combination(universe(payments(spark, dict(amount=35000)), invoices(spark, *rows).repartition(3))).collect()[0]
        seen.add(str((row.status, row.matched, row.competing)))
    assert len(seen) == 1


def test_policies_are_checked():
    with pytest.raises(PolicyError):
        CandidateFilterCriteria(max_candidates=101)
    with pytest.raises(PolicyError):
        CombinationMatchCriteria(max_combination_size=1)
    with pytest.raises(PolicyError):
        MultiInvoiceMatchCriteria(max_combination_size=1)


def test_plan_joins_once_and_shuffles_each_side_once(spark):
    def plan_of(criteria):
        return universe(payments(spark, {}), invoices(spark, dict(total=1)), criteria)._jdf.queryExecution().executedPlan().toString()

    bounded, every = plan_of(CandidateFilterCriteria(max_candidates=30)), plan_of(CandidateFilterCriteria())
    for plan in (bounded, every):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    window = bounded[bounded.index("Window ["):]
    # ranking sits on the join without an exchange in between; without a bound nothing is ranked
    assert "Exchange" not in window[:window.index("Join")] and "Window [" not in every
