"""One payment, several invoices: multi-invoice and combination matching.

The sets come from ``set_search``; what follows from them is row-local. ``universe`` is read twice, so hand over a written one.
``carry`` names columns of it to be handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.config import CombinationMatchCriteria, MultiInvoiceMatchCriteria
from remitlens.functions.arrays import first
from remitlens.functions.money import currency_code, is_currency_code
from remitlens.operators.matching import PAYMENT, comparable, signal, verdict
from remitlens.operators.rows import compute_once
from remitlens.operators.set_search import list_sets, search_sets


def _sum_balance(members: Column) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return F.aggregate(members, zero, lambda s, c: (s + c["outstanding_amount"]).cast("decimal(18,2)"))


def _each(members: Column, field: str) -> Column:
    return F.transform(members, lambda c: c[field])


def _members_of(subset: Column) -> Column:
    return F.transform(subset, lambda i: F.element_at("_members", i + 1))


def _each_set(subsets: Column, mark: Callable[[Column], Column], fact: Callable[[Column, Column], Column]) -> Column:
    """``fact`` of the members and the named members of each set, both looked up once a set."""
    marked = F.transform(F.transform(subsets, _members_of), lambda members: F.struct(members.alias("all"), F.filter(members, mark).alias("named")))
    return F.transform(marked, lambda s: fact(s["all"], s["named"]))


def _searched(rows: DataFrame, pool: Callable[[], Column], order: Callable[[Column], list[Column]], mark: Callable[[Column], Column],
              possible: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_members`` (the pool in order), and what the set search wants of those where a set is possible."""
    keyed = F.array_sort(F.transform(pool(), lambda c: F.struct(F.struct(*order(c)).alias("k"), c.alias("c"))))
    rows = compute_once(rows, {"_members": F.transform(keyed, lambda e: e["c"]), "_possible": possible})
    members = F.transform("_members", lambda c, i: F.struct(
        i.alias("at"), (c["outstanding_amount"] * 100).cast("bigint").alias("cents"), mark(c).alias("mark"), c["due_date"].alias("due"), (-c["days_to_due"]).cast("bigint").alias("days")))
    asked = rows.where(F.col("_possible") & (F.size("_members") >= 2)).select(
        *PAYMENT, (F.col("effective_amount") * 100).cast("bigint").alias("target"), members.alias("members"))
    return rows.drop("_possible"), asked


def _with_sets(rows: DataFrame, asked: DataFrame, criteria: MultiInvoiceMatchCriteria | CombinationMatchCriteria) -> DataFrame:
    """Adds ``_found``, ``_listed`` (whether ``_subsets`` is the whole list), ``_most``, ``_n_most``, ``_most_set``, ``_aged_set`` and ``_n_aged``."""
    sets = search_sets(asked, criteria.max_combination_size, criteria.max_listed)
    named = sets.select(*PAYMENT, *[F.col(c).alias(f"_{c}") for c in ("found", "most", "n_most", "most_set", "subsets", "aged_set", "n_aged")])
    joined = rows.join(named, PAYMENT, "left").withColumn("_found", F.coalesce("_found", F.lit(0).cast("bigint")))
    return joined.withColumns({
        "_listed": (F.col("_found") == 0) | F.col("_subsets").isNotNull(), "_subsets": F.coalesce("_subsets", F.array().cast("array<array<int>>"))})


def _reversed_flag(flag: Column) -> Column:
    return (~flag).alias("unreferenced")


def _balances(members: Column, amount: Column) -> list[Column]:
    """What is open before and after: a set settles its invoices and the payment in full."""
    before = _each(members, "outstanding_amount")
    return [
        before.alias("invoices_outstanding_before"), F.transform(before, lambda b: b - b).alias("invoices_outstanding_after"),
        amount.alias("payment_unallocated_before"), (amount - amount).alias("payment_unallocated_after")]


def _DUE_ORDER(c: Column) -> list[Column]:
    return [c["due_date"], c["invoice_number"], c["invoice_id"]]


def match_multi_invoice(
    universe: DataFrame, criteria: MultiInvoiceMatchCriteria = MultiInvoiceMatchCriteria(), carry: Sequence[str] = (),
) -> DataFrame:
    """Sets of smaller invoices that add up to the payment; one is a match, several are ambiguous.

    ``total_found`` counts all sets; ``competing`` lists them where ``is_listing_complete``.
    """
    amount = F.col("effective_amount")
    pool = lambda: F.filter(comparable(criteria.require_exact_currency), lambda c: c["outstanding_amount"] < amount)
    stopped = (amount <= 0) | F.col("status_code").isin("CUSTOMER_UNRESOLVED", "NOT_ELIGIBLE", "CURRENCY_MISMATCH")
    bad_currency = F.lit(criteria.require_exact_currency) & ~is_currency_code(currency_code(F.col("payment_currency")))
    retained = F.size("candidates")
    possible = ~stopped & ~bad_currency & (_sum_balance(pool()) >= amount)
    rows = _with_sets(*_searched(universe, pool, _DUE_ORDER, lambda c: c["is_reference_match"], possible), criteria)

    def fact(members: Column, named: Column) -> Column:
        gap = F.array_max(F.transform(members, lambda c: F.abs(c["days_to_due"])))
        numbers = _each(members, "invoice_number")
        signals = F.array_compact(F.array(
            signal("MULTI_INVOICE_SUM_EXACT", "STRONG", amount, "effective_amount", 30),
            F.when(F.size(named) > 0, signal("INVOICE_NUMBER_MATCH", "STRONG", F.array_join(_each(named, "invoice_number"), ", "), "raw_narration", 35)),
            signal("CUSTOMER_NAME_MATCH", "MEDIUM", F.array_join(F.transform(members, lambda c: c["invoice_id"].cast("string")), ", "), "customer_id", 20),
            F.when(gap <= criteria.date_proximity_days, signal("DATE_PROXIMITY_MATCH", "WEAK", F.concat(gap.cast("string"), F.lit(" days")), "payment_date", 10)),
        ))
        return F.struct(
            _reversed_flag(F.size(named) > 0), (-F.size(named)).alias("_references"), F.size(members).alias("combination_size"),
            gap.alias("max_date_difference_days"), numbers.alias("invoice_numbers"), _each(members, "invoice_id").alias("invoice_ids"),
            *_balances(members, amount),
            F.size(named).alias("matched_reference_count"), (F.size(named) > 0).alias("has_reference_match"),
            amount.alias("matched_amount"), F.col("payment_currency").alias("currency"),
            F.lit("MULTI_INVOICE_EXACT").alias("match_type"), signals.alias("evidence_signals"))

    smaller = F.size("_members")
    rows = compute_once(rows, {"_facts": F.sort_array(_each_set(F.col("_subsets"), lambda c: c["is_reference_match"], fact))})
    # a set found alone is always listed
    found, best = F.col("_found"), first("_facts")
    exact = F.exists(comparable(criteria.require_exact_currency), lambda c: c["outstanding_amount"] == amount)
    larger = F.exists(comparable(criteria.require_exact_currency), lambda c: c["outstanding_amount"] > amount)
    none, many, one = "NO_MULTI_INVOICE_MATCH", "AMBIGUOUS_MULTI_INVOICE_MATCH", "MULTI_INVOICE_MATCH"
    rules = [
        (amount <= 0, none, "PAYMENT_INELIGIBLE"),
        (F.col("status_code") == "CUSTOMER_UNRESOLVED", none, "CUSTOMER_UNRESOLVED"),
        (F.col("status_code") == "NOT_ELIGIBLE", none, "PAYMENT_INELIGIBLE"),
        (F.col("status_code") == "CURRENCY_MISMATCH", none, "CURRENCY_MISMATCH"),
        (retained == 0, none, "NO_RETAINED_CANDIDATES"),
        (bad_currency, none, "CURRENCY_MISMATCH"),
        ((smaller < 2) & exact, none, "EXACT_MATCH_DETECTED"),
        ((smaller == 0) & larger, none, "PARTIAL_MATCH_DETECTED"),
        (smaller < 2, none, "INSUFFICIENT_CANDIDATES"),
        ((found == 0) & (_sum_balance(F.col("_members")) < amount), none, "UNDERPAYMENT_DETECTED"),
        (found == 0, none, "NO_MULTI_INVOICE_COMBINATION_FOUND"),
        ((found > 1) & F.col("is_truncated"), many, "TRUNCATED_UNIVERSE_AMBIGUITY"),
        (found > 1, many, "MULTIPLE_MULTI_INVOICE_MATCHES"),
        (F.col("is_truncated") & (best["matched_reference_count"] < best["combination_size"]), many, "TRUNCATED_UNIVERSE_AMBIGUITY"),
        (best["has_reference_match"], one, "MULTI_INVOICE_WITH_REFERENCE_MATCH"),
    ]
    decided = compute_once(rows, {"_verdict": verdict(rules, (one, "MULTI_INVOICE_MATCH_FOUND"))})
    status = F.col("_verdict.status")
    facts = F.transform("_facts", lambda h: h.dropFields("unreferenced", "_references"))
    return decided.select(
        *PAYMENT, "customer_id", status.alias("status"), F.col("_verdict.reason_code").alias("reason_code"),
        found.cast("bigint").alias("total_found"),
        F.when(stopped, F.lit(False)).otherwise(F.col("is_truncated")).alias("is_universe_truncated"),
        F.when(stopped, F.lit(0)).when(retained == 0, F.col("total_evaluated")).otherwise(retained).cast("bigint").alias("candidate_count_evaluated"),
        F.when(status == one, first(facts)).alias("matched"),
        F.when(status == many, facts).otherwise(F.slice(facts, 1, 0)).alias("competing"), F.col("_listed").alias("is_listing_complete"), *carry,
    )


def _same_currency(c: Column) -> Column:
    return c["currency"] == F.col("payment_currency")


def _named_by_payment(c: Column) -> Column:
    return c["is_reference_match"] | c["number_in_narration"]


def _combination_gates(criteria: CombinationMatchCriteria) -> tuple[Column, Column, Column, Column]:
    """What ends the search for combinations before it begins: no amount, no customer, foreign candidates, one invoice of the very amount."""
    amount = F.col("effective_amount")
    return (
        amount <= 0, (F.col("status_code") == "CUSTOMER_UNRESOLVED") | F.col("customer_id").isNull(),
        F.lit(criteria.require_exact_currency) & F.exists("candidates", lambda c: ~_same_currency(c)),
        F.exists("candidates", lambda c: _same_currency(c) & (c["outstanding_amount"] == amount)))


def _combination_searched(universe: DataFrame, criteria: CombinationMatchCriteria) -> tuple[DataFrame, DataFrame]:
    amount = F.col("effective_amount")
    pool = lambda: F.filter("candidates", lambda c: _same_currency(c) & (c["outstanding_amount"] > 0) & (c["outstanding_amount"] < amount))
    no_amount, no_customer, foreign, exact = _combination_gates(criteria)
    gated = no_amount | no_customer | (F.size("candidates") == 0) | foreign | exact
    return _searched(universe, pool, lambda c: [c["invoice_number"], c["invoice_id"]], _named_by_payment, ~gated & (_sum_balance(pool()) >= amount))


def _combination_fact(criteria: CombinationMatchCriteria) -> Callable[[Column, Column], Column]:
    amount, currency = F.col("effective_amount"), F.col("payment_currency")

    def fact(members: Column, named: Column) -> Column:
        gaps = F.transform(members, lambda c: F.abs(c["days_to_due"]))
        # days from payment to due date, negative when overdue
        mean = F.aggregate(members, F.lit(0), lambda s, c: s - c["days_to_due"]) / F.size(members)
        due = _each(members, "due_date")
        signals = F.flatten(F.array(
            F.array(signal("COMBINATION_SUM_EXACT", "STRONG", amount, "outstanding_amount", 30)),
            F.transform(named, lambda c: signal("INVOICE_NUMBER_MATCH", "STRONG", c["invoice_number"], "narration", 35)),
            F.array_compact(F.array(F.when(F.coalesce(F.col("payer_raw_name") != "", F.lit(False)), signal(
                "CUSTOMER_NAME_MATCH", "STRONG", F.col("payer_raw_name"), "customer_name", 20)))),
            F.transform(F.filter(members, lambda c: F.abs(c["days_to_due"]) <= criteria.date_proximity_days),
                        lambda c: signal("DATE_PROXIMITY_MATCH", "MEDIUM", c["due_date"], "due_date", 10)),
        ))
        return F.struct(
            _reversed_flag(F.size(named) > 0), (-F.size(named)).alias("_references"), F.array_min(due).alias("oldest_due_date"),
            mean.alias("average_days_to_due"), F.size(members).alias("combination_size"),
            F.array_max(gaps).alias("max_date_difference_days"), _each(members, "invoice_number").alias("invoice_numbers"),
            _each(members, "invoice_id").alias("invoice_ids"), F.array_max(due).alias("newest_due_date"),
            *_balances(members, amount),
            F.size(named).alias("matched_reference_count"), (F.size(named) > 0).alias("has_reference_match"),
            amount.alias("matched_amount"), currency.alias("currency"), signals.alias("evidence_signals"))

    return fact


def match_combination(
    universe: DataFrame, criteria: CombinationMatchCriteria = CombinationMatchCriteria(), carry: Sequence[str] = (),
) -> DataFrame:
    """Sets that add up to the payment, with two ways to prefer one of several.

    The set that alone names the most invoices wins; else, when nothing was cut off by the bound,
    the one that settles the oldest debt. A preferred set always needs review.

    ``total_found`` counts all sets; ``competing`` lists them where ``is_listing_complete``. A preferred set is given either way.
    """
    amount, retained, same = F.col("effective_amount"), F.size("candidates"), _same_currency
    no_amount, no_customer, foreign, exact = _combination_gates(criteria)
    fact = _combination_fact(criteria)
    rows = _with_sets(*_combination_searched(universe, criteria), criteria)
    rows = compute_once(rows, {"_facts": F.sort_array(_each_set(F.col("_subsets"), _named_by_payment, fact))})
    aged = F.sort_array(F.transform("_facts", lambda h: F.struct(
        h["oldest_due_date"].alias("a"), h["average_days_to_due"].alias("b"), h["combination_size"].alias("c"),
        h["invoice_numbers"].alias("d"), h["invoice_ids"].alias("e"))))
    alone = (F.col("_most") > 0) & (F.col("_n_most") == 1)
    # where the sets aren't listed, the one that may be preferred: named most, or settling the oldest debt
    rows = compute_once(rows, {
        "_oldest": F.when(F.size("_facts") > 1, aged), "_one": F.when(~F.col("_listed"), first(_each_set(
            F.array(F.when(alone, F.col("_most_set")).otherwise(F.col("_aged_set"))), _named_by_payment, fact)))})
    found, smaller = F.col("_found"), F.size("_members")
    # _facts is sorted by references, so the set with the most of them comes first
    best = F.when(F.col("_listed"), first("_facts")).otherwise(F.col("_one"))
    fully_named = best["matched_reference_count"] == best["combination_size"]
    old1, old2 = first("_oldest"), F.try_element_at("_oldest", F.lit(2))
    ahead = F.when(F.col("_listed"), (old1["a"] < old2["a"]) | ((old1["a"] == old2["a"]) & (old1["b"] < old2["b"]))).otherwise(F.col("_n_aged") == 1)
    older = F.lit(criteria.enable_fifo_aging) & ahead
    cut = F.col("is_truncated")
    none, many, unique, preferred = (
        "NO_COMBINATION_MATCH", "AMBIGUOUS_COMBINATION_MATCH", "UNIQUE_COMBINATION_MATCH", "PRIORITIZED_COMBINATION_MATCH")
    all_larger = F.size(F.filter("candidates", lambda c: same(c) & (c["outstanding_amount"] > amount))) == retained
    rules = [
        (no_amount, none, "PAYMENT_INELIGIBLE"),
        (no_customer, none, "CUSTOMER_UNRESOLVED"),
        (retained == 0, none, "NO_RETAINED_CANDIDATES"),
        (foreign, none, "CURRENCY_MISMATCH"),
        (exact, none, "EXACT_MATCH_DETECTED"),
        ((smaller < 2) & all_larger, none, "PARTIAL_MATCH_DETECTED"),
        (smaller < 2, none, "INSUFFICIENT_CANDIDATES"),
        ((found == 0) & (_sum_balance(F.col("_members")) < amount), none, "UNDERPAYMENT_DETECTED"),
        (found == 0, none, "NO_COMBINATION_FOUND"),
        ((found == 1) & cut & ~fully_named, many, "TRUNCATED_UNIVERSE_AMBIGUITY"),
        (found == 1, unique, "UNIQUE_COMBINATION_FOUND"),
        (alone & cut & ~fully_named, many, "TRUNCATED_UNIVERSE_AMBIGUITY"),
        (alone, preferred, "REFERENCE_PRIORITIZED"),
        (cut, many, "TRUNCATED_UNIVERSE_AMBIGUITY"),
        (older, preferred, "FIFO_AGING_PRIORITIZED"),
    ]
    decided = compute_once(rows, {"_verdict": verdict(rules, (many, "MULTIPLE_COMBINATIONS_UNRESOLVED"))})
    status, reason = F.col("_verdict.status"), F.col("_verdict.reason_code")
    facts = F.transform("_facts", lambda h: h.dropFields("unreferenced", "_references"))
    one = F.col("_one").dropFields("unreferenced", "_references")
    by_age = F.when(F.col("_listed"), first(F.filter(facts, lambda h: h["invoice_ids"] == first("_oldest")["e"]))).otherwise(one)
    fifo = reason == "FIFO_AGING_PRIORITIZED"
    aged_signal = F.array(signal("FIFO_OLDEST_INVOICE_PRIORITY", "MEDIUM", by_age["oldest_due_date"], "due_date", 15))
    chosen = F.when(fifo, by_age.withField("evidence_signals", F.concat(by_age["evidence_signals"], aged_signal))).when(
        status.isin(unique, preferred), F.when(F.col("_listed"), first(facts)).otherwise(one))
    # the preferred set leads the list of all sets
    competing = F.when(fifo & F.col("_listed"), F.concat(F.array(chosen), F.filter(facts, lambda h: h["invoice_ids"] != first("_oldest")["e"]))).otherwise(facts)
    return decided.select(
        *PAYMENT, "customer_id", status.alias("status"), reason.alias("reason_code"),
        F.when(reason == "REFERENCE_PRIORITIZED", "REFERENCE_MATCH_PRIORITY").when(fifo, "RULE_M3_FIFO_AGING").alias("applied_heuristic"),
        status.isin(many, preferred).alias("requires_review"),
        found.cast("bigint").alias("total_found"), cut.alias("is_universe_truncated"),
        retained.cast("bigint").alias("candidate_count_evaluated"),
        chosen.alias("matched"), competing.alias("competing"), fifo.alias("is_fifo_prioritized"), F.col("_listed").alias("is_listing_complete"), *carry,
    )


def combination_sets(universe: DataFrame, criteria: CombinationMatchCriteria = CombinationMatchCriteria()) -> DataFrame:
    """Every set that ``match_combination`` counts, as a row with what is known of it, however many a payment has: no payment's sets are gathered.
    ``max_listed`` has no part in it."""
    rows, asked = _combination_searched(universe, criteria)
    sets = list_sets(asked, criteria.max_combination_size)
    found = sets.join(rows.select(*PAYMENT, "effective_amount", "payment_currency", "payer_raw_name", "_members"), PAYMENT)
    each = F.element_at(_each_set(F.array("set"), _named_by_payment, _combination_fact(criteria)), 1)
    return found.select(*PAYMENT, F.inline(F.array(each.dropFields("unreferenced", "_references"))))


def combination_rows(matches: DataFrame) -> DataFrame:
    """All sets of a multi-invoice or combination result as rows: the match, or else the competing ones."""
    shown = F.when(F.size("competing") > 0, F.col("competing")).when(
        F.col("matched").isNotNull(), F.array("matched")).otherwise(F.col("competing"))
    listed = F.transform(shown, lambda h, i: F.struct(
        (i + 1).alias("position"), h["combination_size"].alias("combination_size"), h["invoice_ids"].alias("invoice_ids"),
        h["invoice_numbers"].alias("invoice_numbers"), h["matched_amount"].alias("matched_amount"),
        h["matched_reference_count"].alias("matched_reference_count")))
    return matches.select(*PAYMENT, "status", F.inline(listed))


def multi_invoice_sets(universe: DataFrame, criteria: MultiInvoiceMatchCriteria = MultiInvoiceMatchCriteria()) -> DataFrame:
    """Every set of smaller invoices that adds up to its payment as a row: ``invoice_ids`` in order of due date, however many there are."""
    amount = F.col("effective_amount")
    pool = lambda: F.filter(comparable(criteria.require_exact_currency), lambda c: c["outstanding_amount"] < amount)
    stopped = (amount <= 0) | F.col("status_code").isin("CUSTOMER_UNRESOLVED", "NOT_ELIGIBLE", "CURRENCY_MISMATCH")
    rows, asked = _searched(universe, pool, _DUE_ORDER, lambda c: c["is_reference_match"], ~stopped & (_sum_balance(pool()) >= amount))
    sets = list_sets(asked, criteria.max_combination_size)
    ids = rows.select(*PAYMENT, _each(F.col("_members"), "invoice_id").alias("_ids"))
    return sets.join(ids, PAYMENT).select(*PAYMENT, F.size("set").alias("combination_size"), F.transform("set", lambda i: F.element_at("_ids", i + 1)).alias("invoice_ids"))
