"""One payment, one invoice: exact and partial matching. Row-local on a filtered universe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.config import ExactMatchCriteria, PartialMatchCriteria
from remitlens.functions.arrays import first
from remitlens.functions.money import currency_code, is_currency_code
from remitlens.operators.rows import compute_once
from remitlens.schemas import MONEY, money

PAYMENT = ["company_id", "payment_id"]


def signal(kind: str, strength: str, value: Column, source: str, weight: int) -> Column:
    return F.struct(
        F.lit(kind).alias("evidence_type"), F.lit(strength).alias("signal_strength"),
        value.cast("string").alias("matched_value"), F.lit(source).alias("source_field"),
        F.lit(weight).cast("decimal(5,2)").alias("weight"))


def verdict(rules: list[tuple[Column, str, str]], last: tuple[str, str]) -> Column:
    """``struct(status, reason_code)`` of the first rule that holds."""
    pair = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason_code"))
    column = None
    for test, status, reason in rules:
        column = F.when(test, pair(status, reason)) if column is None else column.when(test, pair(status, reason))
    return column.otherwise(pair(*last))


def comparable(require_currency: bool) -> Column:
    """Candidates in the payment's currency with a positive balance."""
    ours = currency_code(F.col("payment_currency"))
    return F.filter("candidates", lambda c: (
        (F.lit(not require_currency) | (currency_code(c["currency"]) == ours)) & (c["outstanding_amount"] > 0)))


def _hypotheses(matches: Column, partial: bool, proximity: int) -> Column:
    """Match facts in order: referenced first, then nearest due date, number, id."""
    amount = F.col("effective_amount")

    def fact(c: Column) -> Column:
        gap = F.abs(c["days_to_due"])
        matched = amount if partial else c["outstanding_amount"]
        first = signal("PARTIAL_AMOUNT_COMPATIBLE", "STRONG", amount, "effective_amount", 25) if partial else signal(
            "EXACT_AMOUNT_MATCH", "STRONG", c["outstanding_amount"], "outstanding_amount", 30)
        signals = F.array_compact(F.array(
            first,
            F.when(c["is_reference_match"], signal("INVOICE_NUMBER_MATCH", "STRONG", c["invoice_number"], "raw_narration", 35)),
            signal("CUSTOMER_NAME_MATCH", "MEDIUM", c["invoice_id"], "customer_id", 20),
            F.when(gap <= proximity, signal("DATE_PROXIMITY_MATCH", "WEAK", F.concat(gap.cast("string"), F.lit(" days")), "payment_date", 10)),
        ))
        return F.struct(
            (~c["is_reference_match"]).alias("_unreferenced"), gap.alias("date_difference_days"),
            c["invoice_number"].alias("invoice_number"), c["invoice_id"].alias("invoice_id"),
            c["is_reference_match"].alias("is_reference_match"), matched.alias("matched_amount"),
            c["outstanding_amount"].alias("invoice_outstanding_before"),
            (c["outstanding_amount"] - matched).cast(MONEY).alias("invoice_outstanding_after"),
            amount.alias("payment_unallocated_before"), money(0).alias("payment_unallocated_after"),
            c["currency"].alias("currency"),
            F.lit("PARTIAL_ONE_TO_ONE" if partial else "EXACT_ONE_TO_ONE").alias("match_type"),
            signals.alias("evidence_signals"))

    return F.array_sort(F.transform(matches, fact))


def _one_to_one(universe: DataFrame, word: str, criteria, partial: bool, carry: Sequence[str]) -> DataFrame:
    amount, tolerance = F.col("effective_amount"), F.lit(criteria.amount_tolerance)
    pool = F.col("_pool")
    if partial:
        is_match = lambda c: c["outstanding_amount"] > amount
        is_exact = lambda c: c["outstanding_amount"] == amount
        other, overflow = F.size(F.filter(pool, is_exact)), F.col("overflow_larger")
    else:
        is_match = lambda c: F.abs(amount - c["outstanding_amount"]) <= tolerance
        other = F.size(F.filter(pool, lambda c: ~is_match(c) & (c["outstanding_amount"] > amount)))
        overflow = F.col("overflow_exact")
    rows = compute_once(universe, {"_pool": comparable(criteria.require_exact_currency)})
    rows = compute_once(rows, {"_facts": _hypotheses(F.filter(pool, is_match), partial, criteria.date_proximity_days)})
    matched = F.size("_facts")
    rows = rows.withColumns({
        "_found": (matched + overflow).cast("bigint"), "_other": other, "_over": F.size(pool) - matched - other,
        "_overflow": overflow,
    })
    none, many, one = f"NO_{word}_MATCH", f"AMBIGUOUS_{word}_MATCH", f"{word}_MATCH"
    found, referenced = F.col("_found"), first("_facts")["is_reference_match"]
    bad_currency = F.lit(criteria.require_exact_currency) & ~is_currency_code(currency_code(F.col("payment_currency")))
    retained = F.size("candidates")
    early = [
        (amount <= 0, none, "PAYMENT_INELIGIBLE"),
        (F.col("status_code") == "CUSTOMER_UNRESOLVED", none, "CUSTOMER_UNRESOLVED"),
        (F.col("status_code") == "NOT_ELIGIBLE", none, "PAYMENT_INELIGIBLE"),
        (F.col("status_code") == "CURRENCY_MISMATCH", none, "CURRENCY_MISMATCH"),
    ]
    stopped = early[0][0] | early[1][0] | early[2][0] | early[3][0]
    smaller_word, same_word = ("OVERPAYMENT_DETECTED", "EXACT_MATCH_DETECTED" if partial else "PARTIAL_PAYMENT_DETECTED")
    rules = early + [
        (retained == 0, none, "NO_RETAINED_CANDIDATES"),
        (bad_currency, none, "CURRENCY_MISMATCH"),
        ((found == 0) & (F.col("_other") > 0) & (F.col("_over") == 0), none, same_word),
        ((found == 0) & (F.col("_over") > 0) & (F.col("_other") == 0), none, smaller_word),
        (found == 0, none, "NO_CANDIDATE_ELIGIBLE_FOR_PARTIAL" if partial else "NO_CANDIDATE_MATCHES_AMOUNT"),
        ((found > 1) & (F.col("_overflow") > 0), many, "TRUNCATED_UNIVERSE_AMBIGUITY"),
        (found > 1, many, "MULTIPLE_PARTIAL_CANDIDATES" if partial else "MULTIPLE_EXACT_AMOUNT_MATCHES"),
        # one match, but invoices beyond the bound were not looked at and no number was named;
        # also when the one match itself lies beyond the bound
        (F.col("is_truncated") & ~F.coalesce(referenced, F.lit(False)), many, "TRUNCATED_UNIVERSE_AMBIGUITY"),
        (referenced, one, f"{word}_AMOUNT_WITH_REFERENCE_MATCH"),
    ]
    decided = compute_once(rows, {"_verdict": verdict(rules, (one, f"{word}_AMOUNT_MATCH_FOUND"))})
    status = F.col("_verdict.status")
    live = ~stopped & (retained > 0) & ~bad_currency
    facts = F.transform("_facts", lambda h: h.dropFields("_unreferenced"))
    return decided.select(
        *PAYMENT, "customer_id", status.alias("status"), F.col("_verdict.reason_code").alias("reason_code"),
        F.when(live, found).otherwise(F.lit(0).cast("bigint")).alias("total_found"),
        F.when(stopped, F.lit(False)).otherwise(F.col("is_truncated")).alias("is_universe_truncated"),
        F.when(stopped, F.lit(0)).when(retained == 0, F.col("total_evaluated")).otherwise(retained)
        .cast("bigint").alias("candidate_count_evaluated"),
        F.when(status == one, first(facts)).alias("matched"),
        F.when(status == many, facts).otherwise(F.slice(facts, 1, 0)).alias("competing"), *carry,
    )


def match_exact(universe: DataFrame, criteria: ExactMatchCriteria = ExactMatchCriteria(), carry: Sequence[str] = ()) -> DataFrame:
    """Invoices whose outstanding balance equals the payment.

    More than one is ambiguous even when one of them is referenced. ``universe`` comes from
    ``filter_candidates``, called with the same tolerance as ``exact_tolerance``; ``carry`` names columns of it to be handed on.
    """
    return _one_to_one(universe, "EXACT", criteria, False, carry)


def match_partial(universe: DataFrame, criteria: PartialMatchCriteria = PartialMatchCriteria(), carry: Sequence[str] = ()) -> DataFrame:
    """Invoices whose outstanding balance is larger than the payment."""
    return _one_to_one(universe, "PARTIAL", criteria, True, carry)
