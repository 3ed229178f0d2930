"""Evidence: what a payment, its customer and each candidate say about one another.

One row per payment: payment-level items, the invoice references found in its text, and a bundle of
items per candidate. Candidates are bounded, so bundles stay in the payment's row and the
normalisation, scoring and confidence steps that follow need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions import text as X
from remitlens.functions.arrays import bind, first
from remitlens.operators.rows import compute_once

PAYMENT = ["company_id", "payment_id"]
ACCOUNT_TYPES = ["BANK_ACCOUNT", "VIRTUAL_ACCOUNT"]
ITEM = """struct<evidence_type:string,classification:string,source_field:string,observed_result:string,
description:string,target_entity:string,matched_value:string,expected_value:string,days_difference:int>"""
NARRATION, REFERENCE, ACCOUNT = "payment.narration", "payment.payment_reference", "payment.bank_account_number"


def item(
    kind: str, classification: str, source: str, result: str, description: str, target: str,
    matched: Column | None = None, expected: Column | None = None, days: Column | None = None,
) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    details = F.lit(description) if matched is None else F.concat_ws(": ", F.lit(description), text(matched))
    return F.struct(
        F.lit(kind).alias("evidence_type"), F.lit(classification).alias("classification"),
        F.lit(source).alias("source_field"), F.lit(result).alias("observed_result"), details.alias("description"),
        F.lit(target).alias("target_entity"), text(matched).alias("matched_value"), text(expected).alias("expected_value"),
        (F.lit(None) if days is None else days).cast("int").alias("days_difference"))


def payer_account() -> Column:
    """The account a payment came from, or the payer identifier; NULL when blank."""
    return X.blank_to_null(F.trim(F.coalesce(
        X.blank_to_null(F.col("bank_account_number")), X.blank_to_null(F.col("payer_raw_identifier")))))


def account_conflicts(payments: DataFrame, customers: DataFrame) -> DataFrame:
    """(company, payment, owners): other active customers that registered the payment's account.

    Raw values are compared, as registered. A value is registered at most once per type and
    company, so owners is a short list.
    """
    owners = customers.where(~F.col("is_archived")).select(
        "company_id", F.col("customer_id").alias("owner_id"), F.col("name").alias("owner_name"),
        F.explode(F.array_distinct(F.transform(
            F.filter("identifiers", lambda i: i["identifier_type"].isin(ACCOUNT_TYPES)), lambda i: i["identifier_value"]))).alias("_account"))
    sent = payments.where("customer_id is not null").select(*PAYMENT, "customer_id", payer_account().alias("_account")).where("_account is not null")
    met = sent.join(owners, ["company_id", "_account"]).where(F.col("owner_id") != F.col("customer_id"))
    return met.groupBy(*PAYMENT).agg(F.array_sort(F.collect_set(F.struct("owner_name", "owner_id"))).alias("owners"))


def _payment_texts() -> dict[str, Column]:
    """What several payment-level items and their tests say, found once."""
    def said(alias: Column) -> Column:
        return bind(X.clean_text(alias), lambda a: (a != "") & (F.contains("_clean_narration", a) | F.contains("_clean_payer", a)))

    shared = F.array_sort(F.array_intersect(
        F.split("_clean_customer", " "), F.array_union(F.split("_clean_narration", " "), F.split("_clean_payer", " "))))
    return {
        "_alias_hit": first(F.filter("_aliases", said)), "_shared": F.filter(shared, lambda w: w != ""),
        "_utr": X.evidence_utr(F.coalesce("narration", F.lit(""))),
    }


def _payment_items() -> Column:
    """Payment-level items, in the order they are found."""
    name = F.col("_customer_name")
    has_text, known = X.present(F.col("narration")), F.col("customer_id").isNotNull()
    account = F.col("_account")
    accounts = F.transform(F.filter("_identifiers", lambda i: i["identifier_type"].isin(ACCOUNT_TYPES)), lambda i: i["identifier_value"])
    own = F.exists(accounts, lambda a: (a == account) | F.endswith(account, a) | F.endswith(a, account))
    alias_hit, shared, utr = F.col("_alias_hit"), F.col("_shared"), F.col("_utr")
    # the payer name is looked at for the full name only when there is no narration
    where = F.when(F.col("_clean_narration") != "", F.col("_clean_narration")).otherwise(F.col("_clean_payer"))
    listed = [
        F.when(X.present(F.col("payment_reference")), item(
            "PAYMENT_REFERENCE", "SUPPORTING", REFERENCE, "PRESENT", "Payment reference", "PAYMENT", F.trim("payment_reference")))
        .otherwise(item("PAYMENT_REFERENCE", "MISSING", REFERENCE, "ABSENT", "No payment reference", "PAYMENT")),
        F.when(~has_text, item("INVOICE_NUMBER_IN_NARRATION", "MISSING", NARRATION, "ABSENT", "No narration", "PAYMENT"))
        .when(F.size("_tokens") > 0, item(
            "INVOICE_NUMBER_IN_NARRATION", "DIRECT", NARRATION, "MATCHED", "Invoice tokens in narration", "PAYMENT", F.array_join("_tokens", ", "))),
        F.when(has_text & utr.isNotNull(), item("UTR_IDENTIFIER", "SUPPORTING", NARRATION, "EXTRACTED", "Transfer reference", "PAYMENT", utr))
        .when(has_text, item("UTR_IDENTIFIER", "MISSING", NARRATION, "ABSENT", "No transfer reference in narration", "PAYMENT"))
        .otherwise(item("UTR_IDENTIFIER", "MISSING", NARRATION, "ABSENT", "No narration to hold a transfer reference", "PAYMENT")),
        F.when(account.isNull(), item("BANK_ACCOUNT_IDENTIFIER", "MISSING", ACCOUNT, "ABSENT", "No payer account", "CUSTOMER"))
        .when(known & own, item("BANK_ACCOUNT_IDENTIFIER", "DIRECT", ACCOUNT, "MATCHED", "Account registered for the customer", "CUSTOMER", account))
        .when(known, item("BANK_ACCOUNT_IDENTIFIER", "MISSING", ACCOUNT, "UNREGISTERED", "Account not registered for the customer", "CUSTOMER", account)),
    ]
    after = [
        F.when(known & (F.size(shared) > 0) & F.contains(where, F.col("_clean_customer")), item(
            "CUSTOMER_NAME_TOKEN", "SUPPORTING", NARRATION, "MATCHED", "Customer name in payment text", "CUSTOMER", name))
        .when(known & (F.size(shared) > 0), item(
            "CUSTOMER_NAME_TOKEN", "SUPPORTING", NARRATION, "TOKEN_OVERLAP", "Words of the customer name in payment text", "CUSTOMER", F.array_join(shared, ", ")))
        .when(known, item("CUSTOMER_NAME_TOKEN", "MISSING", NARRATION, "ABSENT", "No word of the customer name in payment text", "CUSTOMER")),
        F.when(known & alias_hit.isNotNull(), item("CUSTOMER_ALIAS", "SUPPORTING", NARRATION, "MATCHED", "Alias in payment text", "CUSTOMER", alias_hit))
        .when(known & (F.size("_aliases") > 0), item("CUSTOMER_ALIAS", "MISSING", NARRATION, "ABSENT", "No alias in payment text", "CUSTOMER")),
    ]
    conflicts = F.transform("owners", lambda o: item(
        "BANK_ACCOUNT_IDENTIFIER", "CONFLICTING", ACCOUNT, "CONFLICT", "Account registered for another customer", "CUSTOMER",
        o["owner_id"], F.col("customer_id")))
    # the first four, the conflicts, the last two
    return F.concat(F.array_compact(F.array(*listed)), conflicts, F.array_compact(F.array(*after)))


def _candidate_items(c: Column) -> Column:
    """Items of one candidate: number, currency, amount, causality, closeness to the due date."""
    number, amount, balance = F.upper(F.trim(c["invoice_number"])), F.col("effective_amount"), c["outstanding_amount"]
    day, gap = F.col("payment_date"), c["days_to_due"]
    refs = F.col("extracted_invoice_references")
    N, C, A, T, P = ("INVOICE_NUMBER_IN_NARRATION", "CURRENCY_CONSISTENCY", "candidate.outstanding_amount", "DATE_CAUSALITY", "DATE_PROXIMITY")
    return F.array(
        F.when(F.array_contains(refs, number), item(N, "DIRECT", NARRATION, "MATCHED", "Number is referenced", "INVOICE", c["invoice_number"]))
        .when(F.size(refs) > 0, item(N, "CONFLICTING", NARRATION, "CONFLICT", "Other numbers are referenced", "INVOICE", F.array_join(refs, ", "), c["invoice_number"]))
        .otherwise(item(N, "MISSING", NARRATION, "ABSENT", "No number is referenced", "INVOICE")),
        F.when(F.upper("payment_currency") == F.upper(c["currency"]), item(
            C, "SUPPORTING", "candidate.currency", "CONSISTENT", "Same currency", "INVOICE", F.col("payment_currency")))
        .otherwise(item(C, "CONFLICTING", "candidate.currency", "CONFLICT", "Different currency", "INVOICE", F.col("payment_currency"), c["currency"])),
        F.when(amount == balance, item("AMOUNT_EXACT_EQUALITY", "DIRECT", A, "EXACT_MATCH", "Amount equals the balance", "INVOICE", amount, balance))
        .when(amount < balance, item("AMOUNT_PARTIAL_COMPATIBLE", "SUPPORTING", A, "PARTIAL_AMOUNT", "Amount is below the balance", "INVOICE", amount, balance))
        .otherwise(item("AMOUNT_OVERPAYMENT", "SUPPORTING", A, "OVERPAYMENT_AMOUNT", "Amount is above the balance", "INVOICE", amount, balance)),
        F.when(day >= c["issue_date"], item(T, "SUPPORTING", "payment.payment_date", "CAUSAL", "Paid on or after issue", "INVOICE", day))
        .otherwise(item(T, "CONFLICTING", "payment.payment_date", "NON_CAUSAL", "Paid before issue", "INVOICE", day, c["issue_date"])),
        F.when(F.abs(gap) <= 30, item(P, "SUPPORTING", "candidate.due_date", "PROXIMATE", "Days from the due date", "INVOICE", F.abs(gap), None, gap))
        .otherwise(item(P, "MISSING", "candidate.due_date", "DISTANT", "Days from the due date", "INVOICE", F.abs(gap), None, gap)),
    )


def collect_evidence(payments: DataFrame, universe: DataFrame, customers: DataFrame) -> DataFrame:
    """Evidence of every payment.

    ``payments`` are identified payments (text columns and ``customer_id``), ``universe`` comes
    from ``filter_candidates``, ``customers`` is a ``customer_context``. Adds ``payment_items``,
    ``extracted_invoice_references``, ``has_conflicting_identifiers`` and ``bundles`` in order of
    (number, id).
    """
    context = customers.select("company_id", "customer_id", F.col("name").alias("_customer_name"),
                               F.col("aliases").alias("_aliases"), F.col("identifiers").alias("_identifiers"))
    text = payments.select(*PAYMENT, "customer_id", "payment_reference", "narration", "bank_account_number", "payer_raw_identifier", "payer_raw_name")
    # payments without a customer stay out of the join: their NULL keys would all meet in one task
    unknown = text.where("customer_id is null").select("*", *[
        F.lit(None).cast(context.schema[c].dataType).alias(c) for c in ("_customer_name", "_aliases", "_identifiers")])
    joined = text.where("customer_id is not null").join(context, ["company_id", "customer_id"], "left").select(*unknown.columns).unionByName(unknown)
    reference = F.trim("payment_reference")
    prepared = joined.join(account_conflicts(payments, customers), PAYMENT, "left")
    prepared = compute_once(prepared, {
        "owners": F.coalesce("owners", F.array().cast(f"array<struct<owner_name:string,owner_id:{customers.schema['customer_id'].dataType.simpleString()}>>")),
        "_aliases": F.coalesce("_aliases", F.array().cast("array<string>")),
        "_identifiers": F.coalesce("_identifiers", F.array().cast(customers.schema["identifiers"].dataType)),
        "_account": payer_account(),
        "_tokens": F.when(X.present(F.col("narration")), X.evidence_invoice_tokens(F.col("narration"))).otherwise(F.array().cast("array<string>")),
        "_clean_customer": X.clean_text(F.col("_customer_name")), "_clean_narration": X.clean_text(F.col("narration")),
        "_clean_payer": X.clean_text(F.col("payer_raw_name")),
        # a reference keeps its case here while tokens of the narration are upper-cased
        "_reference": F.when(X.present(F.col("payment_reference")) & reference.rlike("(?i)^(?:INV|BILL|REC)[-_A-Z0-9]{3,30}\\b"), F.array(reference))
        .otherwise(F.array().cast("array<string>")),
    })
    found = compute_once(compute_once(prepared, _payment_texts()), {"payment_items": _payment_items()}).select(
        *PAYMENT, "payment_items",
        F.array_union("_reference", F.transform("_tokens", lambda t: F.upper(t))).alias("extracted_invoice_references"),
        (F.size("owners") > 0).alias("has_conflicting_identifiers"))
    rows = universe.join(found, PAYMENT)
    by_number = F.sort_array(F.transform("candidates", lambda c: F.struct(
        c["invoice_number"].alias("invoice_number"), c["invoice_id"].alias("invoice_id"), _candidate_items(c).alias("items"))))
    return compute_once(rows, {"bundles": by_number}).select(
        *PAYMENT, "customer_id", "payment_items", "extracted_invoice_references", "has_conflicting_identifiers", "bundles")


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """All items as rows; ``invoice_id`` is NULL for payment-level items."""
    id_type = evidence.schema["bundles"].dataType.elementType["invoice_id"].dataType
    paid = evidence.select(*PAYMENT, F.lit(None).cast(id_type).alias("invoice_id"), F.inline("payment_items"))
    bundled = evidence.select(*PAYMENT, F.inline("bundles")).select(*PAYMENT, "invoice_id", F.inline("items"))
    return paid.unionByName(bundled)


def count_class(items: Column, classification: str) -> Column:
    return F.size(F.filter(items, lambda i: i["classification"] == classification))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Items per class over payment and bundles."""
    every = F.concat("payment_items", F.flatten(F.transform("bundles", lambda b: b["items"])))
    return evidence.select(
        *PAYMENT, F.size(every).alias("total_items"),
        *[count_class(every, c).alias(f"total_{c.lower()}") for c in ("DIRECT", "SUPPORTING", "MISSING", "CONFLICTING")])
