"""Payment intake: which payments may be reconciled, and with what amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.operators.rows import join_known
from remitlens.config import IntakePolicy
from remitlens.functions.money import currency_code, is_currency_code
from remitlens.functions.text import blank_to_null
from remitlens.schemas import MONEY, money


def payment_context(payments: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """Payments with gaps filled from their bank row; empty text counts as a gap.

    The join is on (company_id, bank_transaction_id); payments without a bank row are CREDIT.
    """
    if transactions is None:
        return payments.withColumn("transaction_type", F.lit("CREDIT"))
    bank = transactions.select(
        "company_id", "bank_transaction_id",
        F.col("counterparty_name").alias("_name"), F.col("reference_number").alias("_reference"),
        F.col("bank_account_number").alias("_account"), F.col("narration").alias("_narration"),
        F.col("transaction_type").alias("_type"),
    )
    fallback = {"payer_raw_name": "_name", "payment_reference": "_reference",
                "bank_account_number": "_account", "narration": "_narration"}
    joined = join_known(payments.drop("transaction_type"), bank, ["company_id", "bank_transaction_id"])
    return joined.withColumns({
        **{name: F.coalesce(blank_to_null(F.col(name)), F.col(other)) for name, other in fallback.items()},
        "transaction_type": F.coalesce(F.col("_type"), F.lit("CREDIT")),
    }).drop(*fallback.values(), "_type")


def effective_amount() -> Column:
    """What is left to allocate: the unallocated balance, or amount less allocated."""
    return F.coalesce(F.col("unallocated_amount"), F.try_subtract("amount", "allocated_amount")).try_cast(MONEY)


def evaluate_intake(payments: DataFrame, policy: IntakePolicy = IntakePolicy()) -> DataFrame:
    """Add the intake verdict to every payment. Row-local: no shuffle.

    Adds ``intake_status``, ``is_eligible``, ``intake_reason``, ``intake_description`` and
    ``effective_amount`` (zero unless eligible). The first rule that applies decides.
    """
    allocated = F.coalesce(F.col("allocated_amount"), money(0))
    unallocated = F.coalesce(F.col("unallocated_amount"), F.try_subtract(F.col("amount"), allocated)).try_cast(MONEY)
    status = F.upper(F.coalesce(blank_to_null(F.col("status")), F.lit("UNRECONCILED")))
    direction = F.upper(F.coalesce(blank_to_null(F.col("transaction_type")), F.lit("CREDIT")))
    code = currency_code(F.col("currency"))
    day = F.col("payment_date")
    text = lambda c: c.cast("string")

    if policy.as_of is not None:
        limit = F.lit(policy.as_of)
        late = F.concat(F.lit("Payment date "), text(day), F.lit(" is after "), text(limit), F.lit("."))
    else:
        today = F.lit(policy.today) if policy.today is not None else F.current_date()
        limit = F.date_add(today, policy.forward_days)
        late = F.concat(F.lit("Payment date "), text(day), F.lit(" is after the value-date limit "), text(limit), F.lit("."))

    rules = [
        (F.col("amount") <= 0, "INVALID", "NON_POSITIVE_PAYMENT_AMOUNT",
         F.concat(F.lit("Amount "), text(F.col("amount")), F.lit(" is not positive."))),
        (~is_currency_code(code), "INVALID", "INVALID_CURRENCY_CODE",
         F.concat(F.lit("Currency '"), code, F.lit("' is not a three-letter code."))),
        (direction == "DEBIT", "INELIGIBLE", "DEBIT_TRANSACTION_INELIGIBLE",
         F.lit("Debit transactions are not receivables.")),
        (allocated < 0, "INVALID", "NEGATIVE_ALLOCATED_BALANCE",
         F.concat(F.lit("Allocated balance "), text(allocated), F.lit(" is negative."))),
        (unallocated < 0, "INVALID", "NEGATIVE_UNALLOCATED_BALANCE",
         F.concat(F.lit("Unallocated balance "), text(unallocated), F.lit(" is negative."))),
        (allocated + unallocated != F.col("amount"), "INVALID", "BALANCE_CONSERVATION_BREACH",
         F.concat(text(allocated), F.lit(" + "), text(unallocated), F.lit(" is not "), text(F.col("amount")), F.lit("."))),
        (day > limit, "INVALID", "FUTURE_TRANSACTION_DATE", late),
        ((status == "RECONCILED") | (unallocated == 0), "ALREADY_PROCESSED", "FULLY_RECONCILED",
         F.lit("Nothing is left to allocate.")),
        (status == "IGNORED", "INELIGIBLE", "PAYMENT_MARKED_IGNORED", F.lit("Payment is marked ignored.")),
        (~status.isin("UNRECONCILED", "PARTIALLY_RECONCILED"), "INVALID", "INVALID_PAYMENT_STATUS",
         F.concat(F.lit("Status '"), status, F.lit("' is unknown."))),
        (status == "PARTIALLY_RECONCILED", "ELIGIBLE", "PARTIAL_BALANCE_AVAILABLE",
         F.concat(text(unallocated), F.lit(" "), code, F.lit(" is left to match."))),
    ]
    ready = ("ELIGIBLE", "READY_FOR_RECONCILIATION", F.concat(text(unallocated), F.lit(" "), code, F.lit(" is ready to match.")))

    def cascade(pick: int) -> Column:
        column = None
        for condition, *values in rules:
            value = values[pick] if isinstance(values[pick], Column) else F.lit(values[pick])
            column = F.when(condition, value) if column is None else column.when(condition, value)
        last = ready[pick] if isinstance(ready[pick], Column) else F.lit(ready[pick])
        return column.otherwise(last)

    verdict = payments.withColumns({
        "intake_status": cascade(0), "intake_reason": cascade(1), "intake_description": cascade(2),
        "_unallocated": unallocated,
    })
    return verdict.withColumns({
        "is_eligible": F.col("intake_status") == "ELIGIBLE",
        "effective_amount": F.when(F.col("intake_status") == "ELIGIBLE", F.col("_unallocated")).otherwise(money(0)),
    }).drop("_unallocated")


def unreconciled_payments(payments: DataFrame, limit: int | None = None) -> DataFrame:
    """Payments waiting for reconciliation, newest first. All of them unless ``limit`` is given."""
    waiting = payments.where(F.col("status") == "UNRECONCILED")
    if limit is None:
        return waiting
    return waiting.orderBy(*newest_first(payments)).limit(limit)


def eligible_payments(payments: DataFrame, limit: int | None = None) -> DataFrame:
    """Payments with something left to allocate, newest first."""
    open_ = payments.where(F.col("status").isin("UNRECONCILED", "PARTIALLY_RECONCILED") & (F.col("unallocated_amount") > 0))
    if limit is None:
        return open_
    return open_.orderBy(*newest_first(payments)).limit(limit)


def newest_first(payments: DataFrame) -> list[Column]:
    created = [F.col("created_at").desc()] if "created_at" in payments.columns else []
    return [F.col("payment_date").desc(), *created, F.col("payment_id").asc()]


def select_payments(payments: DataFrame, ids: DataFrame) -> DataFrame:
    """The payments named in ``ids`` (company_id, payment_id); unknown ids drop out silently."""
    return payments.join(ids.select("company_id", "payment_id").distinct(), ["company_id", "payment_id"], "left_semi")
