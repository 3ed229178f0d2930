"""State changes as batch jobs: allocations, receipts, status changes, bulk loads.

Each returns what was accepted and what was refused, with the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitlens import vocab
from remitlens.functions.text import blank_to_null, squeeze
from remitlens.schemas import MONEY, money
from remitlens.session import cut_lineage


#: owners with more changes than this are streamed through in order instead of being folded as one row
LONG_OWNER = 10_000


def _in_order(rows: DataFrame, owner: list[str], verdict, step) -> DataFrame:
    """Add ``verdict`` and the balances ``_a``, ``_b`` after it to each change of each owner, in ``seq`` order.

    A change is accepted or refused by what the changes before it left. Owners whose every change fits when all of them are
    accepted need no more than running sums. The changes of another owner are folded as an array; an owner with more than
    LONG_OWNER of them is streamed through sorted partitions with its two running balances as the only state.
    """
    order = W.partitionBy(*owner).orderBy("seq")
    signed = F.when(F.col("_early") != "", 0).when(F.col("_kind") == "REVERT", -F.col("_change")).otherwise(F.col("_change"))
    summed = rows.withColumn("_signed", signed).withColumn("_sum", F.sum("_signed").over(order.rowsBetween(W.unboundedPreceding, 0)))
    before = F.col("_sum") - F.col("_signed")
    fits = (F.col("_early") != "") | (verdict(F.col("_a") + before, F.col("_b") - before, F.col("_change"), F.col("_kind")) == "")
    whole = W.partitionBy(*owner)
    # written, as three ways lead on from here
    judged = cut_lineage(summed.withColumn("_fits", F.min(fits.cast("int")).over(whole)).withColumn("_changes", F.count("*").over(whole)))
    plain = judged.where("_fits = 1").withColumns({
        "verdict": F.when(F.col("_early") != "", F.col("_early")).otherwise("ACCEPTED"), "_a": F.col("_a") + F.col("_sum"), "_b": F.col("_b") - F.col("_sum")})
    columns = [c for c in rows.columns if c not in ("_change", "_early")]
    mixed = judged.where("_fits = 0")
    short = mixed.where(F.col("_changes") <= LONG_OWNER).groupBy(*owner).agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rows.columns if c not in (*owner, "seq")]))).alias("_list"))

    def move(state: F.Column, change: F.Column) -> F.Column:
        said = F.when(change["_early"] != "", change["_early"]).otherwise(verdict(state["a"], state["b"], change["_change"], change["_kind"]))
        moved = F.when(said != "", 0).when(change["_kind"] == "REVERT", -change["_change"]).otherwise(change["_change"])
        after = F.struct((state["a"] + moved).alias("a"), (state["b"] - moved).alias("b"), F.when(said == "", "ACCEPTED").otherwise(said).alias("verdict"))
        return F.struct(after["a"].alias("a"), after["b"].alias("b"), F.concat(state["done"], F.array(after)).alias("done"))

    start = F.struct(F.get("_list", F.lit(0))["_a"].alias("a"), F.get("_list", F.lit(0))["_b"].alias("b"), F.array().cast("array<struct<a:bigint,b:bigint,verdict:string>>").alias("done"))
    folded = short.select(*owner, F.explode(F.arrays_zip("_list", F.aggregate("_list", start, move, lambda s: s["done"]).alias("done"))).alias("_x")).select(
        *owner, *[F.col(f"_x._list.{c}").alias(c) for c in columns if c not in (*owner, "_a", "_b")], F.col("_x.done.verdict").alias("verdict"), F.col("_x.done.a").alias("_a"), F.col("_x.done.b").alias("_b"))
    long_ = mixed.where(F.col("_changes") > LONG_OWNER).select(*rows.columns)
    names = [*columns, "verdict"]
    types = dict(rows.dtypes) | {"verdict": "string"}
    streamed = _fold(long_.repartition(*owner).sortWithinPartitions(*owner, "seq"), owner, ", ".join(f"{c} {types[c]}" for c in names), step)
    return plain.select(*names).unionByName(folded.select(*names)).unionByName(streamed)


def _fold(sorted_rows: DataFrame, owner: list[str], schema: str, step) -> DataFrame:
    """Run ``step`` over the rows of each owner in order, carrying its balance.

    A change is accepted or refused by what the changes before it left, so one owner's changes are
    a sequence. Rows are hash-partitioned by owner, sorted, and streamed through in Arrow batches:
    only the running balances of one owner are held, however many changes it has.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            verdicts, after_a, after_b = [], [], []
            owners = list(zip(*[batch[c] for c in owner]))
            columns = zip(owners, batch["_a"], batch["_b"], batch["_change"], batch["_early"], batch["_kind"])
            for this, a, b, change, early, kind in columns:
                if this != key:
                    key, state = this, (a, b)
                verdict = early or step(state[0], state[1], change, kind)
                if not verdict:
                    signed = change if kind != "REVERT" else -change
                    state = (state[0] + signed, state[1] - signed)
                verdicts.append(verdict or "ACCEPTED")
                after_a.append(state[0])
                after_b.append(state[1])
            batch["verdict"], batch["_a"], batch["_b"] = verdicts, after_a, after_b
            yield batch.drop(columns=["_change", "_early"])

    return sorted_rows.mapInPandas(run, schema)


def _cents(c: Column) -> Column:
    return (c * 100).cast("bigint")


def _from_cents(name: str) -> Column:
    return (F.col(name).cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).try_cast(MONEY)


def apply_allocations(payments: DataFrame, changes: DataFrame) -> DataFrame:
    """Allocations and reversals of payments, in ``seq`` order, each with its verdict and what is left after it.

    ``changes``: company_id, payment_id, seq, kind (ALLOCATE or REVERT), amount, currency. Every
    change comes back once; those of unknown payments are refused too.
    """
    owner = ["company_id", "payment_id"]
    state = payments.select(*owner, F.col("currency").alias("_currency"), F.col("status").alias("_status"),
                            _cents(F.col("allocated_amount")).alias("_a"), _cents(F.col("unallocated_amount")).alias("_b"))
    joined = changes.join(state, owner, "left")
    early = (
        F.when(F.col("_a").isNull(), "PAYMENT_NOT_FOUND")
        .when((F.col("kind") == "ALLOCATE") & (F.col("_status") == "IGNORED"), "PAYMENT_IGNORED")
        .when(F.col("currency") != F.col("_currency"), "CURRENCY_MISMATCH").when(F.col("amount") <= 0, "NON_POSITIVE_AMOUNT"))
    rows = joined.select(
        *owner, "seq", "amount", F.col("kind").alias("_kind"), _cents(F.col("amount")).alias("_change"), F.coalesce(early, F.lit("")).alias("_early"),
        F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"), "_status")

    def verdict(allocated, unallocated, change, kind):
        return F.when((kind == "REVERT") & (change > allocated), "EXCEEDS_ALLOCATED").when((kind != "REVERT") & (change > unallocated), "EXCEEDS_UNALLOCATED").otherwise("")

    def step(allocated: int, unallocated: int, change: int, kind: str) -> str:
        if kind == "REVERT":
            return "EXCEEDS_ALLOCATED" if change > allocated else ""
        return "EXCEEDS_UNALLOCATED" if change > unallocated else ""

    done = _in_order(rows, owner, verdict, step)
    return done.select(
        *owner, "seq", F.col("_kind").alias("kind"), "amount", "verdict", _from_cents("_a").alias("allocated_after"), _from_cents("_b").alias("unallocated_after"))


def allocated_payments(payments: DataFrame, applied: DataFrame) -> DataFrame:
    """Payments after ``apply_allocations``: balances from the sums of accepted changes, status from the last accepted one."""
    owner = ["company_id", "payment_id"]
    sign = F.when(F.col("kind") == "REVERT", -F.col("amount")).otherwise(F.col("amount"))
    moved = applied.where("verdict = 'ACCEPTED'").groupBy(*owner).agg(
        F.sum(sign).try_cast(MONEY).alias("_moved"), F.max_by("kind", "seq").alias("_last"))
    joined = payments.join(moved, owner, "left")
    allocated = (F.col("allocated_amount") + F.coalesce("_moved", money(0))).try_cast(MONEY)
    unallocated = (F.col("unallocated_amount") - F.coalesce("_moved", money(0))).try_cast(MONEY)
    status = (
        F.when(F.col("_moved").isNull(), F.col("status"))
        .when((F.col("_last") == "REVERT") & (allocated == 0), "UNRECONCILED").when((F.col("_last") == "ALLOCATE") & (unallocated == 0), "RECONCILED")
        .otherwise("PARTIALLY_RECONCILED"))
    return joined.withColumns({"allocated_amount": allocated, "unallocated_amount": unallocated, "status": status}).drop("_moved", "_last")


def apply_receipts(invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """Money received against invoices, in ``seq`` order, each with its verdict.

    ``receipts``: company_id, invoice_id, seq, amount, currency. Only pending and part-paid invoices take money, never more
    than is outstanding; an invoice paid in full takes no more.
    """
    owner = ["company_id", "invoice_id"]
    state = invoices.select(*owner, F.col("currency").alias("_currency"), F.col("status").alias("_status"),
                            _cents(F.col("paid_amount")).alias("_a"), _cents(F.col("outstanding_amount")).alias("_b"))
    joined = receipts.join(state, owner, "left")
    early = (
        F.when(F.col("_a").isNull(), "INVOICE_NOT_FOUND").when(~F.col("_status").isin(vocab.OPEN_STATUSES), "STATUS_NOT_OPEN")
        .when(F.col("amount") <= 0, "NON_POSITIVE_AMOUNT").when(F.col("currency") != F.col("_currency"), "CURRENCY_MISMATCH"))
    rows = joined.select(
        *owner, "seq", "amount", F.lit("RECEIPT").alias("_kind"), _cents(F.col("amount")).alias("_change"), F.coalesce(early, F.lit("")).alias("_early"),
        F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))

    def verdict(paid, outstanding, change, kind):
        return F.when(outstanding == 0, "STATUS_NOT_OPEN").when(change > outstanding, "EXCEEDS_OUTSTANDING").otherwise("")

    def step(paid: int, outstanding: int, change: int, kind: str) -> str:
        if outstanding == 0:
            return "STATUS_NOT_OPEN"
        return "EXCEEDS_OUTSTANDING" if change > outstanding else ""

    done = _in_order(rows, owner, verdict, step)
    return done.select(*owner, "seq", "amount", "verdict", _from_cents("_a").alias("paid_after"), _from_cents("_b").alias("outstanding_after"))


def received_invoices(invoices: DataFrame, applied: DataFrame) -> DataFrame:
    """Invoices after ``apply_receipts``."""
    owner = ["company_id", "invoice_id"]
    moved = applied.where("verdict = 'ACCEPTED'").groupBy(*owner).agg(F.sum("amount").try_cast(MONEY).alias("_moved"))
    joined = invoices.join(moved, owner, "left")
    paid = (F.col("paid_amount") + F.coalesce("_moved", money(0))).try_cast(MONEY)
    left = (F.col("total_amount") - paid).try_cast(MONEY)
    status = F.when(F.col("_moved").isNull(), F.col("status")).when(left == 0, "PAID").otherwise("PARTIALLY_PAID")
    return joined.withColumns({
        "paid_amount": paid, "outstanding_amount": F.when(F.col("_moved").isNull(), F.col("outstanding_amount")).otherwise(left), "status": status,
    }).drop("_moved")


def _changed(table: DataFrame, changes: DataFrame, key: list[str], extra: list[str]) -> DataFrame:
    asked = changes.select(*key, F.col("action").alias("_action"), *[F.col(c).alias(f"_{c}") for c in extra])
    return table.join(asked, key, "left")


def change_payments(payments: DataFrame, changes: DataFrame) -> DataFrame:
    """IGNORE (needs a reason, no allocations) and UNIGNORE payments.

    ``changes``: company_id, payment_id, action, reason; one per payment. Adds ``change_verdict``, NULL where nothing was asked.
    """
    rows = _changed(payments, changes, ["company_id", "payment_id"], ["reason"])
    action, no_reason = F.col("_action"), blank_to_null(F.trim("_reason")).isNull()
    verdict = (
        F.when(action.isNull(), F.lit(None).cast("string"))
        .when((action == "IGNORE") & no_reason, "REASON_REQUIRED")
        .when((action == "IGNORE") & (F.col("allocated_amount") != 0), "HAS_ALLOCATIONS")
        .when((action == "UNIGNORE") & (F.col("status") != "IGNORED"), "NOT_IGNORED")
        .when(action.isin("IGNORE", "UNIGNORE"), "ACCEPTED").otherwise("UNKNOWN_ACTION"))
    return rows.withColumn("change_verdict", verdict).withColumn("status", F.when(
        F.col("change_verdict") == "ACCEPTED", F.when(action == "IGNORE", "IGNORED").otherwise("UNRECONCILED")).otherwise(F.col("status"))
    ).drop("_action", "_reason")


def change_invoices(invoices: DataFrame, changes: DataFrame) -> DataFrame:
    """CANCEL, ARCHIVE, UNARCHIVE and SET_DUE_DATE invoices.

    ``changes``: company_id, invoice_id, action, due_date; one per invoice.
    """
    rows = _changed(invoices, changes, ["company_id", "invoice_id"], ["due_date"])
    action, status = F.col("_action"), F.col("status")
    verdict = (
        F.when(action.isNull(), F.lit(None).cast("string"))
        .when((action == "CANCEL") & (status == "PAID"), "ALREADY_PAID").when((action == "CANCEL") & (status == "CANCELLED"), "ALREADY_CANCELLED")
        .when((action == "CANCEL") & (F.col("paid_amount") != 0), "HAS_PAYMENTS")
        .when((action == "ARCHIVE") & (status == "DRAFT"), "DRAFT_NOT_ARCHIVABLE")
        .when((action == "SET_DUE_DATE") & (status == "CANCELLED"), "CANCELLED")
        .when((action == "SET_DUE_DATE") & (F.col("_due_date") < F.col("issue_date")), "DUE_BEFORE_ISSUE")
        .when(action.isin("CANCEL", "ARCHIVE", "UNARCHIVE", "SET_DUE_DATE"), "ACCEPTED").otherwise("UNKNOWN_ACTION"))
    ok = lambda *names: (F.col("change_verdict") == "ACCEPTED") & action.isin(*names)
    return rows.withColumn("change_verdict", verdict).withColumns({
        "status": F.when(ok("CANCEL"), "CANCELLED").otherwise(status),
        "is_archived": F.when(ok("ARCHIVE"), True).when(ok("UNARCHIVE"), False).otherwise(F.col("is_archived")),
        "due_date": F.when(ok("SET_DUE_DATE"), F.coalesce("_due_date", "due_date")).otherwise(F.col("due_date")),
    }).drop("_action", "_due_date")


def change_customers(customers: DataFrame, changes: DataFrame) -> DataFrame:
    """ARCHIVE and UNARCHIVE customers."""
    rows = _changed(customers, changes, ["company_id", "customer_id"], [])
    action = F.col("_action")
    verdict = F.when(action.isNull(), F.lit(None).cast("string")).when(action.isin("ARCHIVE", "UNARCHIVE"), "ACCEPTED").otherwise("UNKNOWN_ACTION")
    return rows.withColumn("change_verdict", verdict).withColumn(
        "is_archived", F.when(action == "ARCHIVE", True).when(action == "UNARCHIVE", False).otherwise(F.col("is_archived"))).drop("_action")


def _load(rows: DataFrame, stored: DataFrame, key: list[str], stored_key: list[Column], early: Column, order: str, taken: str) -> DataFrame:
    """Verdict per new row: an early error, TAKEN by a stored row or an earlier new one, or ACCEPTED.

    The earliest row per key is a map-side-combined minimum, so repeats of one key never gather.
    """
    known = stored.select(*[c.alias(k) for c, k in zip(stored_key, key)]).distinct().withColumn("_known", F.lit(True))
    checked = rows.withColumn("_early", early)
    firsts = checked.where("_early is null").groupBy(*key).agg(F.min(order).alias("_first"))
    joined = checked.join(firsts, key, "left").join(known, key, "left")
    verdict = F.coalesce("_early", F.when(F.col("_known"), taken).when(F.col("_first") != F.col(order), taken), F.lit("ACCEPTED"))
    return joined.withColumn("verdict", verdict).drop("_early", "_first", "_known", *[k for k in key if k.startswith("_")])


def load_customers(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New customers (company_id, seq, name, tax_id, email, phone): names squeezed, unique in the company in any case."""
    tidy = new.withColumns({
        "name": squeeze(F.col("name")), "tax_id": blank_to_null(F.trim("tax_id")), "email": blank_to_null(F.lower(F.trim("email"))),
        "phone": blank_to_null(F.trim("phone")), "_key": F.lower(squeeze(F.col("name")))})
    early = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "NAME_REQUIRED")
    return _load(tidy, stored, ["company_id", "_key"], [F.col("company_id"), F.lower("name")], early, "seq", "NAME_TAKEN")


def _owner_known(new: DataFrame, customers: DataFrame) -> DataFrame:
    known = customers.select("company_id", "customer_id").withColumn("_owner", F.lit(True))
    return new.join(known, ["company_id", "customer_id"], "left")


def load_aliases(new: DataFrame, stored: DataFrame, customers: DataFrame) -> DataFrame:
    """New aliases (company_id, customer_id, seq, alias_name), unique in the company in any case."""
    tidy = _owner_known(new, customers).withColumns({"alias_name": squeeze(F.col("alias_name")), "_key": F.lower(squeeze(F.col("alias_name")))})
    early = F.when(F.col("_owner").isNull(), "CUSTOMER_NOT_FOUND").when(F.coalesce(F.col("alias_name"), F.lit("")) == "", "ALIAS_REQUIRED")
    return _load(tidy, stored, ["company_id", "_key"], [F.col("company_id"), F.lower("alias_name")], early, "seq", "ALIAS_TAKEN").drop("_owner")


def load_identifiers(new: DataFrame, stored: DataFrame, customers: DataFrame) -> DataFrame:
    """New identifiers (company_id, customer_id, seq, identifier_type, identifier_value), unique per type and company in any case."""
    kind, value = F.upper(F.trim("identifier_type")), F.trim("identifier_value")
    tidy = _owner_known(new, customers).withColumns({"identifier_type": kind, "identifier_value": value, "_type": kind, "_value": F.lower(value)})
    early = (
        F.when(F.col("_owner").isNull(), "CUSTOMER_NOT_FOUND").when(~F.coalesce(kind.isin(vocab.IDENTIFIER_TYPES), F.lit(False)), "UNKNOWN_TYPE")
        .when(F.coalesce(value, F.lit("")) == "", "VALUE_REQUIRED"))
    return _load(tidy, stored, ["company_id", "_type", "_value"], [F.col("company_id"), F.col("identifier_type"), F.lower("identifier_value")],
                 early, "seq", "IDENTIFIER_TAKEN").drop("_owner")


def load_payments(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Manual receipts (company_id, seq, payment_date, amount, currency, narration, payment_reference, ...).

    A reference, where given, must be new in the company. Accepted rows are unreconciled payments.
    """
    reference = blank_to_null(F.trim("payment_reference"))
    tidy = new.withColumns({
        "payment_reference": reference, "currency": F.upper(F.trim("currency")), "amount": F.col("amount").try_cast(MONEY),
        "narration": F.coalesce("narration", F.lit("Manual payment receipt")),
        # rows without a reference never collide, so each gets a key of its own
        "_key": F.coalesce(reference, F.concat(F.lit("\x00"), F.col("seq").cast("string")))})
    early = F.when(F.coalesce(F.col("amount"), money(0)) <= 0, "NON_POSITIVE_AMOUNT")
    loaded = _load(tidy, stored.where("payment_reference is not null"), ["company_id", "_key"], [F.col("company_id"), F.col("payment_reference")],
                   early, "seq", "REFERENCE_TAKEN")
    return loaded.withColumns({
        "allocated_amount": money(0), "unallocated_amount": F.col("amount"), "status": F.lit("UNRECONCILED"), "source": F.lit("MANUAL")})
