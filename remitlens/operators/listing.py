"""Listings, searches, key lookups, counts, pages, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitlens.operators.rows import join_known


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _like(column: str, query: str) -> Column:
    return F.col(column).ilike(f"%{query.strip()}%")


def list_payments(payments: DataFrame, status=None, start=None, end=None, min_amount=None, max_amount=None, search=None) -> DataFrame:
    """Payments by any of status, date range, amount range and text in reference, narration or payer."""
    tests = []
    if status:
        tests.append(F.col("status") == status.upper())
    if start:
        tests.append(F.col("payment_date") >= F.lit(start))
    if end:
        tests.append(F.col("payment_date") <= F.lit(end))
    if min_amount is not None:
        tests.append(F.col("amount") >= F.lit(min_amount))
    if max_amount is not None:
        tests.append(F.col("amount") <= F.lit(max_amount))
    if search and search.strip():
        tests.append(F.coalesce(
            _like("payment_reference", search) | _like("narration", search) | _like("payer_raw_name", search), F.lit(False)))
    return payments.where(_all(tests))


def list_transactions(transactions: DataFrame, direction=None, start=None, end=None, batch=None) -> DataFrame:
    """Bank rows by direction, date range and import batch."""
    tests = []
    if direction:
        tests.append(F.col("transaction_type") == direction.upper())
    if start:
        tests.append(F.col("transaction_date") >= F.lit(start))
    if end:
        tests.append(F.col("transaction_date") <= F.lit(end))
    if batch is not None:
        tests.append(F.col("batch_id") == F.lit(batch))
    return transactions.where(_all(tests))


def list_invoices(invoices: DataFrame, customer=None, status=None, issued_from=None, issued_to=None, due_from=None, due_to=None,
                  has_outstanding=None, is_archived=False) -> DataFrame:
    """Invoices by customer, status, issue and due range, open balance and archive flag (None: both)."""
    tests = []
    if customer is not None:
        tests.append(F.col("customer_id") == F.lit(customer))
    if status:
        tests.append(F.col("status") == status)
    if is_archived is not None:
        tests.append(F.col("is_archived") == F.lit(is_archived))
    for column, low, high in (("issue_date", issued_from, issued_to), ("due_date", due_from, due_to)):
        if low:
            tests.append(F.col(column) >= F.lit(low))
        if high:
            tests.append(F.col(column) <= F.lit(high))
    if has_outstanding is not None:
        tests.append(F.col("outstanding_amount") > 0 if has_outstanding else F.col("outstanding_amount") == 0)
    return invoices.where(_all(tests))


def list_documents(documents: DataFrame, ocr_status=None, has_invoice=None) -> DataFrame:
    tests = []
    if ocr_status:
        tests.append(F.col("ocr_status") == ocr_status)
    if has_invoice is not None:
        tests.append(F.col("invoice_id").isNotNull() if has_invoice else F.col("invoice_id").isNull())
    return documents.where(_all(tests))


def list_customers(customers: DataFrame, include_archived: bool = False, with_place: bool = False) -> DataFrame:
    """Customers; with their ``place`` in their company's order by name, then id, if asked for."""
    listed = customers if include_archived else customers.where(~F.col("is_archived"))
    return listed if not with_place else listed.withColumn("place", F.row_number().over(W.partitionBy("company_id").orderBy("name", "customer_id")))


def list_batches(transactions: DataFrame) -> DataFrame:
    """Import batches with their rows and first and last date, and their ``place`` per company, newest first."""
    batches = transactions.groupBy("company_id", "batch_id").agg(
        F.count("*").alias("transactions"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"))
    return batches.withColumn("place", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("last_date"), F.desc("batch_id"))))


def search_customers(customers: DataFrame, aliases: DataFrame, identifiers: DataFrame, query: str, include_archived: bool = False) -> DataFrame:
    """Customers with the text in name, tax id, email, phone, an alias or an identifier.

    Keys found in the three places are united and met by one semi-join, instead of OR-ed
    subqueries, which would need an existence join each.
    """
    listed = list_customers(customers, include_archived)
    if not query.strip():
        return listed
    key = ["company_id", "customer_id"]
    own = listed.where(F.coalesce(
        _like("name", query) | F.coalesce(_like("tax_id", query), F.lit(False)) | F.coalesce(_like("email", query), F.lit(False))
        | F.coalesce(_like("phone", query), F.lit(False)), F.lit(False))).select(*key)
    hits = own.unionByName(aliases.where(_like("alias_name", query)).select(*key)).unionByName(
        identifiers.where(_like("identifier_value", query)).select(*key))
    return listed.join(hits.distinct(), key, "left_semi")


def search_invoices(invoices: DataFrame, customers: DataFrame, query: str, is_archived: bool | None = False) -> DataFrame:
    """Invoices with the text in their number, or in the name or tax id of their customer."""
    listed = list_invoices(invoices, is_archived=is_archived)
    if not query.strip():
        return listed
    named = customers.where(_like("name", query) | F.coalesce(_like("tax_id", query), F.lit(False))).select("company_id", "customer_id")
    by_number = _like("invoice_number", query)
    by_customer = listed.where(~by_number).join(named, ["company_id", "customer_id"], "left_semi")
    return listed.where(by_number).unionByName(by_customer.select(*listed.columns))


def lookup(table: DataFrame, keys: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """Rows of ``table`` whose ``column`` is one of ``keys`` (company_id, key), by default in any case."""
    form = (lambda c: c) if exact else (lambda c: F.lower(F.trim(c)))
    wanted = keys.select("company_id", form(F.col("key")).alias("_key")).distinct()
    return table.withColumn("_key", form(F.col(column))).join(wanted, ["company_id", "_key"], "left_semi").drop("_key")


def page(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 50) -> DataFrame:
    """One page. The sort is global but only the rows up to the page's end are kept."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def company_pages(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 50) -> DataFrame:
    """The same page of every company, with each row's ``place`` in its company.

    Only the rows up to the page's end leave a task, so a large company costs no more than its page.
    """
    placed = df.withColumn("place", F.row_number().over(W.partitionBy("company_id").orderBy(*order)))
    return placed.where(F.col("place") <= page * page_size).where(F.col("place") > (page - 1) * page_size)


def page_totals(df: DataFrame, page_size: int = 50) -> DataFrame:
    """Rows and pages per company."""
    return df.groupBy("company_id").agg(F.count("*").alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(page_size)).cast("bigint"))


def payments_by_status(payments: DataFrame) -> DataFrame:
    return payments.groupBy("company_id", "status").agg(F.count("*").alias("payments"))


def invoice_detail(invoices: DataFrame, customers: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Invoices with their customer's name, tax id and archive flag, and their document's status."""
    who = customers.select("company_id", "customer_id", F.col("name").alias("customer_name"), F.col("tax_id").alias("customer_tax_id"),
                           F.col("is_archived").alias("customer_is_archived"))
    joined = join_known(invoices, who, ["company_id", "customer_id"])
    if documents is None:
        return joined
    return join_known(joined, documents.select("company_id", "document_id", "ocr_status", "file_name"), ["company_id", "document_id"])


def _with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()])))


def check_payments(payments: DataFrame) -> DataFrame:
    """Add ``violations`` of the payment invariants; empty for valid rows."""
    a, u = F.col("allocated_amount"), F.col("unallocated_amount")
    return _with_violations(payments, {
        "NON_POSITIVE_AMOUNT": F.col("amount") <= 0, "NEGATIVE_ALLOCATED": a < 0, "NEGATIVE_UNALLOCATED": u < 0,
        "BALANCE_NOT_CONSERVED": a + u != F.col("amount")})


def check_invoices(invoices: DataFrame) -> DataFrame:
    total, paid, open_ = F.col("total_amount"), F.col("paid_amount"), F.col("outstanding_amount")
    return _with_violations(invoices, {
        "DUE_BEFORE_ISSUE": F.col("due_date") < F.col("issue_date"), "NON_POSITIVE_TOTAL": total <= 0, "NEGATIVE_PAID": paid < 0,
        "NEGATIVE_OUTSTANDING": open_ < 0, "BALANCE_NOT_CONSERVED": total - paid != open_,
        "CUSTOMER_REQUIRED": (F.col("status") != "DRAFT") & F.col("customer_id").isNull()})


def check_transactions(transactions: DataFrame) -> DataFrame:
    return _with_violations(transactions, {"NON_POSITIVE_AMOUNT": F.col("amount") <= 0})


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)
