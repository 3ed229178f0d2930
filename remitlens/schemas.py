"""Schemas of the tables the operators take.

Id columns may be of any orderable type (canonical UUID text in production, integers in tests).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
SCORE = "decimal(5,2)"
PRIORITY = "decimal(7,3)"

PAYMENT = f"""
    company_id string, payment_id string, amount {MONEY}, currency string, payment_date date,
    payer_raw_name string, payer_raw_identifier string, payment_reference string,
    bank_account_number string, narration string, bank_transaction_id string,
    allocated_amount {MONEY}, unallocated_amount {MONEY}, status string, transaction_type string
"""

CUSTOMER = """
    company_id string, customer_id string, name string, tax_id string, email string,
    phone string, is_archived boolean
"""

CUSTOMER_ALIAS = "company_id string, customer_id string, alias_name string"

CUSTOMER_IDENTIFIER = """
    company_id string, customer_id string, identifier_type string, identifier_value string,
    is_active boolean
"""

INVOICE = f"""
    company_id string, invoice_id string, customer_id string, invoice_number string,
    issue_date date, due_date date, total_amount {MONEY}, paid_amount {MONEY},
    outstanding_amount {MONEY}, currency string, status string, is_archived boolean
"""

BANK_TRANSACTION = f"""
    company_id string, bank_transaction_id string, batch_id string, row_number int,
    transaction_date date, value_date date, amount {MONEY}, transaction_type string,
    narration string, reference_number string, balance {MONEY}, currency string,
    bank_account_number string, counterparty_name string, raw_row map<string,string>,
    deduplication_hash string
"""


def money(value) -> Column:
    """A money literal, or a column cast to the money type (HALF_UP to two decimals)."""
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast(MONEY)
