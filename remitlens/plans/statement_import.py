"""The statement import as one job over a landing directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from remitlens.config import NO_LIMITS, ReadLimits
from remitlens.operators import imports
from remitlens.session import cut_lineage
from remitlens.sources import statements
from remitlens.sources.fingerprint_index import FingerprintIndex


@dataclass(frozen=True)
class StatementImport:
    report: DataFrame
    transactions: DataFrame
    payments: DataFrame
    errors: DataFrame


def judge_statements(
    files: DataFrame, batches: DataFrame | None = None, stored: DataFrame | FingerprintIndex | None = None,
    default_currency: str = "INR", skip_duplicates: bool = True, durable: bool = True, limits: ReadLimits = NO_LIMITS, batch: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(files with their fate, rows with their outcome).

    ``files``: company_id, file_name, content, bank_account_number. Parsed rows are read several
    times by the gates and reports after them, so they are cut off from the parsing (``durable``).
    """
    screened = statements.screen_files(files, limits)
    if batches is not None:
        screened = imports.unseen_files(screened, batches)
    laid = statements.parse_layout(screened, limits)
    parsed = statements.parse_rows(statements.statement_rows(laid), default_currency)
    printed = imports.fingerprint_rows(parsed)
    judged = imports.deduplicate_rows(cut_lineage(printed) if durable else printed, stored, skip_duplicates, batch)
    return laid.drop("records"), judged


def import_statements(files: DataFrame, batches: DataFrame | None = None, stored: DataFrame | FingerprintIndex | None = None, default_currency: str = "INR",
                      skip_duplicates: bool = True, durable: bool = True, limits: ReadLimits = NO_LIMITS, batch: str = "") -> StatementImport:
    laid, judged = judge_statements(files, batches, stored, default_currency, skip_duplicates, durable, limits, batch)
    transactions = imports.imported_transactions(judged)
    return StatementImport(
        report=imports.import_report(laid, judged), transactions=transactions,
        payments=imports.payments_from_transactions(transactions), errors=imports.row_errors(judged))
