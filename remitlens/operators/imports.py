"""Statement import: three de-duplication gates, payments from credits, the import report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions.fingerprint import stable_id, transaction_fingerprint
from remitlens.operators.rows import compute_once
from remitlens.schemas import money
from remitlens.session import cut_lineage
from remitlens.sources.fingerprint_index import FingerprintIndex, met_by


def unseen_files(files: DataFrame, batches: DataFrame) -> DataFrame:
    """Files whose content was not imported yet for the company; an earlier FAILED import may be retried.

    Of several new files with the same content the first by name goes on.
    """
    done = batches.where(F.col("status") != "FAILED").select("company_id", "file_hash")
    firsts = files.groupBy("company_id", "file_hash").agg(F.min("file_name").alias("file_name"))
    fresh = firsts.join(done, ["company_id", "file_hash"], "left_anti")
    return files.join(fresh, ["company_id", "file_hash", "file_name"], "left_semi")


def fingerprint_rows(parsed: DataFrame) -> DataFrame:
    """Add ``deduplication_hash`` to good rows."""
    return compute_once(parsed, {"deduplication_hash": F.when(F.col("error_field").isNull(), transaction_fingerprint(
        F.col("company_id"), F.col("reference_number"), F.col("bank_account_number"), F.col("transaction_date"), F.col("amount"),
        F.col("currency"), F.col("transaction_type"), F.col("narration"), F.col("balance")))})


def deduplicate_rows(rows: DataFrame, stored: DataFrame | FingerprintIndex | None = None, skip_duplicates: bool = True, batch: str = "") -> DataFrame:
    """Outcome of every parsed row: IMPORTED, INVALID, DUPLICATE_IN_FILE, DUPLICATE_STORED or DUPLICATE_ERROR.

    ``rows`` needs ``company_id``, ``file_name``, ``row_number``, ``error_field`` and
    ``deduplication_hash``. Files count in order of their names, rows in order of their numbers. The first row of a
    fingerprint is imported unless ``stored`` (a table with company_id and deduplication_hash, or an index, which leaves out the
    entries of this ``batch``) has it; a repeat in the same file is a duplicate and an error, one in a later file is a stored duplicate.

    The first row per fingerprint is found with a map-side-combined minimum, so a fingerprint
    shared by a large part of all rows never gathers in one task; joining it back is left to the
    skew-join split.
    """
    key = ["company_id", "deduplication_hash"]
    good = rows.where("error_field is null")
    firsts = good.groupBy(*key).agg(F.min(F.struct("file_name", "row_number")).alias("_first"))
    if stored is not None:
        firsts = cut_lineage(firsts)
        known = stored.known(firsts, batch) if isinstance(stored, FingerprintIndex) else met_by(stored, firsts.select(*key))
        firsts = firsts.join(known.withColumn("_known", F.lit(True)), key, "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(None).cast("boolean"))
    bad = rows.where("error_field is not null").withColumn("outcome", F.lit("INVALID"))
    stored_outcome = "DUPLICATE_STORED" if skip_duplicates else "DUPLICATE_ERROR"
    outcome = (
        F.when(F.col("_known"), stored_outcome)
        .when((F.col("_first.file_name") == F.col("file_name")) & (F.col("_first.row_number") == F.col("row_number")), "IMPORTED")
        .when(F.col("_first.file_name") == F.col("file_name"), "DUPLICATE_IN_FILE").otherwise(stored_outcome))
    judged = good.join(firsts, key).withColumn("outcome", outcome).drop("_first", "_known")
    return judged.select(*bad.columns).unionByName(bad)


def imported_transactions(judged: DataFrame) -> DataFrame:
    """Bank transactions to append. The id comes from the fingerprint, so a retried job writes the same rows."""
    return judged.where("outcome = 'IMPORTED'").select(
        "company_id", stable_id(F.lit("TXN"), F.col("company_id").cast("string"), F.col("deduplication_hash")).alias("bank_transaction_id"),
        "file_name", "file_hash", "row_number", "transaction_date", "value_date", "amount", "transaction_type", "narration",
        "reference_number", "balance", "currency", "bank_account_number", "counterparty_name", "raw_row", "deduplication_hash")


def payments_from_transactions(transactions: DataFrame) -> DataFrame:
    """An unreconciled payment for every credit."""
    return transactions.where("transaction_type = 'CREDIT'").select(
        "company_id", stable_id(F.lit("PAY"), F.col("company_id").cast("string"), F.col("deduplication_hash")).alias("payment_id"),
        "bank_transaction_id", F.col("transaction_date").alias("payment_date"), "amount", money(0).alias("allocated_amount"),
        F.col("amount").alias("unallocated_amount"), "currency", "narration", F.col("reference_number").alias("payment_reference"),
        "bank_account_number", F.lit(None).cast("string").alias("payer_raw_name"), F.lit(None).cast("string").alias("payer_raw_identifier"),
        F.lit("UNRECONCILED").alias("status"), F.lit("BANK_STATEMENT_CSV").alias("source"))


def import_report(files: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per file: counts and COMPLETED, or FAILED with the reason."""
    is_ = lambda *names: F.col("outcome").isin(*names)
    counts = judged.groupBy("company_id", "file_name").agg(
        F.count("*").alias("total_rows"),
        F.count_if(is_("IMPORTED") & (F.col("transaction_type") == "CREDIT")).alias("imported_payments"),
        F.count_if(is_("IMPORTED") & (F.col("transaction_type") == "DEBIT")).alias("skipped_debits"),
        F.count_if(is_("DUPLICATE_IN_FILE", "DUPLICATE_STORED")).alias("skipped_duplicates"),
        F.count_if(is_("INVALID", "DUPLICATE_IN_FILE", "DUPLICATE_ERROR")).alias("failed_rows"))
    fields = ["total_rows", "imported_payments", "skipped_debits", "skipped_duplicates", "failed_rows"]
    return files.select("company_id", "file_name", "file_hash", "file_error").join(counts, ["company_id", "file_name"], "left").select(
        "company_id", "file_name", "file_hash", F.when(F.col("file_error").isNull(), "COMPLETED").otherwise("FAILED").alias("status"),
        F.col("file_error").alias("error_message"), *[F.coalesce(f, F.lit(0).cast("bigint")).alias(f) for f in fields])


def row_errors(judged: DataFrame) -> DataFrame:
    """Failed rows with field and message."""
    repeat = F.col("outcome").isin("DUPLICATE_IN_FILE", "DUPLICATE_ERROR")
    return judged.where(F.col("outcome").isin("INVALID", "DUPLICATE_IN_FILE", "DUPLICATE_ERROR")).select(
        "company_id", "file_name", "row_number", F.when(repeat, "reference_number").otherwise(F.col("error_field")).alias("field"),
        F.when(F.col("outcome") == "DUPLICATE_IN_FILE", "Repeated transaction in the file.")
        .when(F.col("outcome") == "DUPLICATE_ERROR", "Transaction is stored already.").otherwise(F.col("error_message")).alias("message"))
