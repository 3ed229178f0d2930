"""Content and transaction fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remitlens import vocab
from remitlens.functions.text import blank_to_null


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_valid_reference(reference: Column) -> Column:
    """At least four letters or digits and not a placeholder."""
    plain = F.upper(F.regexp_replace(F.coalesce(reference, F.lit("")), "[^A-Za-z0-9]", ""))
    return (F.length(plain) >= 4) & ~plain.isin(vocab.REFERENCE_PLACEHOLDERS)


def _squash(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def transaction_fingerprint(
    company: Column, reference: Column, account: Column, day: Column, amount: Column,
    currency: Column, direction: Column, narration: Column, balance: Column,
) -> Column:
    """SHA-256 over the bank reference where it is a real one, else over the whole transaction."""
    account = blank_to_null(account)
    by_reference = F.concat_ws(
        "|", F.lit("REF"), company.cast("string"), _squash(F.coalesce(account, F.lit("SHARED"))), _squash(reference))
    by_content = F.concat_ws(
        "|", F.lit("FALLBACK"), company.cast("string"), _squash(F.coalesce(account, F.lit("UNKNOWN"))),
        F.date_format(day, "yyyy-MM-dd"), amount.cast("decimal(14,2)").cast("string"),
        F.upper(currency), F.upper(direction),
        F.coalesce(balance.cast("decimal(14,2)").cast("string"), F.lit("NOBAL")),
        F.regexp_replace(F.lower(F.trim(narration)), r"(?U)\s+", " "),
    )
    return F.sha2(F.when(is_valid_reference(reference), by_reference).otherwise(by_content), 256)


def stable_id(*parts: Column) -> Column:
    """UUID-shaped id from the parts; the same input gives the same id on every run and retry."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", *[F.substring(digest, start, length)
                              for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
