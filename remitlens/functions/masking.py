"""Masks for values shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remitlens.functions.text import blank_to_null


def _last4(text: Column) -> Column:
    return F.right(text, F.lit(4))


def mask_account(c: Column) -> Column:
    """Stars and the last four; ``****`` for short values; NULL for none."""
    text = F.trim(blank_to_null(c))
    stars = F.repeat(F.lit("*"), F.greatest(F.length(text) - 4, F.lit(0)))
    return F.when(F.length(text) <= 4, F.lit("****")).otherwise(F.concat(stars, _last4(text)))


def mask_account_bullets(c: Column) -> Column:
    """Eight bullets and the last four; short values are kept."""
    text = F.trim(blank_to_null(c))
    return F.when(F.length(text) <= 4, text).otherwise(F.concat(F.lit("•" * 8), _last4(text)))


def mask_vpa(c: Column) -> Column:
    """First two letters of the user and the handle; an account mask when there is no handle."""
    text = F.trim(blank_to_null(c))
    user = F.substring_index(text, "@", 1)
    handle = F.regexp_replace(text, "^[^@]*@", "")
    masked = F.when(F.length(user) <= 2, F.lit("**")).otherwise(
        F.concat(F.left(user, F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.length(user) - 2, F.lit(0)))))
    return F.when(F.contains(text, F.lit("@")), F.concat(masked, F.lit("@"), handle)).otherwise(mask_account(c))


def mask_evidence_value(value: Column, evidence_type: Column) -> Column:
    """Mask the matched value of account and VPA evidence, leave the rest."""
    return (
        F.when(evidence_type.isin("EXACT_BANK_ACCOUNT", "BANK_ACCOUNT_IDENTIFIER"),
               F.coalesce(mask_account(value), value))
        .when(evidence_type.isin("EXACT_UPI_VPA", "EXACT_VIRTUAL_ACCOUNT", "UPI_VPA_IDENTIFIER"),
              F.coalesce(mask_vpa(value), value))
        .otherwise(value)
    )
