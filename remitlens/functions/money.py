"""Money: exact decimals with HALF_UP cents, never mixed over currencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remitlens import vocab
from remitlens.functions.arrays import bind
from remitlens.functions.text import blank_to_null
from remitlens.schemas import MONEY

# room for long inputs before they are rounded to cents
WIDE = "decimal(38,10)"


def to_cents(text: Column) -> Column:
    """Text to money, HALF_UP; NULL when it is not a number or does not fit."""
    return text.try_cast(WIDE).try_cast(MONEY)


def statement_amount(c: Column) -> Column:
    """Amount cell of a statement; NULL for formulas, letters, misplaced signs, two dots."""
    def parsed(raw: Column) -> Column:
        return bind(F.regexp_replace(raw, r"(?U)[^\d.+\-]", ""), lambda digits: F.when(
            ~raw.rlike("^[=@\\t\\r]") & ~raw.rlike(r"\p{L}") & digits.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"),
            to_cents(digits)))

    return bind(F.trim(F.coalesce(c, F.lit(""))), parsed)


def add(a: Column, b: Column, currency_a: Column, currency_b: Column) -> Column:
    """Sum of two amounts; NULL when the currencies differ or the result doesn't fit."""
    return F.when(currency_a == currency_b, F.try_add(a, b).try_cast(MONEY))


def subtract(a: Column, b: Column, currency_a: Column, currency_b: Column) -> Column:
    return F.when(currency_a == currency_b, F.try_subtract(a, b).try_cast(MONEY))


def multiply(a: Column, factor: Column) -> Column:
    """Amount times an exact factor, HALF_UP to cents; NULL when it doesn't fit."""
    return F.try_multiply(a, factor).try_cast(MONEY)


def compare(a: Column, b: Column, currency_a: Column, currency_b: Column) -> Column:
    """-1, 0 or 1; NULL when the currencies differ."""
    order = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(currency_a == currency_b, order)


def format_money(a: Column, currency: Column) -> Column:
    """``₹1,234.50`` for INR, ``USD 1,234.50`` for the rest."""
    symbol = F.when(currency == "INR", F.lit("₹")).otherwise(F.concat(currency, F.lit(" ")))
    return F.concat(symbol, F.format_number(a, 2))


def currency_code(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def is_currency_code(code: Column) -> Column:
    return code.rlike("^[A-Z]{3}$")


def document_amount(c: Column, default_currency: Column | str = "INR") -> Column:
    """Amount found in a document: ``struct(amount, currency, is_valid, error)``."""
    default = default_currency if isinstance(default_currency, Column) else F.lit(default_currency)

    def parsed(raw: Column) -> Column:
        return bind(F.trim(F.substring_index(raw, ":", -1)), lambda text: bind(
            F.trim(F.regexp_replace(text, r"(?i)(?:₹|\$|€|£|INR|USD|EUR|GBP|RS\.?|/-)", "")),
            lambda number: bind(to_cents(F.replace(number, F.lit(","), F.lit(""))), lambda amount: checked(raw, text, number, amount))))

    def checked(raw: Column, text: Column, number: Column, amount: Column) -> Column:
        currency = F.coalesce(
            *[F.when(F.contains(F.lower(text), F.lit(symbol)), F.lit(code)) for symbol, code in vocab.CURRENCY_SYMBOLS], default)
        empty, formula = raw == "", raw.rlike("^[=@\\t\\r]")
        bad_groups = F.contains(number, F.lit(",")) & ~(number.rlike(vocab.INDIAN_GROUPING) | number.rlike(vocab.WESTERN_GROUPING))
        error = (
            F.when(empty, F.lit("EMPTY"))
            .when(formula, F.lit("FORMULA_INJECTION"))
            .when(number.rlike(r"\p{L}"), F.lit("ALPHABETIC_CHARACTERS"))
            .when(bad_groups, F.lit("MALFORMED_GROUPING"))
            .when(amount.isNull(), F.lit("NOT_A_NUMBER"))
            .when(amount < 0, F.lit("NEGATIVE"))
        )
        return bind(error, lambda e: F.struct(
            F.when(e.isNull(), amount).alias("amount"),
            F.when(empty | formula, default).otherwise(currency).alias("currency"),
            e.isNull().alias("is_valid"),
            e.alias("error"),
        ))

    return bind(F.trim(F.coalesce(c, F.lit(""))), parsed)


def optional_amount(c: Column) -> Column:
    return to_cents(F.replace(blank_to_null(F.trim(c)), F.lit(","), F.lit("")))
