"""Dates: statement dates, document dates, day gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remitlens import vocab
from remitlens.functions.arrays import bind


def statement_date(c: Column) -> Column:
    """First of the known formats that fits, day before month; NULL when none does."""
    tidy = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    return bind(tidy, _statement_date)


def _statement_date(text: Column) -> Column:
    # month names are matched without regard to case
    named = F.initcap(text)
    tries = [
        F.when(text.rlike(shape), F.try_to_date(named if "MMM" in fmt else text, fmt))
        for shape, fmt in vocab.STATEMENT_DATE_FORMATS
    ]
    return F.coalesce(*tries)


def iso_date(c: Column) -> Column:
    """``YYYY-MM-DD`` (``/`` allowed), strictly."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("/"), F.lit("-"))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _date_of(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _month_number(name: Column) -> Column:
    """Month number for a full or three-letter English name, else NULL."""
    return bind(F.lower(name), lambda low: F.when(low != "", F.coalesce(*[
        F.when(low.isin(month, month[:3]), F.lit(f"{i:02d}"))
        for i, month in enumerate(vocab.MONTHS, start=1)
    ])))


_DAY_MONTH = r"(?iU)\b([0-9]{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})[\s,]+([0-9]{4})\b"
_MONTH_DAY = r"(?iU)\b([A-Za-z]{3,9})[\s]+([0-9]{1,2})(?:st|nd|rd|th)?[\s,]+([0-9]{4})\b"
_NUMERIC = r"(?U)\b([0-9]{1,4})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})\b"


def document_date(c: Column, day_first: bool = True) -> Column:
    """Date written in a document: ``struct(parsed_date, is_ambiguous, warning)``."""
    tidy = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    return bind(tidy, lambda text: _document_date(text, day_first))


def _document_date(text: Column, day_first: bool) -> Column:
    """Each pattern is tried once: lambdas compute a name anew wherever it stands, so its parts are bound."""
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def outcome(value: Column, ambiguous: Column | None, warning: str) -> Column:
        return bind(value, lambda v: F.struct(
            v.alias("parsed_date"),
            (v.isNull() if ambiguous is None else ambiguous).alias("is_ambiguous"),
            F.when(v.isNull(), F.lit(warning)).alias("warning"),
        ))

    unknown = F.struct(
        F.lit(None).cast("date").alias("parsed_date"), F.lit(True).alias("is_ambiguous"),
        F.lit("UNRECOGNIZED").alias("warning"),
    )

    def numeric(n: Column) -> Column:
        first, second, third, v1, v2 = (n[c] for c in ("first", "second", "third", "v1", "v2"))
        year = F.when(F.length(third) == 2, F.concat(F.lit("20"), third)).otherwise(third)
        day_month, month_day = _date_of(year, second, first), _date_of(year, first, second)
        both_small = F.struct(
            (day_month if day_first else month_day).alias("parsed_date"),
            F.lit(True).alias("is_ambiguous"),
            F.lit("AMBIGUOUS_DAY_FIRST" if day_first else "AMBIGUOUS_MONTH_FIRST").alias("warning"),
        )
        return (
            F.when(F.length(first) == 4, outcome(_date_of(first, second, F.when(F.length(third) <= 2, third)), None, "INVALID_DATE"))
            .when((first == "") | ~F.length(third).isin(2, 4), unknown)
            .when((v1 > 12) & (v2 <= 12), outcome(day_month, None, "INVALID_DATE"))
            .when((v2 > 12) & (v1 <= 12), outcome(month_day, None, "INVALID_DATE"))
            .when((v1 <= 12) & (v2 <= 12), both_small)
            .otherwise(unknown)
        )

    parts = F.struct(*[part(_NUMERIC, i).alias(c) for i, c in enumerate(("first", "second", "third"), start=1)])
    numbers = lambda p: F.struct(
        p["first"].alias("first"), p["second"].alias("second"), p["third"].alias("third"), p["first"].try_cast("int").alias("v1"), p["second"].try_cast("int").alias("v2"))
    month_first = bind(_month_number(part(_MONTH_DAY, 1)), lambda month: F.when(
        month.isNotNull(), outcome(_date_of(part(_MONTH_DAY, 3), month, part(_MONTH_DAY, 2)), None, "INVALID_DATE"))
        .otherwise(bind(parts, lambda p: bind(numbers(p), numeric))))
    named = bind(_month_number(part(_DAY_MONTH, 2)), lambda month: F.when(
        month.isNotNull(), outcome(_date_of(part(_DAY_MONTH, 3), month, part(_DAY_MONTH, 1)), None, "INVALID_DATE")).otherwise(month_first))
    return F.when(text == "", F.struct(F.lit(None).cast("date").alias("parsed_date"), F.lit(False).alias("is_ambiguous"), F.lit("EMPTY").alias("warning"))).otherwise(named)


def day_gap(later: Column, earlier: Column) -> Column:
    """Signed days from ``earlier`` to ``later``."""
    return F.datediff(later, earlier)


def overdue_days(payment_date: Column, due_date: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(payment_date, due_date))


def temporal_check(issue: Column, due: Column) -> Column:
    """``struct(is_valid, warning)``: due on or after issue; a missing due date only warns."""
    inverted = F.coalesce(due < issue, F.lit(False))
    return F.struct(
        (~inverted).alias("is_valid"),
        F.when(inverted, F.lit("DUE_BEFORE_ISSUE"))
        .when(issue.isNotNull() & due.isNull(), F.lit("DUE_DATE_ABSENT")).alias("warning"),
    )
