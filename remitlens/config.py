"""Knobs of the operators: frozen dataclasses, checked on construction, used as literals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

ZERO = Decimal("0.00")


class PolicyError(ValueError):
    """A policy holds a value the rules do not allow."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise PolicyError(message)


@dataclass(frozen=True)
class IntakePolicy:
    """``as_of`` gives the strict date test; without it ``today`` + ``forward_days`` is the limit.

    ``today`` defaults to the session's current date; pass it to make runs repeatable.
    """

    as_of: date | None = None
    today: date | None = None
    forward_days: int = 30


@dataclass(frozen=True)
class ReadLimits:
    """Bounds on what is read from files and kept of it. By default there are none; ``RULE_LIMITS`` has those of the rules.

    A file over ``max_file_bytes`` is refused with a reason. The header must be among the first ``header_scan_lines`` lines,
    a document's dates are its first ``document_dates``, ``stored_text`` characters of its text are kept, and storage keys keep
    ``stem_chars`` and ``extension_chars`` of the file's name.
    """

    max_file_bytes: int | None = None
    header_scan_lines: int | None = None
    document_dates: int | None = None
    stored_text: int | None = None
    stem_chars: int | None = None
    extension_chars: int | None = None


NO_LIMITS = ReadLimits()
RULE_LIMITS = ReadLimits(max_file_bytes=10 * 1024 * 1024, header_scan_lines=20, document_dates=5, stored_text=500, stem_chars=64, extension_chars=10)


@dataclass(frozen=True)
class PayerPolicy:
    """``hot_owners``: a word that more customers of a company have is hot; it finds customers for the ranking of the best two without pairing
    each payment that says it with every customer (None: always pair)."""

    ambiguity_delta: Decimal = Decimal("15.00")
    identified_score: Decimal = Decimal("70.00")
    viable_score: Decimal = Decimal("30.00")
    hot_owners: int | None = 1_000


#: candidates per payment in the rules' service
RULE_BOUND = 30


@dataclass(frozen=True)
class CandidateLimit:
    """At most ``limit`` candidates per payment, all of them by default; the rules' service takes ``RULE_BOUND``."""

    limit: int | None = None

    def __post_init__(self) -> None:
        _require(self.limit is None or 1 <= self.limit <= 100, "candidate limit must be between 1 and 100")


@dataclass(frozen=True)
class CandidateFilterCriteria:
    """The gates. ``max_candidates`` bounds what passes them; None, the default, keeps all. What a bound left out is counted by the result."""

    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    max_lookback_days: int | None = 365
    max_advance_days: int = 0
    require_causality: bool = True
    allowed_statuses: tuple[str, ...] = ("PENDING", "PARTIALLY_PAID")
    require_reference_match: bool = False
    disallow_overpayment: bool = False
    allow_expired_debt_with_reference: bool = True
    max_candidates: int | None = None

    def __post_init__(self) -> None:
        _require(self.min_amount is None or self.min_amount >= ZERO, "min_amount must not be negative")
        _require(self.max_amount is None or self.max_amount >= ZERO, "max_amount must not be negative")
        if self.min_amount is not None and self.max_amount is not None:
            _require(self.min_amount <= self.max_amount, "min_amount must not exceed max_amount")
        _require(self.max_candidates is None or 1 <= self.max_candidates <= 100, "max_candidates must be between 1 and 100")
        _require(self.max_advance_days >= 0, "max_advance_days must not be negative")


@dataclass(frozen=True)
class _MatchCriteria:
    amount_tolerance: Decimal = ZERO
    require_exact_currency: bool = True
    date_proximity_days: int = 30

    def __post_init__(self) -> None:
        _require(self.amount_tolerance >= ZERO, "amount_tolerance must not be negative")
        _require(self.date_proximity_days >= 0, "date_proximity_days must not be negative")


@dataclass(frozen=True)
class ExactMatchCriteria(_MatchCriteria):
    pass


@dataclass(frozen=True)
class PartialMatchCriteria(_MatchCriteria):
    """``amount_tolerance`` is accepted and has no effect, as in the rules."""


#: invoices in a set, where the rules' own limit is asked for
RULE_SET_SIZE = 4


@dataclass(frozen=True)
class _SetCriteria(_MatchCriteria):
    """``max_combination_size`` bounds how many invoices a set may have (None: any number). Sets are always counted in full; a payment with
    more than ``max_listed`` (None: no bound) carries the count and, where the rules prefer one set, that set, but not the whole list."""

    max_combination_size: int | None = None
    max_listed: int | None = 1_000

    def __post_init__(self) -> None:
        super().__post_init__()
        _require(self.max_combination_size is None or self.max_combination_size >= 2, "max_combination_size must be at least 2")
        _require(self.max_listed is None or self.max_listed >= 1, "max_listed must be at least 1")


@dataclass(frozen=True)
class MultiInvoiceMatchCriteria(_SetCriteria):
    """Only sums equal to the payment can ever be a match, so a tolerance changes nothing."""


@dataclass(frozen=True)
class CombinationMatchCriteria(_SetCriteria):
    enable_fifo_aging: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        _require(self.amount_tolerance == ZERO, "amount_tolerance must be zero for combinations")


@dataclass(frozen=True)
class ScoringWeights:
    identifier_match: Decimal = Decimal("40.00")
    invoice_number_match: Decimal = Decimal("35.00")
    amount_exact_match: Decimal = Decimal("30.00")
    customer_name_match: Decimal = Decimal("20.00")
    date_proximity_match: Decimal = Decimal("10.00")
    historical_pattern: Decimal = Decimal("5.00")
    max_score: Decimal = Decimal("100.00")
    rule_version: str = "1.0.0"
    algorithm_version: str = "14.11.0"

    def __post_init__(self) -> None:
        _require(ZERO < self.max_score <= Decimal("100.00"), "max_score must be in (0, 100]")
        for name in ("identifier_match", "invoice_number_match", "amount_exact_match",
                     "customer_name_match", "date_proximity_match", "historical_pattern"):
            _require(getattr(self, name) >= ZERO, f"{name} must not be negative")


@dataclass(frozen=True)
class ConfidencePolicy:
    max_confidence: Decimal = Decimal("100.00")
    min_confidence: Decimal = ZERO
    very_high: Decimal = Decimal("90.00")
    high: Decimal = Decimal("70.00")
    medium: Decimal = Decimal("40.00")
    rule_version: str = "1.0.0"
    algorithm_version: str = "14.12.0"

    def __post_init__(self) -> None:
        _require(self.max_confidence > ZERO, "max_confidence must be positive")
        _require(self.min_confidence >= ZERO, "min_confidence must not be negative")
        _require(self.very_high > self.high > self.medium, "bands must rise strictly")


@dataclass(frozen=True)
class SkewPolicy:
    """When a join key counts as hot, and so gets split.

    A key is hot when it holds more than ``max(min_rows, rows / max_keys)`` rows of its table. At
    most ``max_keys`` keys can pass that test, so the table of hot keys is safe to broadcast at
    any table size.
    """

    min_rows: int = 50_000
    max_keys: int = 10_000
