"""The whole reconciliation of a table of payments.

Payments -> intake -> payer -> candidates and gates -> matching, evidence, score, confidence.
The two steps that several later ones read, the identified payments and the filtered universe, are
cut off from what made them (see ``cut_lineage``), so each runs once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.config import (
    RULE_BOUND, CandidateFilterCriteria, CombinationMatchCriteria, ConfidencePolicy, ExactMatchCriteria, IntakePolicy,
    MultiInvoiceMatchCriteria, PartialMatchCriteria, PayerPolicy, ScoringWeights, SkewPolicy,
)
from remitlens.operators import candidates, evidence, intake, matching, multi, payer, scoring
from remitlens.operators.candidates import PAYMENT
from remitlens.session import cut_lineage


@dataclass(frozen=True)
class ReconcilePolicy:
    intake: IntakePolicy = field(default_factory=IntakePolicy)
    payer: PayerPolicy = field(default_factory=PayerPolicy)
    # the search for sets of invoices is over a payment's candidates, so the whole run bounds them as the rules do
    filter: CandidateFilterCriteria = field(default_factory=lambda: CandidateFilterCriteria(max_candidates=RULE_BOUND))
    exact: ExactMatchCriteria = field(default_factory=ExactMatchCriteria)
    partial: PartialMatchCriteria = field(default_factory=PartialMatchCriteria)
    multi: MultiInvoiceMatchCriteria = field(default_factory=MultiInvoiceMatchCriteria)
    combination: CombinationMatchCriteria = field(default_factory=CombinationMatchCriteria)
    scoring: ScoringWeights = field(default_factory=ScoringWeights)
    confidence: ConfidencePolicy = field(default_factory=ConfidencePolicy)
    skew: SkewPolicy = field(default_factory=SkewPolicy)


class Reconciliation:
    """Results of one run; each property is a DataFrame over all payments."""

    def __init__(self, payments: DataFrame, customers: DataFrame, aliases: DataFrame, identifiers: DataFrame, invoices: DataFrame,
                 policy: ReconcilePolicy = ReconcilePolicy(), overrides: DataFrame | None = None, durable: bool = True) -> None:
        self.policy, self.invoices = policy, invoices
        keep = cut_lineage if durable else (lambda df: df)
        self.customers = payer.customer_context(customers, aliases, identifiers)
        judged = intake.evaluate_intake(payments, policy.intake)
        identified = payer.identify_payers(judged, self.customers, policy.payer, durable=durable)
        if overrides is not None:
            identified = payer.apply_overrides(identified, overrides, customers)
        self.identified = keep(identified)
        self.resolved = candidates.resolved_payments(self.identified)
        self.universe = keep(candidates.filter_candidates(self.resolved, invoices, policy.filter, policy.skew, policy.exact.amount_tolerance))

    @property
    def exact(self) -> DataFrame:
        return matching.match_exact(self.universe, self.policy.exact)

    @property
    def partial(self) -> DataFrame:
        return matching.match_partial(self.universe, self.policy.partial)

    @property
    def multi(self) -> DataFrame:
        return multi.match_multi_invoice(self.universe, self.policy.multi)

    @property
    def combination(self) -> DataFrame:
        return multi.match_combination(self.universe, self.policy.combination)

    @property
    def evidence(self) -> DataFrame:
        return evidence.collect_evidence(self.identified, self.universe, self.customers)

    @property
    def normalized(self) -> DataFrame:
        return scoring.normalize_evidence(self.evidence)

    @property
    def scores(self) -> DataFrame:
        return scoring.score_candidates(self.normalized, self.policy.scoring)

    @property
    def confidence(self) -> DataFrame:
        return scoring.assess_confidence(self.scores, self.policy.confidence)

    @property
    def results(self) -> DataFrame:
        """One row per payment: its customer, the status and reason of each kind of match, and the best candidate with its confidence."""
        policy, rows = self.policy, self.universe
        verdicts = []
        # one pass: each kind of match adds its verdict to the rows it was given
        for name, match, criteria in (("exact", matching.match_exact, policy.exact), ("partial", matching.match_partial, policy.partial),
                                      ("multi", multi.match_multi_invoice, policy.multi), ("combination", multi.match_combination, policy.combination)):
            given = [c for c in rows.columns if c not in (*PAYMENT, "customer_id")]
            found = match(rows, criteria, given)
            verdicts += [f"{name}_status", f"{name}_reason"]
            rows = found.select(*PAYMENT, "customer_id", *given, F.col("status").alias(verdicts[-2]), F.col("reason_code").alias(verdicts[-1]))
        best = self.confidence.where("rank = 1").select(*PAYMENT, "invoice_id", "confidence_score", "confidence_level")
        return rows.select(*PAYMENT, "customer_id", *verdicts).join(best, PAYMENT, "left")
