"""Evidence normalisation, candidate scores and confidence bands. Row-local on evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens import vocab
from remitlens.config import ConfidencePolicy, ScoringWeights
from remitlens.functions.arrays import bind, first, last
from remitlens.operators.evidence import PAYMENT, count_class
from remitlens.operators.rows import compute_once
from remitlens.schemas import SCORE

RULE_VERSION, ALGORITHM_VERSION = "1.0.0", "14.10.0"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def _by_result(key: Column) -> Column:
    """Canonical result of an observed one, NULL when unknown."""
    groups: dict[str, list[str]] = {}
    for observed, result in vocab.EVIDENCE_RESULTS.items():
        groups.setdefault(result, []).append(observed)
    return F.coalesce(*[F.when(key.isin(observed), F.lit(result)) for result, observed in groups.items()])


def _canonical(i: Column) -> Column:
    """One item in the canonical vocabularies; ``error`` says why it cannot be."""
    # lambdas compute a name anew wherever it stands, so what is used several times is bound
    read = F.struct(F.upper(F.trim(i["observed_result"])).alias("observed"), F.lower(F.trim(i["source_field"])).alias("source"),
                    F.upper(F.trim(i["target_entity"])).alias("target"))
    return bind(read, lambda r: bind(_by_result(r["observed"]), lambda result: _in_vocabularies(i, r, result)))


def _in_vocabularies(i: Column, read: Column, result: Column) -> Column:
    kind, group = i["evidence_type"], i["classification"]
    observed, source, target = read["observed"], read["source"], read["target"]
    strength = (
        F.when(group.isin("MISSING", "CONFLICTING"), "NONE")
        .when((group == "DIRECT") & kind.isin(vocab.EXACT_STRENGTH_TYPES), "EXACT").when(group == "DIRECT", "HIGH")
        .when((group == "SUPPORTING") & (kind.isin(vocab.MEDIUM_STRENGTH_TYPES) | (observed == "MATCHED")), "MEDIUM")
        .when(group == "SUPPORTING", "LOW").otherwise("NONE"))
    bad = lambda c: F.coalesce(c, F.lit(True))
    error = (
        F.when(bad(~kind.isin(vocab.EVIDENCE_TYPES)), "UNSUPPORTED_EVIDENCE_TYPE")
        .when(result.isNull(), "UNSUPPORTED_OBSERVED_RESULT")
        .when((group == "CONFLICTING") & (result != "CONFLICT"), "CONFLICTING_CLASS_CONTRADICTS_RESULT")
        .when((group == "MISSING") & (result != "ABSENT"), "MISSING_CLASS_CONTRADICTS_RESULT")
        .when(bad(~target.isin(vocab.EVIDENCE_TARGETS)), "UNSUPPORTED_TARGET_ENTITY")
        .when(bad(F.trim(i["description"]) == ""), "EMPTY_DETAILS"))
    of = lambda t: F.when(kind == t, i["matched_value"])
    # the fields before details are the sort order
    return F.struct(
        group.alias("classification"), kind.alias("evidence_type"),
        F.when(source.isin(vocab.EVIDENCE_SOURCES), source).otherwise("unknown.source").alias("source"),
        target.alias("target_entity"), i["description"].alias("details"), result.alias("result"), strength.alias("strength"),
        i["matched_value"].alias("matched_value"), i["expected_value"].alias("expected_value"),
        of("PAYMENT_REFERENCE").alias("payment_reference"), of("UTR_IDENTIFIER").alias("utr"),
        of("BANK_ACCOUNT_IDENTIFIER").alias("bank_account"), i["days_difference"].alias("days_difference"),
        F.lit(RULE_VERSION).alias("rule_version"), F.lit(ALGORITHM_VERSION).alias("algorithm_version"), error.alias("error"))


def _valid(canonical: Column) -> Column:
    """Valid items without repeats, sorted by class, type, source, target, details."""
    return F.sort_array(F.array_distinct(F.filter(canonical, lambda n: n["error"].isNull())))


def normalize_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence in canonical vocabularies.

    Items that cannot be expressed in them are not dropped silently: they move to
    ``rejected_items`` with the reason.
    """
    def bundled(items: Column | str, change) -> Column:
        return F.transform(items, lambda b: F.struct(b["invoice_number"].alias("invoice_number"), b["invoice_id"].alias("invoice_id"), change(b["items"]).alias("items")))

    read = compute_once(evidence, {
        "payment_items": F.transform("payment_items", _canonical), "bundles": bundled("bundles", lambda items: F.transform(items, _canonical))})
    every = F.concat("payment_items", F.flatten(F.transform("bundles", lambda b: b["items"])))
    return compute_once(read, {
        "payment_items": _valid(F.col("payment_items")), "bundles": bundled("bundles", _valid),
        "rejected_items": F.filter(every, lambda n: n["error"].isNotNull()),
    }).select(*PAYMENT, "customer_id", "payment_items", "extracted_invoice_references", "has_conflicting_identifiers", "bundles", "rejected_items")


def normalized_rows(normalized: DataFrame) -> DataFrame:
    """Canonical items as rows; ``invoice_id`` is NULL for payment-level items."""
    id_type = normalized.schema["bundles"].dataType.elementType["invoice_id"].dataType
    paid = normalized.select(*PAYMENT, F.lit(None).cast(id_type).alias("invoice_id"), F.inline("payment_items"))
    bundled = normalized.select(*PAYMENT, F.inline("bundles")).select(*PAYMENT, "invoice_id", F.inline("items"))
    return paid.unionByName(bundled)


def with_items(evidence: DataFrame, extra: DataFrame) -> DataFrame:
    """Add items a caller brings: rows of (company, payment, invoice, <item columns>).

    Rows with a NULL invoice are payment-level. Meant for the evidence types nothing here
    emits (VPA, tax id, purchase order, set sums, payment history).
    """
    fields = ["evidence_type", "classification", "source_field", "observed_result", "description", "target_entity",
              "matched_value", "expected_value", "days_difference"]
    lists = extra.groupBy(*PAYMENT).agg(F.collect_list(F.struct("invoice_id", F.struct(*fields).alias("item"))).alias("_extra"))
    joined = evidence.join(lists, PAYMENT, "left").withColumn(
        "_extra", F.coalesce("_extra", F.array().cast(lists.schema["_extra"].dataType)))
    of = lambda keep: F.transform(F.filter("_extra", keep), lambda e: e["item"])
    return joined.withColumns({
        "payment_items": F.concat("payment_items", of(lambda e: e["invoice_id"].isNull())),
        "bundles": F.transform("bundles", lambda b: b.withField("items", F.concat(
            b["items"], of(lambda e: e["invoice_id"] == b["invoice_id"])))),
    }).drop("_extra")


def _contribution(test: Column, signal: str, weight, found: Column) -> Column:
    return F.when(test, F.struct(
        F.lit(signal).alias("signal_type"), F.lit(weight).cast(SCORE).alias("weight"),
        found["evidence_type"].alias("evidence_type"), found["source"].alias("source"), found["result"].alias("result"),
        found["target_entity"].alias("target_entity"), found["matched_value"].alias("matched_value"),
        found["expected_value"].alias("expected_value")))


def _conflicting(i: Column) -> Column:
    return (i["classification"] == "CONFLICTING") | (i["result"] == "CONFLICT")


def _kind(i: Column, *types: str) -> Column:
    return i["evidence_type"].isin(*types)


def _accounts(items: Column | str) -> Column:
    return F.filter(items, lambda i: _kind(i, "BANK_ACCOUNT_IDENTIFIER", "UPI_VPA_IDENTIFIER"))


def _paid_facts() -> dict[str, Column]:
    """What the payment's own items give to the score of every candidate."""
    paid = "payment_items"
    return {
        "_paid_accounts": _accounts(paid),
        "_paid_references": F.filter(paid, lambda i: _kind(i, "PAYMENT_REFERENCE")),
        "_by_narration": last(F.filter(paid, lambda i: _kind(i, "INVOICE_NUMBER_IN_NARRATION") & (i["result"] == "MATCH"))),
        "_name": first(F.filter(paid, lambda i: _kind(i, "CUSTOMER_NAME_TOKEN", "CUSTOMER_ALIAS") & (i["classification"] == "SUPPORTING") & (i["result"] == "MATCH"))),
    }


def _score(b: Column, weights: ScoringWeights) -> Column:
    """Contributions of one bundle: every dimension counts once, and not at all when in conflict. Each fact is bound, as several fields use it."""
    own = b["items"]
    refs = lambda: F.filter(own, lambda i: _kind(i, "INVOICE_NUMBER_IN_NARRATION", "PAYMENT_REFERENCE"))
    known = F.struct(F.upper(F.trim(b["invoice_number"])).alias("number"), F.concat("_paid_accounts", _accounts(own)).alias("accounts"), refs().alias("refs"))
    return bind(known, lambda k: bind(_found_in(own, k), lambda f: _contributions(f, weights)))


def _found_in(own: Column, known: Column) -> Column:
    """The items that speak for each dimension of the score, NULL where none does or a conflict speaks against it."""
    number, accounts, refs = known["number"], known["accounts"], known["refs"]
    account = last(F.filter(accounts, lambda i: (i["classification"] == "DIRECT") & (i["result"] == "MATCH")))
    named = first(F.filter(refs, lambda i: ~_conflicting(i) & (
        (i["classification"] == "DIRECT") | i["result"].isin("MATCH", "PRESENT")) & (F.upper(F.trim(i["matched_value"])) == number)))
    by_reference = last(F.filter("_paid_references", lambda i: F.upper(F.trim(i["matched_value"])) == number))
    # a named conflict leaves no points for the number, whatever else there is
    evidence = F.when(~F.exists(refs, _conflicting), bind(named, lambda n: F.when(
        F.array_contains("extracted_invoice_references", number), F.coalesce(by_reference, n, F.col("_by_narration"))).otherwise(n)))
    amount = last(F.filter(own, lambda i: _kind(i, "AMOUNT_EXACT_EQUALITY") & (i["classification"] == "DIRECT") & (i["result"] == "MATCH")))
    near = last(F.filter(own, lambda i: _kind(i, "DATE_PROXIMITY") & (i["classification"] == "SUPPORTING") & (i["result"] == "SUPPORTED")))
    history = first(F.filter(own, lambda i: _kind(i, "HISTORICAL_CUSTOMER_PATTERN") & (i["classification"] == "SUPPORTING") & i["result"].isin("MATCH", "SUPPORTED")))
    return F.struct(
        F.when(~F.exists(accounts, _conflicting), account).alias("account"), evidence.alias("evidence"),
        F.when(~F.exists(own, lambda i: _kind(i, "CURRENCY_CONSISTENCY") & _conflicting(i)), amount).alias("amount"),
        F.when(~F.exists(own, lambda i: _kind(i, "DATE_CAUSALITY") & _conflicting(i)), near).alias("near"), history.alias("history"))


def _contributions(found: Column, weights: ScoringWeights) -> Column:
    evidence, name = found["evidence"], F.col("_name")
    # points need an item whose type and origin belong together
    sound = ((evidence["evidence_type"] == "PAYMENT_REFERENCE") & (evidence["source"] == "payment.payment_reference")) | (
        (evidence["evidence_type"] == "INVOICE_NUMBER_IN_NARRATION") & (evidence["source"] == "payment.narration"))
    return F.array_compact(F.array(
        _contribution(found["account"].isNotNull(), "IDENTIFIER_MATCH", weights.identifier_match, found["account"]),
        _contribution(evidence.isNotNull() & sound, "INVOICE_NUMBER_MATCH", weights.invoice_number_match, evidence),
        _contribution(found["amount"].isNotNull(), "AMOUNT_EXACT_MATCH", weights.amount_exact_match, found["amount"]),
        _contribution(name.isNotNull(), "CUSTOMER_NAME_MATCH", weights.customer_name_match, name),
        _contribution(found["near"].isNotNull(), "DATE_PROXIMITY_MATCH", weights.date_proximity_match, found["near"]),
        _contribution(found["history"].isNotNull(), "HISTORICAL_PATTERN", weights.historical_pattern, found["history"]),
    ))


def score_candidates(normalized: DataFrame, weights: ScoringWeights = ScoringWeights()) -> DataFrame:
    """One scored row per (payment, candidate), ranked by score, number, id."""
    wide = "decimal(7,2)"
    bundles = F.transform("bundles", lambda b: F.struct(
        b["invoice_number"].alias("invoice_number"), b["invoice_id"].alias("invoice_id"), _score(b, weights).alias("contributions"),
        *[count_class(b["items"], c).alias(c.lower()) for c in ("DIRECT", "SUPPORTING", "MISSING", "CONFLICTING")]))
    raw = lambda b: F.aggregate(b["contributions"], F.lit(0).cast(wide), lambda s, c: (s + c["weight"]).cast(wide))
    scored = F.transform("_bundles", lambda b: bind(raw(b), lambda points: F.struct(
        (-F.least(F.lit(weights.max_score).cast(wide), points)).alias("_key"), b["invoice_number"].alias("invoice_number"),
        b["invoice_id"].alias("invoice_id"), points.alias("raw_score"), b["contributions"].alias("contributions"),
        b["direct"].alias("direct"), b["supporting"].alias("supporting"), b["missing"].alias("missing"), b["conflicting"].alias("conflicting"))))
    ranked = compute_once(compute_once(compute_once(normalized, _paid_facts()), {"_bundles": bundles}), {"_scored": F.sort_array(scored)})
    rows = ranked.select(*PAYMENT, "customer_id", "has_conflicting_identifiers", F.posexplode("_scored"))
    return rows.select(
        *PAYMENT, "customer_id", "col.invoice_id", "col.invoice_number", (F.col("pos") + 1).alias("rank"),
        F.least(F.lit(weights.max_score).cast(wide), F.col("col.raw_score")).cast(SCORE).alias("total_score"),
        F.col("col.raw_score").alias("raw_unclamped_score"), "col.contributions",
        ((F.col("col.conflicting") > 0) | F.col("has_conflicting_identifiers")).alias("has_conflicting_evidence"),
        F.col("col.direct").alias("direct_count"), F.col("col.missing").alias("missing_count"),
        F.lit(weights.rule_version).alias("rule_version"), F.lit(weights.algorithm_version).alias("algorithm_version"))


def assess_confidence(scores: DataFrame, policy: ConfidencePolicy = ConfidencePolicy()) -> DataFrame:
    """Confidence of every scored candidate: the score itself, a band, and what was observed.

    ``has_direct_evidence`` counts any direct item of the candidate. Nothing is added to or taken
    from the score. Scores are ranked already; clamping keeps their order.
    """
    score = F.greatest(F.lit(policy.min_confidence), F.least(F.lit(policy.max_confidence), F.col("total_score"))).cast(SCORE)
    level = (
        F.when(score >= F.lit(policy.very_high), "VERY_HIGH").when(score >= F.lit(policy.high), "HIGH")
        .when(score >= F.lit(policy.medium), "MEDIUM").when(score > 0, "LOW").otherwise("NONE"))
    direct, missing = F.col("direct_count") > 0, F.col("missing_count") > 0
    factors = F.array_compact(F.array(
        F.lit("BASE_MATCH_SCORE"), F.when(direct, F.lit("DIRECT_IDENTIFIER_GROUNDING")),
        F.when(F.col("has_conflicting_evidence"), F.lit("CONFLICT_OBSERVED")), F.when(missing, F.lit("INCOMPLETE_EVIDENCE_OBSERVED"))))
    return scores.select(
        *PAYMENT, "customer_id", "invoice_id", "invoice_number", "rank", score.alias("confidence_score"), level.alias("confidence_level"),
        F.col("total_score").alias("base_match_score"), direct.alias("has_direct_evidence"), "has_conflicting_evidence",
        missing.alias("has_incomplete_evidence"), factors.alias("factors"),
        F.lit(policy.rule_version).alias("rule_version"), F.col("algorithm_version").alias("scoring_algorithm_version"),
        F.lit(policy.algorithm_version).alias("confidence_algorithm_version"), F.lit(False).alias("is_statistically_calibrated"))
