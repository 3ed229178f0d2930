"""Payer identification: which customer sent a payment.

The rules compare every payment with every customer. Here both sides are turned into comparable
keys (account or VPA, alias, legal name, tax id) and meet in one equi-join on
(company, kind of key, key). Word overlap goes by an index of the rarest words of each customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitlens import vocab
from remitlens.config import PayerPolicy, SkewPolicy
from remitlens.functions import text as X
from remitlens.functions.arrays import first
from remitlens.operators.rows import compute_once
from remitlens.operators.skew import grid
from remitlens.schemas import SCORE
from remitlens.session import cut_lineage

PAYMENT = ["company_id", "payment_id"]
COORDINATES = ["EXACT_BANK_ACCOUNT", "EXACT_UPI_VPA", "EXACT_VIRTUAL_ACCOUNT"]
NAMES = ["EXACT_ALIAS", "NORMALIZED_LEGAL_NAME"]
SIGNAL_FIELDS = ["evidence_type", "signal_strength", "matched_value", "source_field", "weight"]
# order in which one customer's signals are listed
SIGNAL_ORDER = {"COORDINATE": 1, "ALIAS": 2, "LEGAL": 3, "TAX": 5, "TOKENS": 6}


def customer_context(customers: DataFrame, aliases: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Customers with their aliases and active identifiers as sorted arrays.

    An array holds what one customer registered, so it stays small.
    """
    key = ["company_id", "customer_id"]
    names = aliases.groupBy(*key).agg(F.array_sort(F.collect_list("alias_name")).alias("aliases"))
    accounts = identifiers.where("is_active").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("identifier_type", "identifier_value"))).alias("identifiers"))
    return customers.join(names, key, "left").join(accounts, key, "left").withColumns({
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
        "identifiers": F.coalesce(
            "identifiers", F.array().cast("array<struct<identifier_type:string,identifier_value:string>>")),
    })


def payment_keys(payments: DataFrame) -> DataFrame:
    """(company, payment, kind, key, source) of every eligible payment, one row per distinct key.

    Coordinates are listed in order of precedence, so the first source that holds a value wins.
    """
    vpas = F.transform(X.extract_vpas(F.col("narration")), X.normalize_identifier)
    accounts = F.transform(X.extract_accounts(F.col("narration")), X.normalize_identifier)

    def coordinate(value: Column, source: str) -> Column:
        return F.struct(F.lit("COORDINATE").alias("kind"), value.alias("key"), F.lit(source).alias("source_field"))

    def single(kind: str, value: Column, source: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"), F.lit(source).alias("source_field"))

    cleaned = compute_once(
        payments.select(*PAYMENT, "payer_raw_name", "payer_raw_identifier", "bank_account_number", "payment_reference", "narration"),
        {
            "_name": X.clean_text(F.col("payer_raw_name")), "_payer": X.normalize_identifier(F.col("payer_raw_identifier")),
            "_account": X.normalize_identifier(F.col("bank_account_number")),
            "_reference": X.normalize_identifier(F.col("payment_reference")), "_vpas": vpas, "_accounts": accounts,
        })
    listed = F.concat(
        F.array(coordinate(F.col("_payer"), "payer_raw_identifier"), coordinate(F.col("_account"), "bank_account_number")),
        F.transform("_vpas", lambda v: coordinate(v, "narration_extracted_vpa")),
        F.transform("_accounts", lambda a: coordinate(a, "narration_extracted_account")),
        F.array(
            single("ALIAS", F.col("_name"), "payer_raw_name"),
            single("LEGAL", X.strip_legal_suffix(F.col("_name")), "payer_raw_name"),
            single("TAX", F.col("_reference"), "payment_reference"),
        ),
    )
    # keep the first entry of each (kind, key)
    keyed = compute_once(cleaned.select(*PAYMENT, "_name", "_payer", "_account", "_reference", "_vpas", "_accounts"),
                         {"_keys": F.filter(listed, lambda k: k["key"] != "")})
    keyed = compute_once(keyed, {"_ids": F.transform("_keys", lambda k: k.dropFields("source_field"))})
    unique = F.filter("_keys", lambda k, i: F.array_position("_ids", k.dropFields("source_field")) == i + 1)
    return keyed.select(*PAYMENT, F.inline(unique))


def customer_keys(customers: DataFrame) -> DataFrame:
    """(company, kind, key, customer, ...) of every active customer: the index payments look into."""
    context = customers.where(~F.col("is_archived"))
    tax = X.normalize_identifier(F.col("tax_id"))
    usable_tax = (F.length(tax) >= 5) & ~F.upper(tax).isin(vocab.TAX_ID_PLACEHOLDERS)

    def entry(kind: str, key: Column, value: Column, id_type: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), key.alias("key"), value.alias("matched_value"),
            (F.lit(None).cast("string") if id_type is None else id_type).alias("identifier_type"))

    # aliases come sorted; of two that clean to the same text only the first is kept
    cleaned_aliases = F.transform("aliases", X.clean_text)
    aliases = F.filter(
        F.transform("aliases", lambda a: entry("ALIAS", X.clean_text(a), a)),
        lambda e, i: F.array_position("_aliases", e["key"]) == i + 1)
    listed = F.concat(
        F.transform("identifiers", lambda i: entry(
            "COORDINATE", X.normalize_identifier(i["identifier_value"]), i["identifier_value"], i["identifier_type"])),
        aliases,
        F.array(
            entry("LEGAL", X.legal_name(F.col("name")), F.col("name")),
            entry("TAX", F.when(usable_tax, tax).otherwise(""), F.coalesce("tax_id", F.lit(""))),
        ),
    )
    return compute_once(context, {"_aliases": cleaned_aliases}).select(
        "company_id", "customer_id", F.col("name").alias("customer_name"),
        F.inline(F.filter(listed, lambda k: k["key"] != "")))


def key_signals(payments: DataFrame, customers: DataFrame) -> DataFrame:
    """Signals from equal keys: coordinates 100 / 95, alias 85, legal name 75, tax id 50.

    Equal cleaned names always have equal legal names, so the separate 70-point cleaned-name
    signal of the rules can never fire and has no join here.
    """
    found = payment_keys(payments).join(customer_keys(customers), ["company_id", "kind", "key"])
    source, id_type = F.col("source_field"), F.col("identifier_type")
    evidence = (
        F.when(F.col("kind") == "ALIAS", "EXACT_ALIAS")
        .when(F.col("kind") == "LEGAL", "NORMALIZED_LEGAL_NAME")
        .when(F.col("kind") == "TAX", "REFERENCE_MATCH")
        .when(source == "narration_extracted_vpa", "EXACT_UPI_VPA")
        .when(source == "narration_extracted_account", "EXACT_BANK_ACCOUNT")
        .when(id_type == "VIRTUAL_ACCOUNT", "EXACT_VIRTUAL_ACCOUNT")
        .when((source == "payer_raw_identifier") & (F.contains("matched_value", F.lit("@")) | (id_type == "UPI_VPA")),
              "EXACT_UPI_VPA")
        .otherwise("EXACT_BANK_ACCOUNT")
    )
    weight = (
        F.when(F.col("kind") == "ALIAS", 85).when(F.col("kind") == "LEGAL", 75).when(F.col("kind") == "TAX", 50)
        .when(source.startswith("narration"), 95).otherwise(100).cast(SCORE)
    )
    return found.select(
        *PAYMENT, "customer_id", "customer_name", "kind", "key", evidence.alias("evidence_type"),
        F.when(F.col("kind").isin("COORDINATE", "ALIAS"), "STRONG").otherwise("MEDIUM").alias("signal_strength"),
        "matched_value", "source_field", weight.alias("weight"),
    )


def _word_index(customers: DataFrame, hot_owners: int | None) -> DataFrame:
    """(company, ``token``) of the words under which a customer must be looked for, with its name and all its words, the rarest first.

    How rare a word is, is how many customers of the company have it. With ``hot_owners``, a word that more customers have counts as hot, and of
    customers alike in number of words and hot words only the first two by name are kept under their hot words.
    """
    key = ["company_id", "customer_id"]
    named = customers.where(~F.col("is_archived")).select(*key, F.col("name").alias("customer_name"), "aliases")
    words = compute_once(named, {"_token": X.tokens(F.concat_ws(" ", F.col("customer_name"), F.array_join("aliases", " ")))}).drop("aliases")
    each = words.withColumn("token", F.explode("_token")).drop("_token")
    owners = each.groupBy("company_id", "token").agg(F.count("*").alias("_owners"))
    # a word that very many customers have is one row of owners; the split of skewed joins deals with their side
    ordered = each.join(owners, ["company_id", "token"]).groupBy(*key, "customer_name").agg(F.array_sort(F.collect_list(F.struct("_owners", "token"))).alias("_ranked"))
    needed = F.ceil(F.size("_ranked") * F.lit(3) / F.lit(10)).cast("int")
    index = ordered.select(*key, "customer_name", F.transform("_ranked", lambda r: r["token"]).alias("_words"), F.slice("_ranked", F.lit(1), F.size("_ranked") - needed + 1).alias("_under"),
                           F.filter("_ranked", lambda r: r["_owners"] > (hot_owners or 0)).alias("_hot"))
    if hot_owners is not None:
        # rows beyond the second of a kind fall away before anything is shuffled
        alike = W.partitionBy("company_id", F.size("_words"), F.transform("_hot", lambda r: r["token"])).orderBy("customer_name", "customer_id")
        rare = index.withColumn("_under", F.filter("_under", lambda r: r["_owners"] <= hot_owners))
        common = index.withColumn("_under", F.filter("_under", lambda r: r["_owners"] > hot_owners)).where(F.size("_under") > 0)
        index = rare.unionByName(common.withColumn("_nth", F.row_number().over(alike)).where("_nth <= 2").drop("_nth"))
    return index.select(*key, "customer_name", "_words", F.explode(F.transform("_under", lambda r: r["token"])).alias("token"))


def token_signals(payments: DataFrame, customers: DataFrame, hot_owners: int | None = None, skew: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Word overlap of payment text and customer names: at least 30 % of the customer's words.

    An inverted index over customer words with prefix filtering: a customer with ``n`` words needs ``ceil(0.3 n)`` of them in the payment, so, words
    being taken rarest first, one of its first ``n - ceil(0.3 n) + 1`` must be there. Only those are indexed. A pair that meets on several indexed
    words is kept on the first, so the join needs no distinct after it. Words that many payments or customers have are cut into a grid of cells.

    By default all customers of a payment come out. With ``hot_owners`` the best two of each payment are among those that come out, and a word
    that more customers than that share makes no pairs of everyone with everyone: customers whom a payment names by such words alone score by
    their number of words and hot words only, so of customers alike in both the first two by name stand for all. (Any of them that shares a rarer
    word too is found under that one, with a higher score.)
    """
    index = _word_index(customers, hot_owners)
    paid = compute_once(payments.select(*PAYMENT, "payer_raw_name", "narration"), {"_text": X.tokens(F.concat_ws(
        " ", F.coalesce("payer_raw_name", F.lit("")), F.coalesce("narration", F.lit(""))))}).drop("payer_raw_name", "narration")
    keys = ["company_id", "token"]
    left, right = grid(paid.withColumn("token", F.explode("_text")), index, keys, "payment_id", "customer_id", skew)
    met = left.join(right, [*keys, "_l", "_r"])
    shared = F.array_intersect("_words", "_text")
    ratio = F.size("_shared") / F.size("_words")
    hits = compute_once(met, {"_shared": shared}).where(
        (F.col("token") == first("_shared"))
        & (F.size("_shared") * 10 >= F.size("_words") * 3)
        & ((F.size("_shared") >= 2) | F.exists("_shared", lambda w: F.length(w) >= 5))
    )
    points = F.least(F.lit(45).cast("decimal(12,6)"), (20 + 25 * ratio).cast("decimal(12,6)"))
    return hits.select(
        *PAYMENT, "customer_id", "customer_name", F.lit("TOKENS").alias("kind"), F.lit("").alias("key"),
        F.lit("NARRATION_TOKEN_OVERLAP").alias("evidence_type"), F.lit("WEAK").alias("signal_strength"),
        F.array_join(F.array_sort("_shared"), " ").alias("matched_value"), F.lit("narration").alias("source_field"),
        F.bround(points, 2).cast(SCORE).alias("weight"),
    )


def payer_signals(payments: DataFrame, customers: DataFrame, durable: bool = False, hot_owners: int | None = None) -> DataFrame:
    """All signals of eligible payments, one row per (payment, customer, signal).

    Words count for every payment, so the candidate lists are complete under any policy (with ``hot_owners``: the best two); only a customer
    that a payment names by a strong key gets no word signal from it. The key signals are read twice for that;
    ``durable`` writes them out in between, so that the keys are extracted and joined once.
    """
    eligible = payments.where("is_eligible")
    keys = key_signals(eligible, customers)
    if durable:
        keys = cut_lineage(keys)
    strong = keys.where(F.col("kind") != "TAX").select(*PAYMENT, "customer_id").distinct()
    words = token_signals(eligible, customers, hot_owners).join(strong, [*PAYMENT, "customer_id"], "left_anti")
    return keys.unionByName(words)


def payer_candidates(signals: DataFrame) -> DataFrame:
    """One scored row per (payment, customer), without ranks.

    Score: the best weight plus 5 % of the others, at most 100.
    """
    best, total = F.max("weight"), F.sum("weight")
    score = F.least(F.lit(100).cast(SCORE), F.bround((best + (total - best) * F.lit(0.05).cast("decimal(3,2)")), 2).cast(SCORE))
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in SIGNAL_ORDER.items()])
    # signals arrive spread by key; one exchange by payment serves this and every later step
    by_payment = signals.repartition(*PAYMENT)
    return by_payment.groupBy(*PAYMENT, "customer_id", "customer_name").agg(
        score.alias("composite_score"),
        F.collect_set(F.when(F.col("kind") == "COORDINATE", F.col("key"))).alias("coordinates"),
        F.max(F.col("evidence_type").isin(NAMES)).alias("has_name"),
        F.array_sort(F.collect_list(F.struct(order.alias("position"), *SIGNAL_FIELDS))).alias("signals"),
    )


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Rank by score, then name, then id."""
    order = W.partitionBy(*PAYMENT).orderBy(F.col("composite_score").desc(), "customer_name", "customer_id")
    return candidates.withColumn("rank", F.row_number().over(order))


def identify_payers(
    payments: DataFrame, customers: DataFrame, policy: PayerPolicy = PayerPolicy(), durable: bool = False,
) -> DataFrame:
    """Identify the payer of every payment of ``evaluate_intake``.

    ``customers`` is a ``customer_context``. Adds ``payer_status``, ``payer_reason``,
    ``customer_id`` (only when IDENTIFIED), ``payer_score``, and the names and scores of
    the two best candidates. Only those two decide, so ranking stops there.
    """
    ranked = rank_candidates(payer_candidates(payer_signals(payments, customers, durable, policy.hot_owners)))
    top = ranked.where("rank <= 2")

    def of(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    best = top.groupBy(*PAYMENT).agg(*[
        of(rank, column).alias(f"_{column}{rank}")
        for rank in (1, 2)
        for column in ("customer_id", "customer_name", "composite_score", "coordinates", "has_name")
    ])
    direct1, direct2 = F.size("_coordinates1") > 0, F.size("_coordinates2") > 0
    conflict_direct = direct1 & direct2 & ~F.arrays_overlap("_coordinates1", "_coordinates2")
    conflict_name = direct1 & F.col("_has_name2") & (F.col("_composite_score2") >= F.lit(policy.identified_score))
    one, two = F.col("_composite_score1"), F.col("_composite_score2")
    close = (one - two) < F.lit(policy.ambiguity_delta)
    active = customers.where(~F.col("is_archived")).select("company_id").distinct().withColumn("_active", F.lit(True))

    def verdict(status: str, reason: str | Column) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    outcome = (
        F.when(~F.col("is_eligible"), verdict("NOT_ELIGIBLE", F.col("intake_reason")))
        .when(F.col("_active").isNull(), verdict("UNKNOWN", "NO_ACTIVE_CUSTOMERS_CONFIGURED"))
        .when(one.isNull(), verdict("UNKNOWN", "NO_RECOGNIZABLE_COUNTERPARTY_EVIDENCE"))
        .when(conflict_direct, verdict("CONFLICTING", "CONFLICTING_DIRECT_IDENTIFIERS"))
        .when(conflict_name, verdict("CONFLICTING", "CONFLICTING_COORDINATE_AND_NAME"))
        .when(one < F.lit(policy.viable_score), verdict("UNKNOWN", "INSUFFICIENT_EVIDENCE_SCORE"))
        .when(one < F.lit(policy.identified_score), verdict("AMBIGUOUS", "LOW_CONFIDENCE_COUNTERPARTY_MATCH"))
        .when(close, verdict("AMBIGUOUS", "CLOSE_SCORE_COUNTERPARTY_AMBIGUITY"))
        .otherwise(verdict("IDENTIFIED", "DETERMINISTIC_COUNTERPARTY_IDENTIFIED"))
    )
    decided = payments.join(best, PAYMENT, "left").join(active, "company_id", "left").withColumn("_outcome", outcome)
    no_score = F.col("_outcome.status").isin("NOT_ELIGIBLE", "CONFLICTING") | one.isNull()
    return decided.withColumns({
        "payer_status": F.col("_outcome.status"),
        "payer_reason": F.col("_outcome.reason"),
        "customer_id": F.when(F.col("_outcome.status") == "IDENTIFIED", F.col("_customer_id1")),
        "payer_score": F.when(no_score, F.lit(0).cast(SCORE)).otherwise(one),
        "top_customer": F.col("_customer_name1"), "top_score": one,
        "runner_up": F.col("_customer_name2"), "runner_up_score": two,
    }).drop("_outcome", "_active", *[c for c in best.columns if c.startswith("_")])


def apply_overrides(identified: DataFrame, overrides: DataFrame, customers: DataFrame) -> DataFrame:
    """Use the customer a person named for a payment (company_id, payment_id, customer_id).

    The customer must belong to the payment's company, else the override is ignored and
    ``override_status`` says so. An archived customer is accepted here and gated later.
    """
    named = overrides.select(*PAYMENT, F.col("customer_id").alias("_named"))
    known = customers.select("company_id", F.col("customer_id").alias("_named"), F.col("is_archived").alias("_archived"))
    checked = named.join(known, ["company_id", "_named"], "left")
    joined = identified.join(checked, PAYMENT, "left")
    usable = F.col("_archived").isNotNull()
    return joined.withColumns({
        "customer_id": F.when(usable & F.col("is_eligible"), F.col("_named")).otherwise(F.col("customer_id")),
        "customer_is_archived": F.coalesce(F.col("_archived"), F.lit(False)),
        "override_status": F.when(usable, "APPLIED").when(F.col("_named").isNotNull(), "CUSTOMER_NOT_FOUND"),
    }).drop("_named", "_archived")
