"""Which sets of a payment's invoices add up to it, for any number of invoices and sets of any size.

The invoices of a payment are cut into blocks of a few, and the blocks are the leaves of a binary tree. A state is a row: a node and a sum
(with the size and the number of named invoices) that some of the node's invoices make, with the number of ways to make it. Sibling
nodes meet in a join on the payment, and equal sums of the parent become one state again, so equal balances don't multiply. Sums over the
payment are dropped, and sums so low that the other invoices (or the largest that a bounded set may still take) can't make up the rest.
The last two halves meet in an equi-join on the remaining amount.

Counting thus needs states, not sets. Sets are listed as rows, and only from states that a walk back from the whole amount found useful,
so each partial set in the listing belongs to a set that adds up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

PAYMENT = ["company_id", "payment_id"]
#: invoices in a block, at most
LEAF = 5
#: counts stop there: so many sets or more
MANY = 10**18
#: what tells the states of a node apart
STATE = ["sum", "size", "marks", "aged", "days"]
#: the same for all states of a payment
SHARED = ["target", "total", "largest"]


def _saturated(count: Column) -> Column:
    return F.least(count, F.lit(MANY).cast("decimal(38,0)")).cast("bigint")


def _wide(count: str) -> Column:
    return F.col(count).cast("decimal(19,0)")


@dataclass(frozen=True)
class _Tree:
    """One pass over the trees of all payments.

    Where ``max_size`` is set, states tell sizes apart. ``by_age``: they tell sizes and whether they hold an invoice due on ``oldest``
    apart, and of the sets of one state only those with the least sum of ``days`` count.
    """

    max_size: int | None
    by_age: bool = False

    def leaves(self, searched: DataFrame) -> DataFrame:
        """Every subset of every block as a row; ``level`` is the depth of the payment's tree."""
        level = F.greatest(F.lit(0), F.ceil(F.log2(F.size("members") / F.lit(float(LEAF))))).cast("int")
        rows = searched.withColumn("level", level).withColumn("blocks", F.pow(F.lit(2), F.col("level")).cast("int"))
        rows = rows.withColumn("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        begin = lambda node: F.floor(node * F.size("members") / F.col("blocks")).cast("int")
        rows = rows.withColumn("part", F.slice("members", begin(F.col("node")) + 1, begin(F.col("node") + 1) - begin(F.col("node")))).drop("members")
        total = lambda part, field: F.aggregate(part, F.lit(0).cast("bigint"), lambda s, m: s + m[field])
        rows = rows.withColumn("node_total", total(F.col("part"), "cents"))
        rows = rows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("part")).cast("int") - 1)))
        taken, zero = F.col("taken"), F.lit(0)
        rows = rows.withColumn("taken", F.filter("part", lambda m, i: F.getbit(F.col("mask"), i) == 1))
        aged = F.exists(taken, lambda m: m["due"] == F.col("oldest")).cast("int") if self.by_age else zero
        return rows.select(
            *PAYMENT, "level", "node", *SHARED, "node_total", total(taken, "cents").alias("sum"),
            (F.size(taken) if self.max_size is not None or self.by_age else zero).alias("size"),
            (zero if self.by_age else F.size(F.filter(taken, lambda m: m["mark"]))).alias("marks"), aged.alias("aged"),
            (total(taken, "days") if self.by_age else zero.cast("bigint")).alias("days"),
            F.lit(1).cast("bigint").alias("sets"), F.transform(taken, lambda m: m["at"]).alias("one"),
            F.array_min(F.transform(taken, lambda m: m["due"])).alias("due")).where(self._open())

    def _open(self) -> Column:
        """States that can still become the whole amount."""
        rest = F.col("target") - F.col("sum")
        kept = (rest >= 0) & (rest <= F.col("total") - F.col("node_total"))
        if self.max_size is None:
            return kept
        return kept & (F.col("size") <= self.max_size) & (rest <= (F.lit(self.max_size) - F.col("size")) * F.col("largest"))

    def folded(self, rows: DataFrame) -> DataFrame:
        """One row per state: how many sets it stands for, the first of them by position, and the oldest due date in any."""
        keys = [*PAYMENT, "level", "node", *STATE]
        out = rows.groupBy(*keys).agg(
            _saturated(F.sum(_wide("sets"))).alias("sets"), F.min("one").alias("one"), F.min("due").alias("due"),
            *[F.first(c).alias(c) for c in (*SHARED, "node_total")])
        if not self.by_age:
            return out
        least = F.min(F.struct("days", "sets", "one", "due", *SHARED, "node_total"))
        return out.groupBy(*[k for k in keys if k != "days"]).agg(least.alias("v")).select(*[k for k in keys if k != "days"], "v.*")

    def siblings(self, states: DataFrame, at_top: bool) -> DataFrame:
        """Pairs of states of the two children of a node: the left one's columns, and the right one's as ``r_``."""
        parent = F.floor(F.col("node") / 2).cast("int")
        left = states.where("node % 2 = 0").withColumn("parent", parent)
        if at_top:
            left = left.withColumn("need", F.col("target") - F.col("sum"))
        right = states.where("node % 2 = 1").select(
            *PAYMENT, parent.alias("parent"), *([F.col("sum").alias("need")] if at_top else []),
            *[F.col(c).alias(f"r_{c}") for c in ("node", *STATE, "sets", "one", "due", "node_total")])
        return left.join(right, [*PAYMENT, "parent", *["need"] * at_top])

    def merged(self, states: DataFrame, at_top: bool) -> DataFrame:
        """States of the next level up."""
        both = self.siblings(states, at_top)
        plus = lambda c: (F.col(c) + F.col(f"r_{c}")).alias(c)
        made = both.select(
            *PAYMENT, (F.col("level") - 1).alias("level"), F.col("parent").alias("node"), *SHARED, plus("node_total"), plus("sum"), plus("size"), plus("marks"),
            F.greatest("aged", "r_aged").alias("aged"), plus("days"), _saturated(_wide("sets") * _wide("r_sets")).alias("sets"),
            F.concat("one", "r_one").alias("one"), F.least("due", "r_due").alias("due"))
        return self.folded(made.where(self._open()))

    def run(self, searched: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
        """The whole amounts as states of node 0, the states of each level from 1 down, and the subsets of the blocks."""
        leaves = cut_lineage(self.leaves(searched))
        depth = leaves.agg(F.max("level").alias("d")).first().d or 0
        levels: list[DataFrame] = []
        states = None
        for level in range(depth, 0, -1):
            own = self.folded(leaves.where(F.col("level") == level))
            states = cut_lineage(own if states is None else own.unionByName(self.merged(states, False)))
            levels.insert(0, states)
        whole = self.folded(leaves.where("level = 0 and sum = target"))
        if states is not None:
            whole = whole.unionByName(self.merged(states, True))
        return cut_lineage(whole), levels, leaves


def _listed(whole: DataFrame, levels: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """All sets behind the states ``whole`` of node 0, as rows (the payment and ``set``, positions in rising order)."""
    state = [*PAYMENT, "node", "sum", "size", "marks"]
    named = lambda prefix, keep=(): [F.col(c).alias(c if c in (*PAYMENT, *keep) else f"{prefix}{c}") for c in state]
    useful = whole.select(*state)
    splits, wanted = [], [useful]
    for states in levels:
        bare = states.select(*state)
        up = useful.select(*named("p_")).withColumn("l_node", F.col("p_node") * 2)
        pairs = up.join(bare.select(*named("l_")), [*PAYMENT, "l_node"]).where("l_sum <= p_sum and l_size <= p_size and l_marks <= p_marks")
        pairs = pairs.withColumns({"r_node": F.col("l_node") + 1, **{f"r_{c}": F.col(f"p_{c}") - F.col(f"l_{c}") for c in ("sum", "size", "marks")}})
        split = cut_lineage(pairs.join(bare.select(*named("r_")), [*PAYMENT, "r_node", "r_sum", "r_size", "r_marks"], "left_semi"))
        useful = split.select(*PAYMENT, *[F.col(f"l_{c}").alias(c) for c in state[2:]]).union(split.select(*PAYMENT, *[F.col(f"r_{c}").alias(c) for c in state[2:]])).distinct()
        splits.append(split)
        wanted.append(useful)
    sets = None
    for level in range(len(levels), -1, -1):
        own = leaves.where(F.col("level") == level).join(wanted[level], state, "left_semi").select(*state, F.col("one").alias("set"))
        sets = own if sets is None else own.unionByName(sets)
        if level:
            split = splits[level - 1]
            halves = split.join(sets.select(*named("l_"), F.col("set").alias("l_set")), [*PAYMENT, *[f"l_{c}" for c in state[2:]]]).join(
                sets.select(*named("r_"), F.col("set").alias("r_set")), [*PAYMENT, *[f"r_{c}" for c in state[2:]]])
            sets = halves.select(*PAYMENT, *[F.col(f"p_{c}").alias(c) for c in state[2:]], F.concat("l_set", "r_set").alias("set"))
    return sets.select(*PAYMENT, "set")


def _measured(searched: DataFrame) -> DataFrame:
    return searched.withColumns({
        "total": F.aggregate("members", F.lit(0).cast("bigint"), lambda s, m: s + m["cents"]), "largest": F.array_max(F.transform("members", lambda m: m["cents"]))})


def list_sets(searched: DataFrame, max_size: int | None = None) -> DataFrame:
    """Every set that adds up, as a row: the payment and ``set``. As long as there are sets; no payment's sets are gathered."""
    return _listed(*_Tree(max_size).run(_measured(searched)))


def search_sets(searched: DataFrame, max_size: int | None = None, max_listed: int | None = None) -> DataFrame:
    """What is to know about the sets of each payment that has any, one row per payment.

    ``searched`` holds one row per payment: ``target`` in cents and ``members``, an array of structs ``at`` (position), ``cents`` (positive and
    less than the target), ``mark`` (named by the payment), ``due`` and ``days``. ``max_size`` bounds the size of a set, None doesn't.

    ``found`` counts the sets (MANY stands for MANY or more), ``most`` is the highest number of named members, ``n_most`` counts the sets with so
    many and ``most_set`` is the first of them. ``subsets`` lists all sets where there are at most ``max_listed`` (None: always), else it
    is null and ``aged_set`` and ``n_aged`` give the first set by (oldest due date, mean of days), and how many sets tie with it.
    """
    rows = _measured(searched)
    whole, levels, leaves = _Tree(max_size).run(rows)
    by_marks = whole.groupBy(*PAYMENT, "marks").agg(_saturated(F.sum(_wide("sets"))).alias("sets"), F.min("one").alias("one"), F.min("due").alias("due"))
    found = cut_lineage(by_marks.groupBy(*PAYMENT).agg(
        _saturated(F.sum(_wide("sets"))).alias("found"), F.max("marks").cast("int").alias("most"), F.max_by("sets", "marks").alias("n_most"),
        F.max_by("one", "marks").alias("most_set"), F.min("due").alias("oldest")))
    few = F.lit(True) if max_listed is None else F.col("found") <= max_listed
    listed = _listed(whole.join(found.where(few).select(*PAYMENT), PAYMENT, "left_semi"), levels, leaves)
    # at most max_listed sets of a payment meet here, by count
    out = found.join(listed.groupBy(*PAYMENT).agg(F.array_sort(F.collect_list("set")).alias("subsets")), PAYMENT, "left")
    if max_listed is None:
        return out.withColumns({"aged_set": F.lit(None).cast("array<int>"), "n_aged": F.lit(None).cast("bigint")}).drop("oldest")
    many = rows.join(found.where(~few).select(*PAYMENT, "oldest"), PAYMENT)
    aged_whole, _, _ = _Tree(max_size, by_age=True).run(many)
    means = aged_whole.where("aged = 1").withColumn("mean", F.col("days") / F.col("size"))
    per_mean = means.groupBy(*PAYMENT, "mean").agg(_saturated(F.sum(_wide("sets"))).alias("sets"), F.min("one").alias("one"))
    aged = per_mean.groupBy(*PAYMENT).agg(F.min_by("one", "mean").alias("aged_set"), F.min_by("sets", "mean").alias("n_aged"))
    return out.join(aged, PAYMENT, "left").drop("oldest")
