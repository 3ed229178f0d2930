"""Personal data: base patterns with checks, and terms that give protected values away by how they occur in the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitlens.llm.common import digest, let, look_up, staged, text_of
from remitlens.session import scratch

KINDS = ("email", "ip", "card", "phone", "term")
#: Same matches as the plain patterns, in linear time: a run without a match is tried once, from its start (\G: or from the last match's end).
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
TERM_BREAK = r"[^\p{L}\p{N}]+"
SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class DisclosurePolicy:
    """A term within ``window`` code points of a protected value discloses it when pointwise mutual information reaches
    ``threshold`` of the value's information, seen in ``min_contexts`` different contexts at least."""

    window: int = 100
    threshold: float = 0.8
    min_contexts: int = 3


def _hits(text: Column, kind: int, window: int) -> Column:
    pattern = PATTERNS[kind]

    def one(pieces: Column) -> Column:
        def hit(value: Column, i: Column) -> Column:
            before, after = F.get(pieces, i), F.get(pieces, i + 1)
            # the word that the window cuts is left out
            near = F.when(F.length(before) > window, F.regexp_replace(F.right(before, F.lit(window)), r"^[^ \t\n\x0B\x0C\r]+", "")).otherwise(before)
            then = F.when(F.length(after) > window, F.regexp_replace(F.left(after, F.lit(window)), r"[^ \t\n\x0B\x0C\r]++$", "")).otherwise(after)
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(before).cast("bigint").alias("gap"), value.alias("value"), F.concat_ws(" ", near, then).alias("context"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), hit)

    # without the signs that a match needs nothing is searched
    needs = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike("[0-9][ -]?[0-9]"), F.contains(text, F.lit("+")))[kind]
    return F.when(needs, let(F.split(text, pattern, -1), one)).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,value:string,context:string>>"))


def _luhn(digits: Column) -> Column:
    def sum_of(d: Column) -> Column:
        value = lambda i: F.substring(F.reverse(d), i, F.lit(1)).cast("int")
        twice = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), twice), F.lit(0), lambda a, x: a + x)

    return let(digits, sum_of) % 10 == 0


def _valid() -> Column:
    value = F.col("value")
    digits = F.regexp_replace(value, "[^0-9]", "")
    ip = value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    return F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, ip) \
        .when(F.col("kind") == 2, F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)).otherwise(F.length(digits).between(9, 15))


def found_values(docs: DataFrame, text_col: str = "text", window: int = 100) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``key`` (of the text) and row count ``n`` of every text with hits, and its checked base spans with their values and contexts."""
    text = text_of(text_col)
    hits = docs.select(digest(text).alias("key"), F.concat(*[_hits(text, k, window) for k in range(4)]).alias("hits")).where(F.size("hits") > 0)
    texts = staged(hits.groupBy("key").agg(F.count("*").alias("n"), F.first("hits").alias("hits")))
    rows = texts.select("key", F.explode("hits").alias("hit")).select("key", "hit.*")
    upto = W.partitionBy("key", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    spans = rows.select("*", end.alias("end")).where(_valid()).select("key", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "context")
    return texts.select("key", "n"), staged(spans)


def disclosing_terms(docs: DataFrame, spans: DataFrame, policy: DisclosurePolicy, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Terms that give a protected value away, with the share of its information; and the texts (``key``, ``term``) that hold them.

    n(e), n(e, t): different contexts of the value e, and those of them with the term t. n(t): documents with t, N: all documents.
    PMI = log(N n(e, t) / (n(e) n(t))); the value's own information is log(N / n(e)). A value with as many contexts as there are documents, or
    more, carries no information, so nothing gives it away.
    """
    context = F.filter(F.split(F.lower("context"), TERM_BREAK), lambda t: F.length(t) > 1)
    seen = spans.select(F.lower("value").alias("e"), F.array_sort(F.array_distinct(context)).alias("terms")).distinct()
    n_e = seen.groupBy("e").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= policy.min_contexts)
    pairs = seen.select("e", F.explode("terms").alias("t")).groupBy("e", "t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= policy.min_contexts)
    pairs = staged(pairs.join(n_e, "e"))
    candidates = staged(pairs.groupBy("t").agg(F.count("*").alias("n")))
    text = text_of(text_col)
    terms = docs.select(digest(text).alias("key"), F.explode(F.array_distinct(F.split(F.lower(text), TERM_BREAK))).alias("t"))
    # counted before they meet: one row per term on both sides
    n_t = terms.groupBy("t").agg(F.count("*").alias("n_t")).join(candidates.select("t"), "t")
    total = docs.agg(F.count("*").cast("double").alias("docs")).scalar()
    own = F.when(F.col("n_e") < total, F.log(total / F.col("n_e")))
    share = F.coalesce(F.log(total * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / own, F.lit(0.0))
    strong = staged(pairs.join(n_t, "t").groupBy("t").agg(F.max(F.least(share, F.lit(1.0))).alias("share"), F.count("*").alias("n")).where(F.col("share") >= policy.threshold))
    # texts are gone through again for the strong terms alone: most candidates are common words
    return strong.select("t", "share"), staged(look_up(terms, strong.drop("share"), ["t"], "inner", spread="key").distinct())


def private_spans(docs: DataFrame, policy: DisclosurePolicy = DisclosurePolicy(), text_col: str = "text") -> DataFrame:
    """``key`` (``digest`` of the text), ``n`` and ``spans`` (kind, start, end in code points, end exclusive) of every text with personal data.

    Kinds are places in KINDS; base spans come first, by kind and start, then disclosing terms. Texts without any are left out.
    """
    texts, base = found_values(docs, text_col, policy.window)
    _, holding = disclosing_terms(docs, base, policy, text_col)
    text = text_of(text_col)
    by_text = staged(holding.groupBy("key").agg(F.collect_set("t").alias("terms"), F.count("*").alias("n")))
    rows = docs.select(digest(text).alias("key"), text.alias("text"))
    with_text = look_up(rows, by_text, ["key"], "inner").groupBy("key").agg(F.first("text").alias("text"), F.first("terms").alias("terms"), F.count("*").alias("rows"))
    each = with_text.select("key", "rows", "text", F.explode("terms").alias("t"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), F.col("t"), F.lit(r"\E(?![\p{L}\p{N}])"))
    gaps = each.select("key", "rows", "t", F.posexplode(F.split("text", pattern, -1)).alias("i", "gap"))
    order = W.partitionBy("key", "t").orderBy("i")
    width = F.length("t")
    placed = gaps.select("key", "rows", "i", width.alias("width"), (F.sum(F.length("gap") + width).over(order)).alias("end"), F.count("*").over(W.partitionBy("key", "t")).alias("of"))
    terms = placed.where(F.col("i") < F.col("of") - 1).select("key", F.col("rows").alias("n"), F.lit(4).alias("kind"), (F.col("end") - F.col("width")).alias("start"), "end")
    base = base.select("key", "kind", "start", "end").join(texts, "key").select("key", "n", "kind", "start", "end")
    return staged(base.unionByName(terms).groupBy("key").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("kind", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))).alias("spans")))


def find_private(docs: DataFrame, policy: DisclosurePolicy = DisclosurePolicy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans`` of every row of ``docs``, an empty array where nothing is found.

    A null text counts as empty; a null id is returned as such; repeated rows come back as often as they came; other columns are
    ignored; empty ``docs`` give no rows. A match that fails its check is dropped whole, without a second try inside it.
    """
    spans = private_spans(docs, policy, text_col)
    rows = docs.select(F.col(id_col).alias("id"), digest(text_of(text_col)).alias("key"), F.xxhash64(id_col).alias("spread"))
    return look_up(rows, spans, ["key"], "left", spread="spread").select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as a string."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(id_col, *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(said(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@scratch()
def sanitised(docs: DataFrame, policy: DisclosurePolicy = DisclosurePolicy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with base values generalised to their kind, disclosing terms to [NAME] or [NUMBER] by their form or else removed.

    Spans that overlap are replaced as one, by the label of the first. The columns of ``docs`` are kept, whatever their names; a null text
    stays null and an empty one empty; repeated rows come back as often as they came; empty ``docs`` give no rows.
    """
    spans = private_spans(docs, policy, text_col).select("key", "n", F.explode("spans").alias("s")).select("key", "n", "s.*")
    order = W.partitionBy("key").orderBy("start", F.desc("end"), "kind")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = spans.withColumn("first", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    islands = begins.withColumn("island", F.sum("first").over(order)).groupBy("key", "island").agg(
        F.max("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.when(F.col("first") == 1, F.col("kind"))).alias("kind"))
    by_text = staged(islands.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")), keep=True)
    rows = docs.select(F.struct("*").alias("doc"), digest(text_of(text_col)).alias("key"), F.xxhash64(id_col).alias("spread"))
    text = text_of(f"doc.{text_col}")

    def cut(at: Column, to: Column) -> Column:
        return F.substring(text, (at + 1).cast("int"), (to - at).cast("int"))

    def label(s: Column) -> Column:
        term = cut(s["start"], s["end"])
        form = F.when(term.rlike("[0-9]"), "[NUMBER]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        return F.coalesce(F.get(F.array(*[F.lit(x) for x in LABELS]), s["kind"]), form)

    parts = lambda cuts: F.concat(F.transform(cuts, lambda s, i: F.concat(cut(F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)), s["start"]), label(s))),
                                  F.array(cut(F.element_at(cuts, -1)["end"], F.length(text).cast("bigint"))))
    met = look_up(rows, by_text, ["key"], "left", spread="spread")
    clean = F.when(F.col("cuts").isNull(), F.col(f"doc.{text_col}")).otherwise(F.array_join(parts(F.col("cuts")), ""))
    return met.select(F.col("doc").withField(text_col, clean).alias("doc")).select("doc.*")
