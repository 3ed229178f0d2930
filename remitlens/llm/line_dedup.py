"""Line dedup by log-template tree: lines that are one template in many documents are dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import digest, look_up, plain_lines, staged, text_of
from remitlens.session import scratch

FIELD = "<*>"


@dataclass(frozen=True)
class TemplatePolicy:
    """The tree has a level for the token count and one for each of the first ``lead`` tokens, so those are alike within a leaf. A later token
    is constant when lines of enough documents have it in its place, else it is a variable field. A template counts if at least ``similarity`` of
    its tokens after the leading ones are constant (of all tokens, where there are no more). It recurs when enough documents hold an instance:
    ``min_documents`` different ones, which are ``min_share`` of all different documents at least; documents of equal text are one. The share keeps
    groups of near copies, a small part of a corpus, from making their own lines recur: near-dedup is to choose among them."""

    lead: int = 3
    min_documents: int = 10
    min_share: float = 0.001
    similarity: float = 0.5


def _tokens(text: Column) -> Column:
    """Lines in plain form with tokens that hold a digit masked; positions are those of ``split(text, '\\n')``."""
    plain = plain_lines(text)
    masked = F.transform(plain, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(x))
    return F.transform(masked, F.trim)


def _lines(docs: DataFrame, text_col: str, policy: TemplatePolicy) -> DataFrame:
    text = text_of(text_col)
    width = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    leaf = lambda x: F.unhex(F.md5(F.concat_ws(" ", width(x), F.substring_index(x, " ", policy.lead))))
    line = lambda x, i: F.struct(i.alias("i"), width(x).alias("words"), leaf(x).alias("leaf"), F.unhex(F.md5(x)).alias("form"))
    marked = F.filter(F.transform("plain", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] != "")
    df = docs.select(digest(text).alias("key"), _tokens(text).alias("plain"))
    return df.select("key", F.transform(marked, lambda s: line(s["x"], s["i"])).alias("lines"))


def line_templates(docs: DataFrame, policy: TemplatePolicy = TemplatePolicy(), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables: the recurring templates (``template``, ``documents``), and by text (``key``) the places ``drop`` of lines that are instances of one."""
    lines = F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["words"].alias("words"), x["leaf"].alias("leaf"), x["form"].alias("form")))
    rows = staged(_lines(docs, text_col, policy).select("key", F.explode(lines).alias("x")).select("key", "x.*"))
    # documents of equal text are one: their lines count once, weighed by how many rows they stand for where rows are met again
    once = staged(rows.groupBy("leaf", "form", "key").agg(F.min("i").alias("i"), F.count("*").alias("n")))
    enough = max(policy.min_documents, policy.min_share * once.select("key").distinct().count())

    # level by level: a template of too few documents can't hide in a leaf of too few
    leaves = staged(once.groupBy("leaf", "key").agg(F.sum("n").alias("n")).groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))
                    .where(F.col("documents") >= enough).select("leaf", "n"))
    kept = look_up(once.withColumnRenamed("n", "c"), leaves, ["leaf"], "inner", spread="key")
    # the text of each different line is read from one document that has it
    forms = staged(kept.groupBy("leaf", "form").agg(F.sum("c").alias("n"), F.count("*").alias("documents"), F.min(F.struct("key", "i")).alias("at")))
    picks = staged(forms.groupBy("at.key").agg(F.collect_list(F.struct("at.i", "leaf", "form", "n", "documents")).alias("picks"), F.max("n").alias("n")))
    text = text_of(text_col)
    shown = look_up(docs.select(digest(text).alias("key"), text.alias("text")), picks, ["key"], "inner")
    shown = shown.select("picks", _tokens(F.col("text")).alias("plain")).select("plain", F.explode("picks").alias("x")).select("x.leaf", "x.form", "x.n", "x.documents", F.get("plain", F.col("x.i")).alias("line"))
    forms = staged(shown.groupBy("leaf", "form").agg(F.first("line").alias("line"), F.first("n").alias("n"), F.first("documents").alias("documents")))
    tokens = forms.select("leaf", "form", "documents", F.posexplode(F.split("line", " ")).alias("at", "token"))
    constant = tokens.where(F.col("token") != FIELD).groupBy("leaf", "at", "token").agg(F.sum("documents").alias("held")).where(F.col("held") >= enough)
    # a place has at most 1 / min_share constants, as each is held by so large a part of all documents
    by_leaf = constant.groupBy("leaf").agg(F.collect_list(F.concat_ws(" ", "at", "token")).alias("constants"))
    by_leaf = staged(by_leaf.join(forms.groupBy("leaf").agg(F.count("*").alias("n")), "leaf"))
    known = look_up(forms.select("leaf", "form", F.col("n").alias("rows"), F.split("line", " ").alias("tokens")), by_leaf, ["leaf"], "inner", spread="form")
    fixed = F.transform("tokens", lambda t, i: F.array_contains("constants", F.concat_ws(" ", i, t)))
    judged = known.select("leaf", "form", F.col("rows").alias("n"), "tokens", fixed.alias("fixed"))
    later = F.when(F.size("fixed") > policy.lead, F.slice("fixed", F.lit(policy.lead + 1), F.size("fixed"))).otherwise(F.col("fixed"))
    likeness = F.size(F.filter(later, lambda x: x)) / F.size(later)
    made = judged.where((likeness >= policy.similarity) & F.array_contains("fixed", True)).select(
        "leaf", "form", "n", F.array_join(F.zip_with("tokens", "fixed", lambda t, x: F.when(x, t).otherwise(FIELD)), " ").alias("template"))
    made = staged(made.select("form", F.unhex(F.md5(F.concat(F.hex("leaf"), "template"))).alias("id"), "template", "n"))

    # documents per template: a document with several instances counts once
    held = look_up(once.select("form", "key"), made.select("form", "id", "n"), ["form"], "inner", spread="key")
    counts = held.distinct().groupBy("id").agg(F.count("*").alias("documents")).where(F.col("documents") >= enough)
    recurring = staged(made.join(counts, "id"))
    gone = look_up(rows.select("key", "i", "form"), recurring.select("form", F.lit(True).alias("gone"), "n"), ["form"], "inner", spread="key")
    drops = staged(gone.groupBy("key").agg(F.collect_set("i").alias("drop"), F.count("*").alias("n")), keep=True)
    return recurring.select("template", "documents").distinct(), drops


@scratch()
def drop_template_lines(docs: DataFrame, policy: TemplatePolicy = TemplatePolicy(), id_col: str = "doc_id", text_col: str = "text",
                        count_cols: bool = False) -> DataFrame:
    """``docs`` without the lines that are instances of a recurring template; other lines, blank ones too, stay as they are and in order.

    Every row and column of ``docs`` comes back, repeated rows as often as they came; a document may end up empty. A null text counts
    as empty and stays null. With ``count_cols`` also ``n_lines`` and ``n_dropped``, which ``docs`` must not have. Empty ``docs`` give no rows.
    """
    _, drops = line_templates(docs, policy, text_col)
    rows = docs.select(F.struct("*").alias("doc"), digest(text_of(text_col)).alias("key"), F.xxhash64(id_col).alias("spread"))
    met = look_up(rows, drops, ["key"], "left", spread="spread")
    lines = F.split(text_of(f"doc.{text_col}"), "\n")
    rest = F.filter(lines, lambda x, i: ~F.array_contains(F.col("drop"), i))
    cleaned = F.when(F.col("drop").isNull(), F.col(f"doc.{text_col}")).otherwise(F.array_join(rest, "\n"))
    extra = [F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped")] if count_cols else []
    return met.select(F.col("doc").withField(text_col, cleaned).alias("doc"), *extra).select("doc.*", *[c for c in ("n_lines", "n_dropped") if count_cols])
