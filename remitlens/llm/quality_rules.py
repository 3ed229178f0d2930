"""Quality rules: per-document measures, and lines that too many documents of a host share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import (
    WHITE, digest, let, look_up, plain_lines, staged, text_of, without_white, words_of,
)

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class QualityRules:
    """``min_words`` and ``max_repeat_percent`` decide by the document alone. A line is common when more than ``max_documents`` different
    documents of its host carry it, which are ``min_share`` of the host's different documents at least; documents of equal text are one. A
    document is depleted when less than ``min_left`` of its words are outside common lines. The share keeps groups of near copies, which hold
    a small part of a host, from making their own lines common: near-dedup is to choose among them."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_documents: int = 20
    min_share: float = 0.02
    min_left: float = 0.2


def repeated_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["x"] == e["x"]) | (F.get(s, i + 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull())
        widths = lambda p: F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
        places = let(let(ordered, twice), lambda p: F.sort_array(p))
        return F.aggregate(let(places, widths), F.lit(0), lambda a, x: a + x)

    return let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))).cast("bigint")


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document, without its text: id, host, ``key`` (equal for equal host and text), the measures and ``lines``."""
    text = F.col("text")
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text_of(text_col).alias("text"))
    df = df.select("id", "host", "text", words_of(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("raw"), plain_lines(text).alias("plain"))
    symbols = text
    for ch in SYMBOLS:
        symbols = F.replace(symbols, F.lit(ch), F.lit(""))
    worded = F.filter("plain", lambda x: x != "")
    return df.select(
        "id", "host", digest(F.col("host"), text).alias("key"), F.size("words").cast("bigint").alias("n_words"), F.length(without_white(text)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(symbols)).cast("bigint").alias("n_symbols"), (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform(worded, lambda x: F.struct((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"), F.unhex(F.md5(x)).alias("h"))).alias("lines"))


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures of every document, the words that its common lines hold, and the verdict.

    One row per row of ``docs``, repeated rows included: the id, ``host``, ``key``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``common_words``, ``common_lines`` (hashes), ``base_failed``, ``kept``. A null text counts as empty, a null
    host as the host ''. Lines are compared in lower case with blanks joined. Other columns are ignored; empty ``docs`` give no rows.
    """
    measured = staged(measures(docs, id_col, text_col, host_col))
    held = measured.select("host", "key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    once = held.groupBy("host", "h", "key").agg(F.count("*").alias("c"))  # equal texts are one document
    carried = once.groupBy("host", "h").agg(F.sum("c").alias("n"), F.count("*").alias("documents")).where(F.col("documents") > rules.max_documents)
    hosts = measured.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
    common = staged(carried.join(hosts, "host").where(F.col("documents") >= rules.min_share * F.col("of")).select("host", "h", "n"))
    # what common lines hold, by text: equal texts of a host get equal answers
    lines = measured.select("key", "host", F.explode(F.transform("lines", lambda x, i: F.struct(x["h"].alias("h"), x["words"].alias("words"), i.alias("i")))).alias("line")).select("key", "host", "line.*")
    hit = look_up(lines, common, ["host", "h"], "inner")
    depleted = staged(hit.groupBy("key").agg(F.count("*").alias("n"), F.collect_set(F.struct("i", "words", "h")).alias("hit")))
    judged = look_up(measured.drop("lines"), depleted, ["key"], "left", spread="id")
    hits = F.coalesce("hit", F.array().cast("array<struct<i:int,words:int,h:binary>>"))
    judged = judged.withColumn("common_words", F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, x: a + x["words"]))
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return judged.select(
        F.col("id").alias(id_col), "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "common_words",
        F.array_distinct(F.transform(hits, lambda x: x["h"])).alias("common_lines"), base_failed.alias("base_failed"),
        (~base_failed & (F.col("n_words") - F.col("common_words") >= rules.min_left * F.col("n_words"))).alias("kept"))


def without_common_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` that ``quality`` keeps, less their common lines, with the columns of ``docs``. Order of lines is kept.

    A null text counts as empty and fails the rules; repeated rows come back as often as they came; empty ``docs`` give no rows.
    """
    host, text = F.coalesce(F.col(host_col).cast("string"), F.lit("")), text_of(text_col)
    # only texts that change are looked up
    changed = verdicts.where(~F.col("kept") | (F.size("common_lines") > 0))
    by_key = staged(changed.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("kept").alias("stays"), F.first("common_lines").alias("common")), keep=True)
    rows = docs.select(F.struct("*").alias("doc"), digest(host, text).alias("key"), F.xxhash64(id_col).alias("spread"))
    kept = look_up(rows, by_key, ["key"], "left", spread="spread").where(F.coalesce("stays", F.lit(True)))
    whole = text_of(f"doc.{text_col}")
    pairs = F.arrays_zip(F.split(whole, "\n").alias("raw"), plain_lines(whole).alias("plain"))
    rest = F.transform(F.filter(pairs, lambda x: ~F.array_contains(F.col("common"), F.unhex(F.md5(x["plain"])))), lambda x: x["raw"])
    cleaned = F.when(F.col("common").isNull() | (F.size("common") == 0), F.col(f"doc.{text_col}")).otherwise(F.array_join(rest, "\n"))
    return kept.select(F.col("doc").withField(text_col, cleaned).alias("doc")).select("doc.*")
