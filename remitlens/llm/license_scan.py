"""Licence scans: a trained paragraph classifier with an unknown class, whose predictions templates confirm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.common import WHITE, digest, let, look_up, staged, text_of
from remitlens.llm.license_templates import TEMPLATES

UNKNOWN = "unknown"
SHINGLE = 5
#: code points of the longest line of a paragraph wrapped by hand
WRAPPED = 120


@dataclass(frozen=True)
class LicensePolicy:
    """The classifier is fitted on the templates, on pieces of them of ``piece`` words, and as unknown on a paragraph each of about
    ``negatives`` documents chosen by hash (a bound on the training set alone; every paragraph is scored). Every fifth
    piece and corpus row is held out. A paragraph is of a known family if the probability that it isn't unknown reaches the least value from which
    held-out rows so told are right in ``precision``; the likeliest family is then named.
    A prediction is confirmed when ``similarity`` of a template's five-word shingles are in the paragraph."""

    negatives: int = 4000
    piece: int = 12
    features: int = 1 << 15
    precision: float = 0.99
    similarity: float = 0.8


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, size: int) -> Column:
    """Runs of ``size`` words, space-joined; none if there are fewer."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]))) \
        .otherwise(F.array().cast("array<string>"))


def _grams(words: Column) -> Column:
    return let(words, lambda w: F.concat(w, _runs(w, 2)))


def _shingles(words: Column) -> Column:
    """Distinct five-word runs; a shorter text is one run."""
    return let(words, lambda w: F.array_distinct(F.when(F.size(w) < SHINGLE, F.array(F.concat_ws(" ", w))).otherwise(_runs(w, SHINGLE))))


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key`` (of the text), ``form``, place ``i`` and ``words`` of every paragraph with a word.

    A line is a paragraph (form ``line``); so are lines between blank ones that are two or more and none longer than WRAPPED code points, as text
    wrapped by hand is (form ``block``).
    """
    text = text_of(text_col)
    line = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("form"), i.alias("i"), x.alias("said")))
    wrapped = lambda x: F.contains(F.trim(x), F.lit("\n")) & F.forall(F.split(x, "\n"), lambda y: F.length(y) <= WRAPPED)
    blocks = F.filter(F.transform(F.split(text, r"\n[ \t\r\x0B\x0C]*+\n"), lambda x, i: F.struct(F.lit("block").alias("form"), i.alias("i"), F.btrim(x, F.lit(WHITE)).alias("said"))), lambda p: wrapped(p["said"]))
    return docs.select(digest(text).alias("key"), F.inline(F.concat(line, blocks))).select("key", "form", "i", _words(F.col("said")).alias("words")).where(F.size("words") > 0)


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in sorted(TEMPLATES.items()) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", _words(F.col("text")))


@dataclass
class LicenseModel:
    families: list[str]
    model: LogisticRegressionModel
    hashing: HashingTF
    least: float
    held_out: dict[str, float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` (or unknown) and ``probability`` to rows with ``words``."""
        scored = self.model.transform(self.hashing.transform(rows.withColumn("grams", _grams(F.col("words")))))
        scored = scored.withColumn("p", vector_to_array("probability")).drop("grams", "features", "rawPrediction", "prediction", "probability")
        own = F.slice("p", 2, len(self.families))
        name = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.array_position(own, F.array_max(own)).cast("int"))
        known = 1 - F.col("p")[0]
        is_known = known >= self.least
        return scored.select(*rows.columns, F.when(is_known, name).otherwise(UNKNOWN).alias("family"), F.when(is_known, known).otherwise(F.col("p")[0]).alias("probability"))


def train(docs: DataFrame, policy: LicensePolicy = LicensePolicy(), text_col: str = "text") -> LicenseModel:
    """Fit the classifier and its least probability. The training rows are bounded by the templates and ``policy.negatives``."""
    spark = docs.sparkSession
    families = sorted(TEMPLATES)
    templates = template_rows(spark)
    step = policy.piece // 2
    pieces = templates.select("family", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - step, F.lit(0)), F.lit(step)),
                                                              lambda i: F.slice("words", i + 1, policy.piece))).alias("words"))
    shingles = [r[0] for r in templates.select(F.explode(_shingles(F.col("words")))).distinct().collect()]  # bounded by the templates
    # one paragraph each of about ``negatives`` documents, chosen by hash
    text = text_of(text_col)
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.lit((1 << 40) * min(1.0, policy.negatives / max(1, docs.count()))))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    smallest = F.array_min(F.transform(lines, lambda x: F.struct(F.md5(x).alias("hash"), x.alias("line"))))["line"]
    corpus = chosen.select(_words(F.coalesce(smallest, F.lit(""))).alias("words")).where(F.size("words") > 0)
    negative = corpus.where(~F.arrays_overlap(_shingles(F.col("words")), F.array(*[F.lit(s) for s in shingles]))).distinct()
    label = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")), F.lit(0)).cast("double")
    # whole templates are trained on; pieces of them and corpus rows are split, and every fifth is held out
    whole = templates.select("words", label.alias("label"), F.lit(10.0).alias("weight"))
    others = pieces.select("words", label.alias("label"), F.lit(1.0).alias("weight")).distinct().union(negative.select("words", F.lit(0.0).alias("label"), F.lit(1.0).alias("weight")))
    held_out = F.pmod(F.xxhash64("words"), F.lit(5)) == 0
    rows = staged(whole.withColumn("out", F.lit(False)).union(others.withColumn("out", held_out)).withColumn("grams", _grams(F.col("words"))).coalesce(4))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=policy.features, binary=True)
    ready = hashing.transform(rows)
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=30, standardization=False, weightCol="weight").fit(ready.where("not out"))
    held = model.transform(ready.where("out")).select("label", "prediction", (1 - vector_to_array("probability")[0]).alias("known"))
    tail = held.orderBy(F.desc("known")).collect()  # bounded like the training rows
    least, right = 0.5, 0
    for k, row in enumerate(tail, 1):
        right += row.label > 0
        if row.known < 0.5 or right < policy.precision * k:
            least = max(least, row.known + 1e-9) if right < policy.precision * k else least
            break
    accuracy = sum(r.label == r.prediction for r in tail) / max(1, len(tail))
    return LicenseModel(families, model, hashing, least, {"rows": len(tail), "accuracy": accuracy})


def scan(docs: DataFrame, policy: LicensePolicy = LicensePolicy(), text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """Paragraphs predicted to be of a licence family: ``key`` (of the text), ``form`` and ``i`` (see ``paragraphs``), ``family``, ``probability``,
    ``template`` (the closest of the family), ``similarity`` (share of its shingles found) and ``confirmed``. Written to the shared folder.

    Null, empty and blank texts have no paragraphs; equal texts are told once, under one key; empty ``docs`` give no rows.
    """
    spark = docs.sparkSession
    model = model or train(docs, policy, text_col)
    predicted = staged(model.predict(paragraphs(docs, text_col)).where(F.col("family") != UNKNOWN).groupBy("key", "form", "i", "family", "probability").agg(F.first("words").alias("words")))
    templates = template_rows(spark).select("family", "template", _shingles(F.col("words")).alias("shingles"), F.size("words").alias("length"), F.concat_ws(" ", "words").alias("whole"))
    joined = F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" "))
    part = F.when(F.col("length") < SHINGLE, F.contains(joined, F.concat(F.lit(" "), F.col("whole"), F.lit(" "))).cast("double")) \
        .otherwise(F.size(F.array_intersect(_shingles(F.col("words")), "shingles")) / F.size("shingles"))
    compared = predicted.join(F.broadcast(templates), "family").select("key", "form", "i", "family", "probability", "template", part.alias("similarity"))  # a fixed list
    best = compared.groupBy("key", "form", "i", "family", "probability").agg(F.max(F.struct("similarity", (-F.col("template")).alias("minus"))).alias("best"))
    return staged(best.select("key", "form", "i", "family", "probability", (-F.col("best.minus")).alias("template"), F.col("best.similarity").alias("similarity"),
                              (F.col("best.similarity") >= policy.similarity).alias("confirmed")))


def document_licenses(docs: DataFrame, policy: LicensePolicy = LicensePolicy(), id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """The id, ``licenses`` (confirmed families, sorted), ``n_predicted`` and ``n_confirmed`` paragraphs of every row of ``docs``.

    A null or empty text has none; a null id is returned as such; repeated rows come back as often as they came; other columns are
    ignored; empty ``docs`` give no rows (the model is then fitted on the templates alone).
    """
    found = scan(docs, policy, text_col, model)
    by_text = staged(found.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("licenses"),
                                              F.count("*").alias("n_predicted"), F.count_if("confirmed").alias("n_confirmed"), F.count("*").alias("n")))
    rows = docs.select(F.col(id_col).alias("id"), digest(text_of(text_col)).alias("key"), F.xxhash64(id_col).alias("spread"))
    none = F.lit(0).cast("bigint")
    return look_up(rows, by_text, ["key"], "left", spread="spread").select(
        F.col("id").alias(id_col), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_predicted", none).alias("n_predicted"),
        F.coalesce("n_confirmed", none).alias("n_confirmed"))
