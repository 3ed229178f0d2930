"""The registered queries of the corpus operators, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.exact_dedup import DigestIndex
from remitlens.llm.hard_negatives import hard_negatives
from remitlens.llm.html_extract import main_text
from remitlens.llm.importance_resampling import resample
from remitlens.llm.license_scan import document_licenses
from remitlens.llm.line_dedup import drop_template_lines
from remitlens.llm.packing import pack_documents
from remitlens.llm.pii import find_private, span_digests
from remitlens.llm.quality_rules import quality
from remitlens.llm.sentencepiece_codec import encode
from remitlens.llm.simhash_dedup import near_dedup
from remitlens.llm.token_counts import token_counts
from remitlens.llm.token_files import read_token_files, write_token_files
from remitlens.session import run_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DigestIndex(spark).add(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    encoded = encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), verify=True)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_private(_table(spark, sf_dir, "documents")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_template_lines(_table(spark, sf_dir, "documents"), count_cols=True).select("doc_id", "n_lines", "n_dropped", "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(_table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "common_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path).withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pii": op3_pii,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_token_files": op11_token_files,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

ORACLE = {
    "op5_line_dedup": r"""
with ln as (select doc_id, k, i, trim(regexp_replace(trim(regexp_replace(lower(l), '[ \t\x0b\x0c\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g')) l from (
         select doc_id, k, generate_subscripts(ls, 1) i, unnest(ls) l from (select doc_id, md5(coalesce(text, '')) k, string_split(coalesce(text, ''), chr(10)) ls from documents))),
b as (select *, string_split(l, ' ') toks from ln where l <> ''),
c as (select *, md5(len(toks) || ' ' || array_to_string(toks[1:3], ' ')) leaf from b),
lim as (select greatest(10, 0.001 * count(distinct k)) enough from c),
leaves as (select leaf from c group by leaf having count(distinct k) >= (select enough from lim)),
forms as (select leaf, l, any_value(toks) toks, count(distinct k) d from c semi join leaves using (leaf) group by 1, 2),
t as (select leaf, l, d, generate_subscripts(toks, 1) p, unnest(toks) tok from forms),
f as (select *, case when tok <> '<*>' and sum(d) over (partition by leaf, p, tok) >= (select enough from lim) then 1.0 else 0 end fixed from t),
m as (select leaf, l, string_agg(case when fixed > 0 then tok else '<*>' end, ' ' order by p) template from f group by 1, 2
      having coalesce(avg(fixed) filter (p > 3), avg(fixed)) >= 0.5 and max(fixed) > 0),
inst as (select c.doc_id, c.i, c.k, leaf, template from c join m using (leaf, l)),
rec as (select leaf, template from inst group by 1, 2 having count(distinct k) >= (select enough from lim)),
gone as (select doc_id, list(i) drops, count(*) n_dropped from inst semi join rec using (leaf, template) group by doc_id)
select d.doc_id, len(string_split(coalesce(text, ''), chr(10))) n_lines, coalesce(n_dropped, 0) n_dropped,
       case when drops is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(drops, i)), chr(10)) end as text
from documents d left join gone g on g.doc_id = d.doc_id
""",
    "op1_exact_dedup": r"""
with t as (select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]', '', 'g')) h from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by h) group_size, doc_id = first_value(doc_id) over w kept, h text_sha256
from t window w as (partition by h order by n desc, doc_id rows between unbounded preceding and unbounded following)
""",
    "op8_quality_rules": r"""
with d as (select doc_id, coalesce(source, '') host, coalesce(text, '') text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) raw from d),
win as (select doc_id, i, array_to_string(words[i:i+4], ' ') s from (select doc_id, words, unnest(range(1, len(words) - 3)) i from w where len(words) >= 5)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) c from win) where c > 1),
rep as (select doc_id, sum(least(5, coalesce(lead_i - i, 5))) n_repeat_words from (select doc_id, i, lead(i) over (partition by doc_id order by i) lead_i from dup) group by doc_id),
ln as (select doc_id, host, l, len(string_split(l, ' ')) words from (
         select doc_id, host, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[ \t\x0b\x0c\r]+', ' ', 'g')) l from d) where l <> ''),
hosts as (select host, count(distinct text) total from d group by host),
common as (select host, l from (select distinct ln.host, l, text from ln join d using (doc_id)) join hosts using (host) group by host, l, total having count(*) > 20 and count(*) >= 0.02 * total),
cw as (select doc_id, sum(words) common_words from ln semi join common using (host, l) group by doc_id),
m as (select w.doc_id, len(words) n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) n_symbols, len(raw) - len(list_distinct(raw)) n_dup_lines,
             coalesce(n_repeat_words, 0) n_repeat_words, coalesce(common_words, 0) common_words
      from w left join rep on rep.doc_id = w.doc_id left join cw on cw.doc_id = w.doc_id)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
       cast(n_repeat_words as bigint) n_repeat_words, cast(common_words as bigint) common_words, base_failed,
       not base_failed and n_words - common_words >= 0.2 * n_words kept
from (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
""",
    "op13_hard_negatives": """
with v as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] q
           from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select a.id anchor_id, b.id, a.label = b.label same, list_dot_product(a.q, b.q)::bigint score from v a join v b on a.id <> b.id where a.id % 100 = 0),
pos as (select anchor_id, id positive_id, score positive_score from p where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
m as (select pos.*, p.id negative_id, p.score negative_score, row_number() over (partition by pos.anchor_id, positive_id order by p.score desc, p.id)::integer as rank
      from pos join p on p.anchor_id = pos.anchor_id and not p.same and 80 * positive_score <= 100 * p.score and p.score <= positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from m where rank <= 5
""",
}
