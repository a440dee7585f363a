"""The queries opN_<name> over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontam, html_extract, linededup, minhash, packing, ppm, quality, suffix, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"), train=~ppm.held_out())


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): test items found in documents."""
    return decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.verdicts(quality.measures(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) per document."""
    out = linededup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce("kept_text", F.lit("")).alias("kept_text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = packing.write(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.read(common.table(files, common.TEXT_ROWS))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ppm_score, op2_html_extract, op3_decontamination, op4_byte_bpe, op5_quality_rules, op6_minhash, op7_line_dedup, op8_token_files, op9_toxicity, op10_suffix_dedup)}

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

ORACLE_SQL = {
    "op3_decontamination": """
with iw as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from benchmark),
i as (select item_id, w, least(5, len(w)) k from iw where len(w) > 0),
ish as (select distinct item_id, k, array_to_string(w[s:s + k - 1], ' ') g from (select item_id, k, w, unnest(range(1, len(w) - k + 2)) s from i)),
m as (select item_id, k, count(*) m from ish group by all),
dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from documents),
dsh as (select distinct doc_id, k, array_to_string(w[s:s + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) s from dw, (select distinct k from i))),
p as (select doc_id, item_id, count(*) n from dsh join ish using (k, g) group by all)
select doc_id, item_id, m n_item_shingles, n n_shared from p join m using (item_id) where 100 * n >= 80 * m""",
    "op5_quality_rules": f"""
with d as (select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) p, w from d),
h as (select doc_id, p, [w[p], w[p + 1], w[p + 2]] x from g),
r as (select doc_id, p from h qualify count(*) over (partition by doc_id, x) > 1),
c as (select doc_id, count(distinct p + o) n from r, (select unnest([0, 1, 2]) o) group by 1),
m as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
  coalesce(n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines, len(list_filter(w, lambda x: lower(x) in ({_STOPS})))::bigint n_stop_words
  from d left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * word_chars < 200 * n_words or 100 * word_chars > 1500 * n_words or 100 * n_symbols > 5 * word_chars
    or 100 * n_stop_words < 2 * n_words or 100 * n_dup_lines > 50 * n_lines) kept, n_lines, n_stop_words from b""",
    "op7_line_dedup": """
with l as (select doc_id, ln, t, length(t) n from (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) ln from documents)),
u as (select t, n, min((doc_id, ln)) f from l where n >= 20 group by all),
c as (select t, n, f, unnest([n, n - 1]) c from u),
k as (select t, n, f, unnest([('h', c, left(t, c // 2)), ('t', c, right(t, c - c // 2))]) k from c),
gone as (select distinct a.t from k a join k b on a.k = b.k and b.f < a.f and abs(a.n - b.n) <= 1 where levenshtein(a.t, b.t) <= 1),
o as (select l.*, l.n < 20 or (u.f = (l.doc_id, l.ln) and l.t not in (select t from gone)) stays from l left join u on u.t = l.t),
s as (select doc_id, count(*) n_lines, count(*) filter (not stays) n_removed, string_agg(t, chr(10) order by ln) filter (stays) kept_text from o group by 1)
select doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, coalesce(kept_text, '') kept_text from documents left join s using (doc_id)""",
}
