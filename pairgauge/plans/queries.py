"""One query an operator. ``@query(sql)`` registers a function (spark, sf_dir) and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, xml
from ..functions import text as X
from ..operators import compare, corpus, formats, generators, reports, summaries, windows
from ..streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
N = X.NBSP


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is dear a row: a table of fewer partitions than there are cores is dealt to them."""
    d, cores = _t(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return d.repartition(cores, "doc_id") if d.rdd.getNumPartitions() < cores else d


# -- text functions over documents -----------------------------------------------------------

_BARE = "translate(text, '!?;:«»\"“”', '')"


@query(f"""
select doc_id, case when doc_id % 2 = 0 then 0 else len(regexp_extract_all(x, ' :(\\s|$)')) - len(regexp_extract_all(x, '[0-9] :(\\s|$)')) end::int nbsp_missing,
  case when doc_id % 3 = 0 then 3 * len(string_split(text, chr(10))) else 0 end::int guillemet_space, len(regexp_extract_all(text, '"[^"\\n]{{1,80}}"'))::int en_quotes
from (select doc_id, text, replace({_BARE}, '.', ' :') x from documents)""")
def typography_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    bare = F.expr(_BARE)
    x = F.when(F.col("doc_id") % 2 == 0, F.replace(bare, F.lit("."), F.lit(f"{N}:"))).otherwise(F.replace(bare, F.lit("."), F.lit(" :")))
    # three of the four guillemets added to each line are wrong
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.replace(x, F.lit("\n"), F.lit(f" «a{N}» « b »\n")), F.lit(f" «a{N}» « b »"))).otherwise(x)
    t = X.typography(x)
    return d.select("doc_id", t["nbsp_missing"].alias("nbsp_missing"), t["guillemet_space"].alias("guillemet_space"), X.typography(F.col("text"))["en_quotes"].alias("en_quotes"))


#: One phrase for each calque, in the order of their rules.
_PHRASES = (
    "la librairie", "il supporte", "vous éditez", "on sauve", "cliquez le", "appuyez la", "ce dialogue", "customiser", "initier", "consistante", "processer", "digitaux", "opportunités", "adresser un problème",
)


@query(f"""
with v as (select unnest([{", ".join(f"'{n}'" for n, *_ in X.CALQUES)}]) as key, unnest(range({len(X.CALQUES)})) r),
d as (select doc_id % {len(X.CALQUES)} r, doc_id % 3 + 1 n from documents)
select key, sum(n)::bigint total from d join v using (r) group by 1""")
def calque_totals(spark, sf_dir):
    """Each document's text with the phrase of one calque, once to three times."""
    d = _t(spark, sf_dir, "documents")
    phrase = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % len(_PHRASES) + 1).cast("int")), F.lit("."))
    x = F.concat("text", F.repeat(phrase, (F.col("doc_id") % 3 + 1).cast("int")))
    return summaries.map_totals(d.select(X.calques(x).alias("c")), "c")


def _names(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(f"""
with t as (select doc_id, list_transform(regexp_extract_all(text, '\\p{{L}}[\\p{{L}}\\p{{N}}_''’\\-]*'), lambda w: lower(w)) w from documents),
f as (select doc_id, len(list_filter(w, lambda x: x in ({_names(X.EN_FUNCTION_WORDS)}))) en, len(list_filter(w, lambda x: x in ({_names(X.EN_FUNCTION_WORDS + X.FR_FUNCTION_WORDS)}))) al from t)
select doc_id, case when al < 3 then 0.0::double else en::double / al end english_ratio from f""")
def english_ratios(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.english_ratio(F.col("text")).alias("english_ratio"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) norm, 'seg-' || substr(sha1(text), 1, 10) seg from documents")
def normalised_texts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.norm(F.col("text")).alias("norm"), X.segment_id(F.col("text")).alias("seg"))


@query("""
with c as (select conv_id, turn, translate(text, '<>`', '') t from conversations where role = 'assistant')
select conv_id, turn, trim(t, ' ' || chr(9) || chr(10) || chr(13)) clean, '<topic>' || t || '</topic>' body from c""")
def cleaned_answers(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn("t", F.translate("text", "<>`", ""))
    wrapped = F.concat(F.lit("<think>"), "text", F.lit("</think>\n```xml\n"), "t", F.lit("\n```"))
    framed = F.concat(F.lit("<THINK>"), "text", F.lit("</THINK>Sure:\n```xml\n<topic>"), "t", F.lit("</topic>\n```"))
    return c.select("conv_id", "turn", X.clean_output(wrapped).alias("clean"), X.extract_xml(framed).alias("body"))


@query("select event_id, round(value, 2) rounded, least(1, greatest(-1, value / 100)) clipped from events")
def rounded_values(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", numbers.py_round(F.col("value"), 2).alias("rounded"), numbers.clip(F.col("value") / 100).alias("clipped"))


# -- checks, scores and repairs over pairs made of whole documents ---------------------------------
# Every line of a document is a paragraph that ends in a colon; a translation has other function
# words, and one defect that doc_id % 10 names. What follows depends on the text: how many lines
# there are, how many end in a digit, which function words they hold, how long they are.

_MARKUP = '<>&!?;:.«»"“”'
_WORDS = (("the", "le"), ("and", "et"), ("of", "de"), ("is", "est"), ("to", "pour"), ("that", "que"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    bare = F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), _MARKUP, ""), "\n"), X.norm)

    def french(x):
        x = F.concat(F.lit(" "), x, F.lit(" "))
        for en, fr in _WORDS:
            x = F.replace(x, F.lit(f" {en} "), F.lit(f" {fr} "))
        return F.trim(x)

    def doc(title, intro, lines, gap, code="a:b", ident="t", head='<?xml version="1.0"?>'):
        paragraphs = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit(f"{gap}:</p>"))), "")
        return F.concat(F.lit(f'{head}\n<topic id="{ident}'), F.col("id"), F.lit('"><title>'), title, F.lit("</title><body><p>"), intro, F.lit("</p>"), paragraphs, F.lit(f"<p><codeph>{code}</codeph></p></body></topic>"))

    d = _documents(spark, sf_dir).select("doc_id", "source", F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 10).alias("k"), F.filter(bare, lambda x: x != "").alias("en"))
    d = d.withColumn("fr", F.transform("en", french)).withColumn("short", F.when(F.size("fr") > 0, F.slice("fr", 1, F.size("fr") - 1)).otherwise(F.col("fr")))
    lit = F.lit
    source = doc(lit("The page"), F.when(k == 7, '"W3C"').otherwise("Intro"), F.col("en"), "")
    page = lit("La page")
    good = doc(page, lit("Intro"), F.col("fr"), N)
    hyp = (
        F.when(k == 1, doc(page, lit("Intro"), F.col("fr"), " "))
        .when(k == 2, doc(page, lit("Intro"), F.col("fr"), N, code="a:c"))
        .when(k == 3, doc(page, lit("Intro"), F.col("short"), N, ident="u"))
        .when(k == 4, F.expr("left(good, length(good) - 9)"))
        .when(k == 5, F.col("src"))
        .when(k == 6, doc(page, lit("Intro"), F.col("short"), N))
        .when(k == 7, doc(page, F.when(F.col("doc_id") % 20 == 7, '"W3C"').otherwise("« W3C »"), F.col("fr"), N))
        .when(k == 8, doc(lit("Le Beau Titre XML"), lit("la librairie et supporter"), F.col("fr"), N))
        .when(k == 9, doc(page, lit("Intro"), F.col("fr"), N, head='<?xml version="1.0" encoding="UTF-8"?>'))
        .otherwise(F.col("good"))
    )
    d = d.withColumns({"src": source, "good": good})
    return d.select("doc_id", "source", "id", "src", hyp.alias("hyp"), F.when(k.isin(0, 1, 2, 9), F.col("good")).alias("ref"))


def _replaced(x: str) -> str:
    x = f"' ' || {x} || ' '"
    for en, fr in _WORDS:
        x = f"replace({x}, ' {en} ', ' {fr} ')"
    return f"trim({x})"


_EN, _BOTH = _names(X.EN_FUNCTION_WORDS), _names(X.EN_FUNCTION_WORDS + X.FR_FUNCTION_WORDS)
_RATIO = "case when len(list_filter({w}, lambda x: x in ({both}))) < 3 then 0.0 else len(list_filter({w}, lambda x: x in ({en})))::double / len(list_filter({w}, lambda x: x in ({both}))) end"
_TOKENS = "list_transform(regexp_extract_all({x}, '\\p{{L}}[\\p{{L}}\\p{{N}}_''’\\-]*'), lambda w: lower(w))"

#: p: a row a document. n lines, m of them in the translation, d that end in a digit, src_en and hyp_en the shares of English words.
_P = f"""
l0 as (select doc_id, source, doc_id % 10 k, list_filter(list_transform(string_split(translate(coalesce(text, ''), '{_MARKUP}', ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') en from documents),
l1 as (select *, list_transform(en, lambda x: {_replaced("x")}) fr, len(en) n from l0),
l2 as (select *, case when k = 5 then en when k in (3, 6) and n > 0 then fr[1:n - 1] else fr end h, case k when 5 then 'The page' when 8 then 'Le Beau Titre XML' else 'La page' end title,
  case when k = 7 and doc_id % 20 <> 7 then '« W3C »' when k = 7 then '"W3C"' when k = 8 then 'la librairie et supporter' else 'Intro' end intro from l1),
l3 as (select *, len(h) m, len(list_filter(h, lambda x: regexp_matches(x, '[0-9]$'))) d, {_TOKENS.format(x="'The page ' || array_to_string(en, ' ')")} sw, {_TOKENS.format(x="title || ' ' || intro || ' ' || array_to_string(h, ' ')")} hw,
  11 + length(case when k = 7 then '"W3C"' else 'Intro' end) + coalesce(list_sum(list_transform(en, lambda x: length(x) + 2)), 0) src_len,
  length(title) + 1 + length(intro) + 2 + coalesce(list_sum(list_transform(h, lambda x: length(x) + case when k = 5 then 2 else 3 end)), 0) hyp_len from l2),
l4 as (select *, {_RATIO.format(w="sw", en=_EN, both=_BOTH)} src_en, {_RATIO.format(w="hw", en=_EN, both=_BOTH)} hyp_en, n + 6 e, (k in (3, 6) and n > 0)::int lost from l3),
p as (select * exclude (src_len, hyp_len), k <> 4 xml_ok, k not in (3, 4) and lost = 0 skeleton_ok, (k = 2)::int protected_changed,
  case when k in (1, 5) then m - d when k = 7 then case when doc_id % 20 = 7 then 1 else 2 end else 0 end n_typo, case k when 8 then 2 else 0 end n_calque, case k when 8 then 2 else 0 end titlecase,
  k <> 4 and src_en > 0.5 and printf('%.3f', hyp_en)::double > 0.35 untranslated, case when k = 4 then 0 else printf('%.3f', hyp_len::double / src_len)::double end len_ratio, case when k in (0, 1, 2, 9) then 100.0::double end chrf from l4),
r as (select *, case when not (xml_ok and skeleton_ok and k <> 9) then -1.0 when untranslated then -0.5 else greatest(-1, least(1, coalesce(chrf, 0) / 100 - 0.25 * protected_changed
  - 0.08 * least(n_typo, 4) - 0.15 * n_calque - 0.1 * titlecase - case when len_ratio < 0.75 or len_ratio > 1.8 then 0.2 else 0 end)) end::double reward from p)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reward(reports.check(_pairs(spark, sf_dir)))


@query(f"with {_P} select doc_id, xml_ok, skeleton_ok, k <> 9 header_ok, protected_changed, n_typo::int n_typo, n_calque, titlecase, (k <> 4)::int titles, untranslated, len_ratio, chrf, round(reward, 9) reward from r")
def check_reports(spark, sf_dir):
    r = _checked(spark, sf_dir)
    return r.select("doc_id", "xml_ok", "skeleton_ok", "header_ok", "protected_changed", "n_typo", "n_calque", "titlecase", "titles", "untranslated", "len_ratio", "chrf", F.round("reward", 9).alias("reward"))


@query(f"""
with {_P}, s as (select *, xml_ok and skeleton_ok and k <> 9 and protected_changed = 0 structure_ok from r)
select count(*) n, count(*) filter (xml_ok) xml_ok, count(*) filter (skeleton_ok) skeleton_ok, count(*) filter (k <> 9) header_ok, count(*) filter (structure_ok) structure_ok,
  count(*) filter (untranslated) untranslated, sum(protected_changed)::bigint protected_changed, count(*) filter (k <> 4) protected_total, sum(n_typo)::bigint n_typo, sum(n_calque)::bigint n_calque, sum(titlecase)::bigint titlecase,
  count(*) filter (k <> 4) titles, count(*) filter (structure_ok and n_typo = 0 and n_calque = 0 and titlecase = 0 and not untranslated) clean_topics,
  round(avg(reward), 4) mean_reward, round(avg(chrf), 2) mean_chrf, round(avg(len_ratio), 4) mean_len_ratio from s""")
def report_summary(spark, sf_dir):
    s = summaries.report_summary(_checked(spark, sf_dir))
    return s.select("n", "xml_ok", "skeleton_ok", "header_ok", "structure_ok", "untranslated", "protected_changed", "protected_total", "n_typo", "n_calque", "titlecase", "titles", "clean_topics", "mean_reward", "mean_chrf", "mean_len_ratio")


_F = f"""{_P}, f as (select doc_id, k, lost, case when k = 4 then 0 else round((e - (k = 3)::int - lost)::double / e, 4) end::double lcs, case when k in (3, 4) then 0 else 1 end::double recall,
  case when k = 4 then ['not_well_formed'] else list_concat(case when k = 3 then ['attr_changed'] else [] end, case when lost = 1 then ['child_mismatch'] else [] end) end reasons from p),
g as (select *, case when k = 4 then 'not_well_formed' when lost = 1 then 'child_mismatch' when k = 3 then 'attr_changed' end primary_reason, len(reasons) > 0 broken,
  case when k = 4 then -1.0 when len(reasons) = 0 then 1.0 else printf('%.4f', 0.5::double * lcs + 0.2::double * recall + 0.15::double + 0.15::double)::double end score from f)"""


@query(f"with {_F} select doc_id, k <> 4 well_formed, reasons, primary_reason, broken format_broken, lcs, recall attr_recall, score format_reward from g")
def format_scores(spark, sf_dir):
    return formats.score_format(_pairs(spark, sf_dir)).select("doc_id", "well_formed", "reasons", "primary_reason", "format_broken", "lcs", "attr_recall", "format_reward")


@query(f"""
with {_F} select count(*) n, count(*) filter (k <> 4) well_formed, count(*) filter (not broken) skeleton_match, count(*) filter (k <> 4) dtd_valid, count(*) filter (broken) format_broken, 0::bigint truncated,
  round(avg(score), 9) mean_reward, round(avg(lcs), 9) mean_lcs, round(avg(recall), 9) mean_attr_recall from g""")
def format_totals(spark, sf_dir):
    s = summaries.format_summary(formats.score_format(_pairs(spark, sf_dir)))
    return s.withColumns({c: F.round(c, 9) for c in ("mean_reward", "mean_lcs", "mean_attr_recall")})


@query(f"with {_F} select unnest(reasons) reason, count(*) n from g group by 1")
def reason_histogram(spark, sf_dir):
    return summaries.reason_histogram(formats.score_format(_pairs(spark, sf_dir)))


@query(f"with {_F} select primary_reason reason, count(*) n from g where broken group by 1")
def primary_histogram(spark, sf_dir):
    return summaries.primary_histogram(formats.score_format(_pairs(spark, sf_dir)))


_V = f"""{_P}, v as (select doc_id, source, k, n, case when k = 4 then 1 else (k = 3)::int + lost end s,
  case when k in (1, 5) then n when k = 4 then 1 when k = 7 and doc_id % 20 = 7 then 2 else 0 end p from p)"""


@query(f"with {_V} select doc_id, s::int as schema, p::int punct, (s + p)::int violations, -(s + p)::double violation_reward from v")
def violation_counts(spark, sf_dir):
    return formats.count_violations(_pairs(spark, sf_dir)).select("doc_id", "schema", "punct", "violations", "violation_reward")


@query(f"""
with {_V} select count(*) n, count(*) filter (s > 0 or p > 0) violated, count(*) filter (s > 0 and p > 0) "both", count(*) filter (s = 0 and p > 0) punct_only,
  count(*) filter (s > 0 and p = 0) schema_only, sum(s + p)::bigint violations, sum(s)::bigint as schema, sum(p)::bigint punct, round(avg(-(s + p))::double, 9) mean_reward from v""")
def violation_summary(spark, sf_dir):
    return summaries.violation_summary(formats.count_violations(_pairs(spark, sf_dir))).withColumn("mean_reward", F.round("mean_reward", 9))


@query(f"""
with {_P} select doc_id, case when k = 7 and doc_id % 20 <> 7 then 1 else 0 end guillemet_open, case when k = 7 and doc_id % 20 = 7 then 2 else 0 end ascii_double_quote,
  case when k in (1, 5) then 0 else m end::int nbsp_ok_marks, case when k in (1, 5) then m + 1 else 1 end::int bad_high_punct from p where k <> 4""")
def punct_totals(spark, sf_dir):
    """Documents that do not parse have no statistics."""
    return formats.punct_stats(_pairs(spark, sf_dir)).filter("punct_stats IS NOT NULL").select("doc_id", "punct_stats.guillemet_open", "punct_stats.ascii_double_quote", "punct_stats.nbsp_ok_marks", "punct_stats.bad_high_punct")


_O = f"""{_P}, o as (select doc_id, source, k, n, case when k = 4 then -1.0 when k = 2 then -0.175 when k = 3 or lost = 1 then -0.34 when k in (1, 5) then case when n > 0 then 0.0 else 1.0 end
  when k = 7 then round(greatest(0, 1 - case when doc_id % 20 = 7 then 4 else 2 end::double / (n + 2)), 4) else 1.0 end::double score from p)"""


@query(f"with {_O} select doc_id, score >= 0 gate_passed, score oracle_reward from o")
def typography_oracle(spark, sf_dir):
    return formats.oracle(_pairs(spark, sf_dir)).select("doc_id", "gate_passed", "oracle_reward")


@query(f"with {_O} select doc_id, score reward from o")
def callback_rewards(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", xml.gated_scalar(F.col("src"), F.col("hyp")).alias("reward"))


@query(f"""
with {_P} select unnest(['linguistic', 'protected', 'guillemet_open', 'guillemet_close']) kind, unnest([sum(m), count(*), count(*) filter (k = 7 and doc_id % 20 <> 7), count(*) filter (k = 7 and doc_id % 20 <> 7)])::bigint n from p where k <> 4""")
def mark_sites(spark, sf_dir):
    return formats.sites(_pairs(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {_P} select doc_id, (k in (1, 5) and n > 0) or (k = 7 and doc_id % 20 <> 7) changed, (m + case when k = 7 and doc_id % 20 <> 7 then 2 else 0 end)::int nbsp from p""")
def aligned_repairs(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("doc_id", "hyp", xml.fix_aligned(F.col("hyp")).alias("fixed"))
    return p.select("doc_id", (F.col("fixed") != F.col("hyp")).alias("changed"), F.regexp_count("fixed", F.lit(N)).alias("nbsp"))


@query(f"""
with {_P} select doc_id, (case when k in (1, 5) then m - d else m end + case when k = 7 and doc_id % 20 <> 7 then 2 else 0 end)::int nbsp, k <> 4 whole from p""")
def simple_repairs(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("doc_id", xml.fix_simple(F.col("hyp")).alias("f"))
    return p.select("doc_id", F.regexp_count("f", F.lit(N)).alias("nbsp"), F.col("f").endswith("</topic>").alias("whole"))


@query(f"""
with {_O}, c as (select score b, case when k in (1, 5) or (k = 7 and doc_id % 20 <> 7) then 1.0 else score end a from o)
select count(*) n, count(*) filter (a > b) improved, count(*) filter (a < b) regressed, count(*) filter (a = b) unchanged, round(avg(b), 9) mean_before, round(avg(a), 9) mean_after from c""")
def repair_gain(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("src", "hyp", xml.fix_aligned(F.col("hyp")).alias("fixed"))
    both = p.select(xml.gated_scalar(F.col("src"), F.col("hyp")).alias("before"), xml.gated_scalar(F.col("src"), F.col("fixed")).alias("after"))
    return summaries.changed(both).withColumns({c: F.round(c, 9) for c in ("mean_before", "mean_after")})


_W = f"""{_P}, w as (select doc_id, case when k = 4 then 1 else (k = 9)::int + (not skeleton_ok)::int + protected_changed + (n_typo > 0)::int + (n_calque > 0)::int + (titlecase > 0)::int + untranslated::int
  + (len_ratio < 0.8 or len_ratio > 1.9)::int end::int c from p)"""


@query(f"with {_W} select doc_id, c n_problems from w")
def reference_problems(spark, sf_dir):
    return reports.problems(reports.check(_pairs(spark, sf_dir))).select("doc_id", F.size("problems").alias("n_problems"))


@query(f"""
with {_W} select case when doc_id not in (select doc_id from labels) then 'missing' when c > 0 then 'problems' else 'ok' end status, count(*) n from w group by 1""")
def verified_references(spark, sf_dir):
    """Documents without a label have no reference."""
    p = _pairs(spark, sf_dir)
    refs = p.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("id", F.col("hyp").alias("fr"))
    return reports.verify_references(refs, p.select("id", "src")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {_P}, c as (select sum(n)::bigint + 2 * count(*) p, count(*) one from p)
select unnest(['topic', 'title', 'body', 'p', 'codeph']) tag, unnest([0, 1, 1, 2, 3])::int depth, unnest([one, one, one, p, one])::bigint n from c""")
def xml_nodes(spark, sf_dir):
    n = _pairs(spark, sf_dir).select(F.inline(xml.nodes(F.col("src"))))
    return n.groupBy("tag", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("""
with g(units, n) as (select 'c', unnest(range(1, 7)) union all select 'w', unnest(range(1, 3))),
b as (select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) r, trim(regexp_replace(substr(text, 11), '\\s+', ' ', 'g')) h from benchmark),
s as (select item_id, 'r' side, r t from b union all select item_id, 'h', h from b),
w as (select item_id, side, flatten(list_transform(string_split(t, ' '), lambda x: case when length(x) > 1 and x[-1] in ('.', ',', '!') then [x[:-2], x[-1]] else [x] end)) u from s),
u as (select item_id, side, 'w' units, u from w union all select item_id, side, 'c', list_filter(string_split(replace(t, ' ', ''), ''), lambda x: x <> '') from s),
e as (select item_id, side, units, n, array_to_string(u[i:i + n - 1], chr(1)) gram from (select item_id, side, units, n, u, unnest(range(1, len(u) - n + 2)) i from u join g using (units))),
c as (select item_id, units, n, gram, count(*) filter (side = 'h') h, count(*) filter (side = 'r') r from e group by all),
o as (select item_id, units, n, sum(least(h, r)) / sum(h) p, sum(least(h, r)) / sum(r) q from c group by all having sum(h) > 0 and sum(r) > 0),
m as (select item_id, avg(p) p, avg(q) q from o group by 1)
select item_id, round(100 * 5 * p * q / (4 * p + q), 6) chrf from m""")
def chrf_scores(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark")
    score = xml.chrf(F.substring("text", F.lit(11), F.length("text")), F.col("text"))
    return b.select("item_id", F.round(score, 6).alias("chrf"))


@query("""
with f(category, per_noun, passing) as (values ('gap_fine', 16, 16), ('gap_wrong', 8, 8), ('gap_of_noun', 1, 1), ('after_inline', 15, 15), ('run_of_marks', 8, 8), ('mark_left_out', 1, 1), ('prose_left_out', 1, 1),
  ('literal_kept', 7, 7), ('literal_changed', 2, 0), ('wrapper_added', 1, 0), ('mark_in_code', 1, 0), ('more_than_xml', 4, 0), ('no_xml', 2, 0), ('siblings', 4, 1), ('narrow_space', 1, 1), ('spaced_ratio', 1, 1),
  ('more_spaces', 1, 1), ('other_forms', 2, 2), ('quotes', 4, 4))
select category, 10 * per_noun::bigint n, 10 * passing::bigint gate_passed, 0::bigint unmet from f""")
def oracle_fixtures(spark, sf_dir):
    """Fixtures by category: how many there are, pass the gates, and do not meet an expectation."""
    scored = formats.oracle(generators.fixtures(spark).withColumnRenamed("source", "src"))
    wrong = generators.unmet_expectations(scored).select("id", F.lit(1).alias("wrong"))
    rows = scored.select("id", "category", "gate_passed").join(wrong, "id", "left")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("gate_passed").alias("gate_passed"), F.count("wrong").alias("unmet"))


@query("""
select bucket, task, n from (values ('synthetic', 'translate', 500), ('mixed', 'translate', 300), ('repair', 'repair', 50), ('noop', 'noop', 50)) v(bucket, task, n)""")
def generated_buckets(spark, sf_dir):
    made = generators.synthetic_pairs(spark, 500).unionByName(generators.mixed_pairs(spark, 300))
    parts = generators.repair_pairs(made.filter("bucket = 'synthetic'")).unionByName(generators.noop_pairs(made.filter("bucket = 'synthetic'")))
    rows = made.select(parts.columns).unionByName(parts)
    return rows.groupBy("bucket", "task").agg(F.count(F.lit(1)).cast("int").alias("n"))


# -- corpora -----------------------------------------------------------------------------------------

_RAW = "concat(case when doc_id % 7 = 0 then '<!--LIGHTWEIGHT-->' else '' end, case when doc_id % 5 = 0 then '' else '<!DOCTYPE topic PUBLIC \"-//X//Y\" \"t\">' end, text)"


@query(f"""
select case when doc_id % 7 = 0 then 'lightweight' when doc_id % 5 = 0 then 'no_doctype' when strlen(raw) < 400 then 'too_small' when strlen(raw) > 4500 then 'too_large' else 'candidate' end reason, count(*) n
from (select doc_id, {_RAW} raw from documents) group by 1""")
def candidate_reasons(spark, sf_dir):
    return corpus.reason_counts(corpus.candidate_reason(_t(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW).alias("raw"))))


@query(f"""
select case when doc_id % 7 = 0 then 'lightweight' when doc_id % 5 = 0 then 'no_doctype' when strlen(raw) not between 700 and 2600 then 'size' else 'eligible' end reason, count(*) n
from (select doc_id, {_RAW} raw from documents) group by 1""")
def split_reasons(spark, sf_dir):
    return corpus.reason_counts(corpus.split_reason(_t(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW).alias("raw"))))


@query("select lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as key, min(doc_id) doc_id from documents group by 1")
def first_texts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.lower(X.norm(F.col("text"))).alias("key"))
    return corpus.first_of_each(d, "key", ["doc_id"]).select("key", "doc_id")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as topics: each line a paragraph; markup characters left out."""
    clean = F.translate("text", "<>&", "")
    body = F.replace(clean, F.lit("\n"), F.lit("</p><p>"))
    raw = F.concat(F.lit("<!DOCTYPE topic><topic><title>T</title><body><p>"), body, F.lit("</p></body></topic>"))
    return _documents(spark, sf_dir).select(F.format_string("d%08d", "doc_id").alias("path"), raw.alias("raw"))


_LINES = """
l as (select doc_id, trim(regexp_replace(unnest(string_split(translate(text, '<>&', ''), chr(10))), '\\s+', ' ', 'g')) t from documents),
s as (select format('d{:08d}', doc_id) file, t from l where length(t) between 25 and 500 and len(string_split(t, ' ')) >= 4)"""


@query(f"with {_LINES} select file, t as text, length(t) chars from s")
def segment_rows(spark, sf_dir):
    return corpus.segments(_files(spark, sf_dir)).select("file", "text", "chars")


@query(f"""
with {_LINES}, r as (select doc_id, '<!DOCTYPE topic><topic><title>T</title><body><p>' || replace(translate(text, '<>&', ''), chr(10), '</p><p>') || '</p></body></topic>' raw from documents),
n as (select file, count(*) c from s group by 1),
p as (select doc_id, length(trim(regexp_replace('T ' || translate(text, '<>&', ''), '\\s+', ' ', 'g'))) chars from documents)
select format('d{{:08d}}', doc_id) id, strlen(raw)::bigint n_bytes, 'topic' root, chars::bigint prose_chars from r join p using (doc_id) join n on file = format('d{{:08d}}', doc_id)
where strlen(raw) between 700 and 3500 and c >= 2 and chars >= 250""")
def eligible_topics(spark, sf_dir):
    return corpus.topics(_files(spark, sf_dir)).select("id", "n_bytes", "root", "prose_chars")


def _held(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    """The files of documents that are labelled as poor."""
    poor = _t(spark, sf_dir, "labels").filter("quality = 0").select(F.format_string("d%08d", "doc_id").alias("path")).distinct()
    return files.join(poor, "path", "left_semi").select(F.col("path").alias("id"), F.col("raw").alias("src"))


@query(f"""
with {_LINES}, held as (select doc_id from labels where quality = 0), h as (select distinct lower(t) as key from l where doc_id in (select doc_id from held))
select lower(t) as key, min(file) file from s where substr(file, 2)::bigint not in (select doc_id from held) and lower(t) not in (select key from h) group by 1""")
def leak_free_segments(spark, sf_dir):
    files = _files(spark, sf_dir)
    held = _held(spark, sf_dir, files)
    clean = corpus.drop_leaks(corpus.segments(files), held, corpus.held_sentences(held))
    return corpus.first_of_each(clean, "key", ["file", "pos"]).select("key", "file")


@query(f"""
with {_LINES}, held as (select doc_id from labels where quality = 0), h as (select distinct lower(t) as key from l where doc_id in (select doc_id from held))
select count(*) n from s where substr(file, 2)::bigint not in (select doc_id from held) and lower(t) in (select key from h)""")
def leak_count(spark, sf_dir):
    files = _files(spark, sf_dir)
    held = _held(spark, sf_dir, files)
    return corpus.leaks(corpus.segments(files), held, corpus.held_sentences(held)).agg(F.count(F.lit(1)).alias("n"))


@query("""
with o as (select doc_id, row_number() over (order by sha1('7:' || doc_id), doc_id) n from documents)
select doc_id, case when n <= 40 then 'test' when n <= 56 then 'dev' else 'train' end split from o""")
def hash_split(spark, sf_dir):
    return corpus.split_by_hash(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"test": 40, "dev": 16}, 7, rest="train")


@query("""
with o as (select doc_id, source, sha1('3:' || doc_id) o from documents), r as (select *, row_number() over (partition by source order by o, doc_id) n from o)
select doc_id, source from r where n <= 3 order by o, doc_id limit 50""")
def capped_groups(spark, sf_dir):
    return corpus.cap_per_group(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", 3, 3, key="doc_id", total=50)


@query("""
select doc_id, source, bool_or(doc_id % 97 = 0) over (partition by source) held from documents""")
def held_families(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.hold_out_families(d, "source", F.col("doc_id") % 97 == 0).select("doc_id", "source", "held")


@query("select source as split, count(*) n, sum(n_chars)::bigint bytes, sum(('0x' || substr(sha256(doc_id::varchar), 1, 15))::bigint)::varchar ids_digest from documents group by 1")
def split_manifest(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("split"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("n_bytes"))
    return corpus.manifest(d)


@query("select lang as tag, count(*) n from documents group by 1")
def tag_histogram(spark, sf_dir):
    return corpus.tag_counts(_t(spark, sf_dir, "documents").select(F.col("lang").alias("tag")))


# -- ordered rows ------------------------------------------------------------------------------------


@query("select event_id, (value - avg(value) over w) / (stddev_pop(value) over w + 1e-6) advantage from events window w as (partition by user_id)")
def group_advantages(spark, sf_dir):
    return windows.advantages(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", "advantage")


@query("select l_orderkey, max(l_discount) - min(l_discount) spread from lineitem group by 1 having max(l_discount) - min(l_discount) >= 0.05")
def spread_groups(spark, sf_dir):
    return windows.spread_groups(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount", 0.05)


@query("select user_id, arg_max(event_id, (ts, event_id)) event_id from events group by 1")
def last_writes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"))
    return windows.last_write(e, "user_id", "at").select("user_id", F.col("at.event_id").alias("event_id"))


@query("""
select event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) b from events) where b is null or b <> event_type""")
def without_repeats(spark, sf_dir):
    return windows.drop_repeats(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "event_type")


@query("""
select event_id from (select *, coalesce(sum((value > 50)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) h from events) where h < 5""")
def scan_prefix(spark, sf_dir):
    return windows.scan_until(_t(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("value") > 50, 5).select("event_id")


@query("""
select user_id, count(*) scanned, count(*) filter (value > 50) hits, case when count(*) filter (value > 50) >= 30 then 'found_target' when max(value) >= 99 then 'scan_wall' when max(value / 2) >= 49 then 'budget' else 'pool_exhausted' end reason
from events group by 1""")
def stop_reasons(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumns({"elapsed": F.col("value"), "spent": F.col("value") / 2})
    return windows.stop_reason(e, "user_id", F.col("value") > 50, 30, 99.0, 49.0)


@query("select event_id, ((row_number() over (partition by user_id order by event_id) - 1) // 8)::bigint chunk, ((row_number() over (partition by user_id order by event_id) - 1) % 4)::int shard from events")
def chunks_and_shards(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id")
    return windows.shards(windows.chunks(e, "user_id", "event_id", 8), "user_id", "event_id", 4).select("event_id", "chunk", "shard")


@query("""
with recursive o as (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars, doc_id) k from documents),
f as (select doc_id, source, n_chars, k, 0::bigint batch, 1::bigint n_rows from o where k = 1
  union all select o.doc_id, o.source, o.n_chars, o.k, case when f.n_rows + 1 > 8 or (f.n_rows + 1) * o.n_chars > 40000 then f.batch + 1 else f.batch end,
    case when f.n_rows + 1 > 8 or (f.n_rows + 1) * o.n_chars > 40000 then 1 else f.n_rows + 1 end from f join o on o.source = f.source and o.k = f.k + 1)
select doc_id, source, n_chars, batch from f""")
def packed_batches(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return windows.pack(d, "source", "doc_id", "n_chars", 8, 40_000)


@query("""
select epoch, doc_id, row_number() over (partition by epoch order by sha1('5:' || epoch || ':' || doc_id), doc_id) place from documents, (select unnest(range(2)) epoch)""")
def epoch_orders(spark, sf_dir):
    return windows.epochs(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 2, 5).select("epoch", "doc_id", F.col("place").cast("long").alias("place"))


# -- aggregates --------------------------------------------------------------------------------------


@query("select l_returnflag, count(*) n, count(*) filter (l_discount > l_tax) improved, count(*) filter (l_discount < l_tax) regressed, count(*) filter (l_discount = l_tax) unchanged, round(avg(l_tax), 9) mean_before, round(avg(l_discount), 9) mean_after from lineitem group by 1")
def before_after(spark, sf_dir):
    return summaries.changed(_t(spark, sf_dir, "lineitem"), "l_tax", "l_discount", ("l_returnflag",)).withColumns({c: F.round(c, 9) for c in ("mean_before", "mean_after")})


@query("select event_type, count(value) n, median(value) median, min(value) min, max(value) max, round(avg(value), 9) mean from events group by 1")
def latency_summary(spark, sf_dir):
    return summaries.latency(_t(spark, sf_dir, "events"), "value", ("event_type",)).withColumn("mean", F.round("mean", 9))


@query("""
with n as (select l_suppkey, l_returnflag, l_linestatus, count(*) need, count(*) filter (l_linenumber > 1) have from lineitem group by all)
select l_suppkey, sum(least(need, have))::double / sum(need) recall from n group by 1""")
def multiset_recall(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return summaries.multiset_recall(li, li.filter("l_linenumber > 1"), ["l_suppkey"], ["l_returnflag", "l_linestatus"])


_JUDGED = "case when doc_id % 7 = 0 then 'n/a' else cast(quality * 4 + 1 as varchar(5)) end"


@query(f"""
with j as (select {_JUDGED} score from labels) select avg(try_cast(score as double)) mean_score, count(try_cast(score as double)) n_score from j""")
def judge_means(spark, sf_dir):
    return summaries.judge_means(_t(spark, sf_dir, "labels").select(F.expr(_JUDGED).alias("score")), ("score",))


@query("select doc_id, (doc_id % 5 + 1)::varchar faithfulness, case when doc_id % 3 = 0 then 'n/a' else (doc_id % 4)::varchar end fluency, lang || ' ' || source note from documents")
def parsed_judgements(spark, sf_dir):
    told = F.to_json(F.struct((F.col("doc_id") % 5 + 1).alias("faithfulness"), F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise((F.col("doc_id") % 4).cast("string")).alias("fluency"), F.concat_ws(" ", "lang", "source").alias("note")))
    answer = F.concat(F.translate("text", "{}", ""), F.lit(" Well: "), told, F.lit(" as of "), F.col("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", summaries.parse_judgement(answer).alias("j")).select("doc_id", "j.faithfulness", "j.fluency", "j.note")


@query("select ((event_id % 100) // 25)::bigint bin, count(*) n, round(avg(value), 6) mean_value from events group by 1")
def step_means(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("step", F.col("event_id") % 100 + 1)
    return summaries.step_means(e, ("value",), 25).withColumn("mean_value", F.round("mean_value", 6))


@query("with s as (select event_id % 100 + 1 step, max(value) v from events group by 1) select step, v as value from s order by v desc, step limit 1")
def best_step(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("step", F.col("event_id") % 100 + 1)
    return summaries.best_step(e.groupBy("step").agg(F.max("value").alias("mean_reward")))


@query("select source, arg_min(doc_id, (strlen(text), doc_id)) doc_id, min(strlen(text))::int size from documents group by 1")
def shortest_documents(spark, sf_dir):
    return summaries.shortest(_t(spark, sf_dir, "documents"), F.octet_length("text"), "doc_id", ("source",))


@query("""
with l as (select user_id pod, epoch(ts) t, case when event_id % 2 = 0 then 'create' else 'terminate' end e from events),
p as (select pod, min(t) filter (e = 'create') a, max(t) filter (e = 'terminate') b from l group by 1)
select pod, b - a as "seconds", round(0.4 * (b - a) / 3600, 6) usd from p where a is not null and b is not null""")
def pod_spend(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("pod"), F.col("ts").cast("timestamp").alias("t"), F.when(F.col("event_id") % 2 == 0, "create").otherwise("terminate").alias("event"), F.lit(0.4).alias("cost_per_hr")
    )
    return summaries.pod_spend(e).withColumn("usd", F.round("usd", 6))


@query("""
with r as (select l_suppkey batch, sum(l_quantity) tok_s, l_suppkey = 9 failed from lineitem group by 1)
select coalesce(max(batch), 1)::bigint batch from r where not failed and batch < 9 and tok_s >= 1.15 * (select tok_s from r where batch = 1)""")
def useful_batch(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("batch")).agg(F.sum("l_quantity").alias("tok_s"))
    return summaries.largest_useful_batch(li.withColumn("failed", F.col("batch") == 9))


@query("select o_custkey, count(*) n from orders group by 1 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return summaries.duplicates(_t(spark, sf_dir, "orders"), "o_custkey")


@query("select rewards, count(*) n from (select list(l_returnflag order by l_linenumber, l_returnflag) rewards from lineitem group by l_orderkey) group by 1")
def reward_groups(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: s["l_returnflag"]).alias("rewards"))
    return summaries.reward_groups(rows)


@query("""
select i.item_id, (10 * 4 + 2 * i.item_id) * 24 params, ceil(ceil(i.item_id * 10 / 8.0) / 4.0)::bigint * 2 steps from (select item_id from benchmark) i""")
def adapter_arithmetic(spark, sf_dir):
    i = F.col("item_id")
    params = numbers.lora_parameters(F.lit(2), F.lit(20), i, F.lit(24))
    return _t(spark, sf_dir, "benchmark").select("item_id", params.cast("long").alias("params"), numbers.optimizer_steps(i * 10, F.lit(8), F.lit(4), F.lit(2)).alias("steps"))


@query("select doc_id, floor(length(text) / 2.8 + 48)::int cap, least(640, greatest(160, floor(length(text) / 3 + 48)))::int bounded from documents")
def token_caps(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", numbers.token_cap(F.col("text")).alias("cap"), numbers.bounded_cap(F.col("text")).alias("bounded"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def hourly_windows(spark, sf_dir):
    w = logs.windowed(_t(spark, sf_dir, "events"), "ts", "event_type", "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# -- comparing systems -----------------------------------------------------------------------------------


def _systems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _t(spark, sf_dir, "documents")
    one = d.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 100).cast("double").alias("m"), F.lit("one").alias("hyp"))
    known = d.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    two = known.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 90).cast("double").alias("m"), F.lit("two").alias("hyp"))
    return one, two


@query("""
select 'm' measure, count(*) n, avg(b - a) mean, count(*) filter (b > a) up, count(*) filter (b < a) down, count(*) filter (b = a) equal
from (select n_chars % 100 a, n_chars % 90 b from documents where doc_id in (select doc_id from labels))""")
def paired_deltas(spark, sf_dir):
    a, b = _systems(spark, sf_dir)
    return compare.bootstrap_at_scale(compare.deltas(a, b, ("m",)), 20).drop("low", "high")


@query()
def paired_bootstrap(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    a, b = labels.select("id", F.col("toxic").alias("m")), labels.select("id", F.col("quality").alias("m"))
    return compare.paired_bootstrap(compare.deltas(a, b, ("m",)))


@query("""
with k as (select doc_id id, ('0x' || substr(sha1('11:' || doc_id), 1, 1))::int % 2 = 1 flip from labels join documents using (doc_id)),
v as (select id, flip, case when id % 5 = 0 then 'tie' when id % 2 = 0 then 'A' else 'B' end w from k)
select count(*) n_judged, count(*) filter ((w = 'A' and not flip) or (w = 'B' and flip)) sys1, count(*) filter ((w = 'A' and flip) or (w = 'B' and not flip)) sys2, count(*) filter (w = 'tie') tie from v""")
def blind_tally(spark, sf_dir):
    a, b = (s.dropDuplicates(["id"]) for s in _systems(spark, sf_dir))  # an id's answers are the same
    topics = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), F.lit("s").alias("src"))
    key = compare.blind_pairs(a, b, topics, 11)
    w = F.when(F.col("id") % 5 == 0, "tie").when(F.col("id") % 2 == 0, "A").otherwise("B")
    return compare.tally(compare.unblind(key.select("pair", w.alias("winner"), F.lit("").alias("reason")), key))


@query(f"""
with {_V}, o2 as (select o.doc_id, o.score from (with {_O} select doc_id, score from o) o), j as (select v.*, score, v.doc_id not in (select doc_id from labels) gone from v join o2 using (doc_id))
select source as file, count(*) n, count(*) filter (gone) n_missing, round(avg(s + p) filter (not gone), 9) mean_violations, round(avg(score) filter (not gone), 9) mean_reward, count(*) filter (not gone and score >= 0) n_gate_passed
from j group by 1""")
def rescored_files(spark, sf_dir):
    """Documents without a label have lost their source."""
    p = _pairs(spark, sf_dir)
    sources = p.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("id", "src")
    s = formats.rescore_summary(formats.rescore(p.select("id", F.col("source").alias("file"), "hyp"), sources))
    return s.select("file", "n", "n_missing", F.round("mean_violations", 9).alias("mean_violations"), F.round("mean_reward", 9).alias("mean_reward"), "n_gate_passed")


# -- text of documents, once more: heads, references, names ------------------------------------------

_HEAD = '<?xml version="1.0"?>\n<!DOCTYPE t [<!ENTITY a "b">]>\n'


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML texts with a head, elements around each line, and references between lines."""
    body = F.replace(F.translate("text", "<>&", ""), F.lit("\n"), F.lit("</p>&nbsp;&#160;&#xA0;&#8239;<p>"))
    return _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.concat(F.lit(f"{_HEAD}<t><p>"), body, F.lit("</p></t>")).alias("raw"))


@query(f"""
with m as (select doc_id, translate(text, '<>&', '') t from documents), n as (select *, len(string_split(t, chr(10))) - 1 c from m)
select doc_id, {len(_HEAD)} head, '<t><p>' || left(t, 3) body, length(t) + 31 * c + 14 + {len('<?xml version="1.0"?>') + 2} bare_head, 3 * c::bigint broad, c::bigint narrow, trim(regexp_replace(t, '\\s+', ' ', 'g')) bare
from n where length(t) >= 3 and strpos(left(t, 3), chr(10)) = 0""")
def xml_heads(spark, sf_dir):
    """Heads, bodies, lengths without the document type, no-break references as characters, and texts without
    tags, for documents whose first line has three characters."""
    m = _marked(spark, sf_dir).filter(F.regexp_extract("raw", r"<t><p>([^\n<]{3})", 1) != "")
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("long")
    wide, narrow = X.expand_nbsp(F.col("raw")), X.expand_nbsp(F.col("raw"), narrow=True)
    return m.select(
        "doc_id",
        F.length(X.prolog(F.col("raw"))).alias("head"),
        F.substring(X.body(F.col("raw")), 1, 9).alias("body"),
        F.length(X.strip_doctype(F.col("raw"))).cast("long").alias("bare_head"),
        count(wide, N).alias("broad"),
        count(narrow, X.NNBSP).alias("narrow"),
        X.norm(X.strip_tags(narrow)).alias("bare"),
    )


@query("select doc_id, replace(translate(text, '&', ''), chr(10), '<&\"é' || chr(160) || chr(10)) decoded, length(translate(text, '&', '')) + 5 * (len(string_split(text, chr(10))) - 1) places from documents")
def decoded_references(spark, sf_dir):
    raw = F.replace(F.translate("text", "&", ""), F.lit("\n"), F.lit("&lt;&amp;&quot;&#233;&nbsp;&#xA;"))
    d = _t(spark, sf_dir, "documents").select("doc_id", xml.decode_mapped(raw).alias("d"))
    return d.select("doc_id", F.col("d.text").alias("decoded"), F.size("d.spans").cast("long").alias("places"))


@query("""
select doc_id, case when doc_id % 2 = 0 then 'src1' else lang end family, source split,
  case doc_id % 3 when 0 then 'Repair the typography of this document.' || chr(10) when 1 then 'Return this document as it is if nothing is wrong.' || chr(10) else '' end || text asked,
  substr(text, greatest(n_chars // 2 - 12, 0)::int + 1, (n_chars // 2 + 13 - greatest(n_chars // 2 - 12, 0))::int) around from documents""")
def names_and_prompts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    i = F.col("doc_id")
    name = F.when(i % 2 == 0, F.concat(F.lit("src1-"), "lang", F.lit("_x"))).otherwise(F.concat("lang", F.lit("-src_1")))
    task = F.when(i % 3 == 0, "repair").when(i % 3 == 1, "noop").otherwise("translate")
    path = F.concat(F.lit("/data.x/"), "source", F.lit("_"), i.cast("string"), F.lit(".jsonl"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return d.select("doc_id", X.family(name, ["src1", "src"]).alias("family"), X.split_label(path).alias("split"), X.messages("s", F.col("text"), task)[1]["content"].alias("asked"), X.excerpt(F.col("text"), half).alias("around"))


@query("""
select l_orderkey, l_linenumber, case when l_quantity < 30 then list_concat(list_transform(range(l_quantity::int), lambda x: -100), range((l_linenumber * 5)::int))[1:30] else [] end labels,
  l_returnflag in ('A', 'R') hit from lineitem""")
def labels_and_targets(spark, sf_dir):
    """Masked prompts of l_quantity ids before completions of 5 * l_linenumber, within 30; names by alternation."""
    li = _t(spark, sf_dir, "lineitem")
    ids = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array())
    labels = X.completion_labels(ids(F.col("l_quantity").cast("int")), ids((F.col("l_linenumber") * 5).cast("int")), 30)
    hit = F.rlike(F.concat(F.lit("A.R."), F.col("l_returnflag")), X.alternation(F.array(F.lit("R"), F.lit("A"))))
    return li.select("l_orderkey", "l_linenumber", F.transform(F.coalesce(labels, F.array()), lambda x: x.cast("long")).alias("labels"), hit.alias("hit"))


@query(f"""
with w as (select doc_id, {_TOKENS.format(x="text || case doc_id % 4 when 0 then ' și sau în' when 1 then ' the și' else '' end")} w from documents),
c as (select doc_id, len(list_filter(w, lambda x: x in ({_names(X.RO_FUNCTION_WORDS)})))::double ro, len(list_filter(w, lambda x: x in ({_names(X.RO_FUNCTION_WORDS + X.EN_FUNCTION_WORDS)}))) al from w),
r as (select doc_id, case when al < 1 then 0.0 else ro / al end r from c)
select doc_id, case when r >= 0.85 then 5 when r >= 0.7 then 4 when r >= 0.5 then 3 when r >= 0.3 then 2 else 1 end fluency from r""")
def romanian_scores(spark, sf_dir):
    more = F.when(F.col("doc_id") % 4 == 0, " și sau în").when(F.col("doc_id") % 4 == 1, " the și").otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", X.romanian_fluency(F.concat("text", more)).alias("fluency"))


@query("""
with w as (select doc_id, string_split(trim(regexp_replace(replace(text, 'ß', 's'), '[^\\p{L}]+', ' ', 'g')), ' ')[1:8] w from documents)
select doc_id, (len(list_filter(range(2, len(w) + 1), lambda i: doc_id % 2 = 0 and length(w[i]) >= 2 and not list_contains(w, upper(w[i][1]) || lower(w[i][2:])))))::int bad from w where len(w) >= 2""")
def title_words(spark, sf_dir):
    """Title-cased words: half of the titles have every word's first letter raised, and the source has them as they were."""
    ws = F.slice(F.split(F.trim(F.regexp_replace(F.replace("text", F.lit("ß"), F.lit("s")), r"[^\p{L}]+", " ")), " "), 1, 8)
    d = _t(spark, sf_dir, "documents").select("doc_id", ws.alias("w")).filter(F.size("w") >= 2)
    raised = F.transform("w", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x)))))
    hyp = F.when(F.col("doc_id") % 2 == 0, F.array_join(raised, " ")).otherwise(F.lower(F.array_join("w", " ")))
    return d.select("doc_id", X.titlecase(F.array_join("w", " "), hyp).alias("bad"))


@query("""
select event_id, ts::timestamp as at from events""")
def any_timestamps(spark, sf_dir):
    """Epoch seconds, ISO with Z and ISO local time all become the same time."""
    e = _t(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    i = F.col("event_id") % 3
    told = F.when(i == 0, (F.unix_micros("t") / 1e6).cast("decimal(20,6)").cast("string")).when(i == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return e.select("event_id", X.any_timestamp(told).cast("timestamp_ntz").alias("at"))


# -- joins, projections and arithmetic ----------------------------------------------------------------


@query("select documents.doc_id id, source, lang src from documents join labels using (doc_id)")
def joined_topics(spark, sf_dir):
    """Outputs of documents whose topic is known; the topics are those with a label."""
    d = _t(spark, sf_dir, "documents")
    topics = d.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("src"))
    return reports.join_topics(d.select(F.col("doc_id").alias("id"), "source"), topics).select("id", "source", "src")


@query("select source, doc_id, case when quality = 1 then 'train' when quality = 0 then 'test' else 'unused' end split from documents left join labels using (doc_id)")
def split_labels(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return corpus.label_by_path(_t(spark, sf_dir, "documents").withColumn("path", F.col("doc_id")), labels).select("source", "doc_id", "split")


@query("select doc_id, case when toxic = 1 then text else '' end text from documents join labels using (doc_id)")
def kept_payloads(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return summaries.keep_payload(d, "text", F.col("toxic") == 1).select("doc_id", "text")


@query("""
select l_orderkey, l_linenumber, l_quantity >= 40 - 1 hit_cap, case when l_discount > 0 then round(l_quantity / l_discount, 6) end tok_s, round(l_quantity / 50, 6) roof, floor(l_orderkey * 0.05)::bigint warmup from lineitem""")
def generation_measures(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("new_tokens"), F.lit(40).alias("max_new"), F.col("l_discount").cast("double").alias("latency_s"))
    g = summaries.generation_rows(li)
    again = numbers.tokens_per_second(F.col("new_tokens"), F.col("latency_s"))
    same = F.when(again.eqNullSafe(F.col("tok_s")), F.round("tok_s", 6))
    return g.select("l_orderkey", "l_linenumber", "hit_cap", same.alias("tok_s"), F.round(numbers.roof_fraction(F.col("new_tokens"), F.lit(50)), 6).alias("roof"), numbers.warmup_steps(F.col("l_orderkey"), 0.05).alias("warmup"))


@query("select round(arg_min(value, (ts, event_id)) - arg_max(value, (ts, event_id)), 9) usd from events where event_id % 2 = 0")
def balance_spend(spark, sf_dir):
    """Every other row of the ledger tells no balance."""
    e = _t(spark, sf_dir, "events").select((F.col("ts").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, 0)")).alias("t"), "event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("client_balance"))
    return summaries.balance_spend(e).withColumn("usd", F.round("usd", 9))


@query("""
with m as (select l_returnflag part, l_linestatus, count(*) w, max(l_linenumber) layers from lineitem group by 1, 2), s as (select part, max(layers) n_layers, sum(4 * (w + 10) * layers)::bigint params from m group by 1),
c as (select unnest([1, 1, 2, 2, 3]) rank, unnest(['all', 'all', 'two', 'two', 'one']) plan, unnest(['A', 'N', 'N', 'R', 'A']) part),
b as (select rank, plan, sum(params)::bigint params, (1000 + sum(params) * 10 + 50)::bigint bytes from c join s using (part) group by 1, 2)
select plan, params, bytes, bytes < 1000 + 50 + 10 * (select sum(params) from s where part in ('A')) + 1 fits, rank = (select coalesce(min(rank) filter (bytes < 1000 + 50 + 10 * (select sum(params) from s where part in ('A')) + 1), max(rank)) from b) chosen from b""")
def adapter_choice(spark, sf_dir):
    """Adapter sizes of parts made of lineitem's groups, and which of three plans fits a device that the smallest fills."""
    maps = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("part"), F.col("l_linestatus").alias("name")).agg(F.count(F.lit(1)).alias("width_in"), F.max("l_linenumber").alias("layers"))
    sizes = summaries.adapter_sizes(maps.withColumn("width_out", F.lit(10)), 4)
    plans = spark.createDataFrame([(1, "all", "A"), (1, "all", "N"), (2, "two", "N"), (2, "two", "R"), (3, "one", "A")], "rank int, plan string, part string")
    device = sizes.filter("part = 'A'").select((F.lit(1000 + 50 + 1) + 10 * F.col("params")).alias("d")).first()[0]  # one row
    return summaries.adapter_choice(sizes, plans, 1000, 50, device)


@query("select event_type, round(avg(value), 9) mean, avg(value) < 50 and min(event_id) >= 1 run from events group by 1")
def next_stages(spark, sf_dir):
    """Whether the mean of each kind of event is short of 50 and its least id pays for a stage of cost 1."""
    out = summaries.may_run(_t(spark, sf_dir, "events"), F.col("event_id"), 1, "value", 50.0, ("event_type",))
    return out.withColumn("mean", F.round("mean", 9))


@query("select doc_id, floor(length(text) / 2.8 + 48) > 640 deferred from documents")
def deferred_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", numbers.deferred(F.col("text"), 640).alias("deferred"))


@query("select a.p_partkey, levenshtein(a.p_name, b.p_name)::int distance from part a join part b on b.p_partkey = a.p_partkey + 1")
def edit_distances(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return p.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "next").alias("distance"))


@query("""
with e as (select user_id, event_id, (event_id % 97) * 3 s, (event_id % 97) * 3 + 1 + event_id % 5 e from events),
o as (select *, max(e) over (partition by user_id order by s, e, event_id rows between unbounded preceding and 1 preceding) before from e),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by user_id order by s, e, event_id) island from o),
m as (select user_id, island, min(s) s, max(e) e from g group by 1, 2)
select user_id, count(*) n, sum(e - s)::bigint length, max(s)::bigint last from m group by 1""")
def merged_spans(spark, sf_dir):
    i = F.col("event_id")
    spans = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(((i % 97) * 3).cast("int").alias("s"), ((i % 97) * 3 + 1 + i % 5).cast("int").alias("e"))).alias("spans"))
    m = spans.select("user_id", windows.merge_spans(F.col("spans")).alias("m"))
    return m.select("user_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("length"), F.array_max(F.transform("m", lambda x: x["s"])).cast("long").alias("last"))


@query("""
with recursive e as (select user_id, (event_id % 61) * 2 s, (event_id % 61) * 2 + 1 + event_id % 4 e from events),
u as (select distinct user_id, s, e from e), b as (select user_id, s, max(e) e from u group by 1, 2), o as (select user_id, s, e, row_number() over (partition by user_id order by s) k from b),
f as (select user_id, k, s, e from o where k = 1 union all select o.user_id, o.k, case when o.s >= f.e then o.s else f.s end, case when o.s >= f.e then o.e else f.e end from f join o on o.user_id = f.user_id and o.k = f.k + 1)
select user_id, count(distinct s) n, max(e)::bigint last from f group by 1""")
def free_spans(spark, sf_dir):
    """Spans kept greedily: the first, then each that starts at or after the end of the one kept before."""
    i = F.col("event_id")
    spans = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(((i % 61) * 2).cast("int").alias("s"), ((i % 61) * 2 + 1 + i % 4).cast("int").alias("e"))).alias("spans"))
    m = spans.select("user_id", windows.free_spans(F.col("spans")).alias("m"))
    return m.select("user_id", F.size("m").cast("long").alias("n"), F.element_at("m", -1)["e"].cast("long").alias("last"))


@query("select user_id, arg_max(event_id, (ts, event_id)) event_id, count(*) n from events group by 1")
def replayed_steps(spark, sf_dir):
    """The last row of each key of a log, as a stream would keep it."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return logs.replay(e, "user_id", ("ts", "event_id")).select("user_id", "event_id").join(n, "user_id")


@query("""
with e as (select user_id, value, event_id from events), t as (select user_id, max(value) v from e group by 1)
select e.user_id, min(event_id) step, max(v) as value from e join t on e.user_id = t.user_id and e.value = t.v group by 1""")
def best_rows(spark, sf_dir):
    return logs.best_so_far(_t(spark, sf_dir, "events").withColumnRenamed("event_id", "step"), "user_id", "value").select("user_id", "step", "value")


@query("select doc_id in (select doc_id from labels) known, count(*) n from documents group by 1")
def held_out_check(spark, sf_dir):
    """Documents with a label and those without, found to have no key in common."""
    d, labels = _t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id").distinct()
    a, b = d.join(labels, "doc_id", "left_semi").withColumn("known", F.lit(True)), d.join(labels, "doc_id", "left_anti").withColumn("known", F.lit(False))
    corpus.assert_disjoint(a, b, "doc_id")
    return a.unionByName(b).groupBy("known").agg(F.count(F.lit(1)).alias("n"))
