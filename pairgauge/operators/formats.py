"""Format scores, violation counts and the gated typography oracle.

A DTD is outside Spark: ``dtd_errors`` names a column with a validator's error count (null or absent:
not validated, which counts as valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import xml
from ..functions.numbers import clip, py_round
from ..functions.trees import REASON_ORDER

GATES = ("xml_only", "well_formed", "dtd_valid", "structure", "protected_attributes", "protected_literals")


def primary_reason(reasons: Column) -> Column:
    ranked = F.filter(F.array(*[F.lit(r) for r in REASON_ORDER]), lambda r: F.array_contains(reasons, r))
    return F.coalesce(F.get(ranked, F.lit(0)), F.get(reasons, F.lit(0)))


def _errors(df: DataFrame, dtd_errors: str | None) -> Column:
    return F.coalesce(F.col(dtd_errors), F.lit(0)) if dtd_errors and dtd_errors in df.columns else F.lit(0)


def score_format(pairs: DataFrame, cap: Column | None = None, dtd_errors: str | None = None) -> DataFrame:
    """Adds hyp_xml, well_formed, skeleton_match, lcs, attr_recall, reasons, primary_reason, truncated,
    format_broken and format_reward to rows (src, hyp)."""
    cap = F.coalesce(cap, F.lit(False)) if cap is not None else F.lit(False)
    p = pairs.withColumn("hyp_xml", X.extract_xml(F.col("hyp")))
    p = p.withColumn("_d", xml.diff(F.col("src"), F.col("hyp_xml")))
    ok, parsed = F.col("_d.src_ok") & F.col("_d.hyp_ok"), F.col("_d.src_ok")
    valid = ok & (_errors(p, dtd_errors) == 0)
    match = F.coalesce(F.col("_d.same"), F.lit(False))
    cut = F.when(ok, cap & ~match).otherwise(cap & parsed)
    listed = F.when(ok, F.concat(F.col("_d.reasons"), F.when(valid, F.array()).otherwise(F.array(F.lit("dtd_invalid"))).cast("array<string>"))).otherwise(F.array(F.lit("not_well_formed")))
    p = p.withColumns(
        {
            "well_formed": ok,
            "skeleton_match": match,
            "dtd_valid": valid,
            "lcs": F.coalesce("_d.lcs", F.lit(0.0)),
            "attr_recall": F.coalesce("_d.attr_recall", F.lit(0.0)),
            "truncated": cut,
            "reasons": F.array_distinct(F.concat(F.when(cut, F.array(F.lit("truncated"))).otherwise(F.array()).cast("array<string>"), listed)),
        }
    )
    broken = (F.size("reasons") > 0) | ~match | ~valid
    part = 0.50 * F.col("lcs") + 0.20 * F.col("attr_recall") + 0.15 + F.when(valid, 0.15).otherwise(0.0) - F.when(F.col("truncated"), 0.30).otherwise(0.0)
    score = F.when(~ok, F.when(F.col("truncated"), -0.7).otherwise(-1.0)).when(~broken, 1.0).otherwise(py_round(clip(part), 4))
    return p.withColumns({"primary_reason": primary_reason(F.col("reasons")), "format_broken": broken, "format_reward": score}).drop("_d")


def count_violations(pairs: DataFrame, cap: Column | None = None, dtd_errors: str | None = None) -> DataFrame:
    """Adds violations, schema, punct, parts, punct_detail and violation_reward to rows (src, hyp)."""
    cap = F.coalesce(cap, F.lit(False)) if cap is not None else F.lit(False)
    p = pairs.withColumn("hyp_xml", X.extract_xml(F.col("hyp")))
    p = p.withColumn("_d", xml.diff(F.col("src"), F.col("hyp_xml")))
    d, well = F.col("_d"), F.col("_d.src_ok") & F.col("_d.hyp_ok")
    text = F.coalesce(d["hyp_text"], X.strip_tags(X.expand_nbsp(F.col("hyp_xml"))))
    quoted = d["src_text"].rlike('["“”«»]')
    quotes = F.when(quoted, F.regexp_count(text, F.lit('["“”]'))).otherwise(0)
    count = lambda n: F.when(well, F.coalesce(d[n], F.lit(0))).otherwise(0)
    structural = well & (count("tag_mismatch") + count("attr_value") + count("child_order") == 0)
    numbers = {
        "tag_mismatch": count("tag_mismatch"),
        "attr_value": count("attr_value"),
        "child_order": count("child_order"),
        "dtd_errors": F.when(well, _errors(p, dtd_errors)).otherwise(0).cast("int"),
        "not_well_formed": F.when(d["hyp_ok"], 0).otherwise(1),
        "truncation": F.when(cap & ~structural, 1).otherwise(0),
        "bad_high_punct": X.unspaced_marks(text),
        "english_quotes": quotes,
    }
    parts = F.when(d["src_ok"], F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*numbers.values())))
    p = p.withColumns({"parts": parts, "skeleton_match": structural})
    schema = F.aggregate(F.array(*[F.col("parts")[k] for k in list(numbers)[:6]]), F.lit(0), lambda a, x: a + x)
    punct = F.col("parts")["bad_high_punct"] + F.col("parts")["english_quotes"]
    p = p.withColumns({"schema": F.coalesce(schema, F.lit(1)), "punct": F.coalesce(punct, F.lit(0))})
    p = p.withColumn("violations", F.col("schema") + F.col("punct"))
    spans = F.regexp_extract_all(text, F.lit(rf"(?s).{{0,16}}(?<!{X.NBSP})[?!:;]"), 0)
    detail = F.struct(
        F.slice(F.transform(spans, lambda s: F.replace(s, F.lit(X.NBSP), F.lit("\\u00a0"))), 1, 12).alias("spans"),
        quoted.alias("source_has_quotation"),
        F.regexp_count(text, F.lit("«")).alias("guillemet_open"),
        F.regexp_count(text, F.lit("»")).alias("guillemet_close"),
    )
    return p.withColumns({"punct_detail": F.when(d["src_ok"], detail), "violation_reward": (-F.col("violations")).cast("double")}).drop("_d")


def punct_stats(df: DataFrame, hyp: str = "hyp") -> DataFrame:
    """Adds ``punct_stats``: marks and quotes over all text nodes, null where there is no tree."""
    p = df.withColumn("_t", xml.diff(F.lit("<a/>"), X.extract_xml(F.col(hyp)))["hyp_all"])
    t = F.col("_t")
    stats = F.struct(
        F.regexp_count(t, F.lit("«")).alias("guillemet_open"),
        F.regexp_count(t, F.lit("»")).alias("guillemet_close"),
        F.regexp_count(t, F.lit('"')).alias("ascii_double_quote"),
        F.regexp_count(t, F.lit("[“”]")).alias("curly_double_quote"),
        X.spaced_marks(t).alias("nbsp_ok_marks"),
        X.unspaced_marks(t).alias("bad_high_punct"),
    )
    return p.withColumn("punct_stats", F.when(t.isNotNull(), stats)).drop("_t")


def oracle(pairs: DataFrame, dtd_errors: str | None = None) -> DataFrame:
    """Adds gates, gate_failures, gate_passed, typography, ambiguous_spans, missing_literals and
    oracle_reward to rows (src, hyp): below 0 if a gate fails, else the typography score."""
    p = pairs.withColumn("_o", xml.oracle_facts(F.col("src"), F.col("hyp")))
    o, tree = F.col("_o"), F.coalesce(F.col("_o.src_ok") & F.col("_o.hyp_ok"), F.lit(False))
    value = {
        "xml_only": tree,
        "well_formed": tree,
        "dtd_valid": tree & (_errors(p, dtd_errors) == 0),
        "structure": tree & F.coalesce(o["same"], F.lit(False)),
        "protected_attributes": tree & F.coalesce(o["same_attributes"], F.lit(False)),
        "protected_literals": tree & (F.size(F.coalesce(o["missing"], F.array())) == 0),
    }
    flat = lambda side: F.flatten(F.transform(o[side], lambda f: f["sites"]))
    total = lambda side, name: F.aggregate(F.transform(o[side], lambda f: f[name]), F.lit(0), lambda a, x: a + x)
    some = lambda sites, test: F.size(F.filter(sites, test))
    spoken = lambda s: s["kind"] == "linguistic"
    p = p.withColumns(
        {
            "_s": flat("src_flows"),
            "_h": flat("hyp_flows"),
            "gates": F.struct(*[value[g].alias(g) for g in GATES]),
            "gate_failures": F.array_compact(F.array(*[F.when(~value[g], F.lit(g)) for g in GATES])),
        }
    )
    s, h = F.col("_s"), F.col("_h")
    p = p.withColumns(
        {
            "_n": F.struct(
                some(s, spoken).alias("source_linguistic"),
                some(h, spoken).alias("hyp_linguistic"),
                some(h, lambda x: spoken(x) & ~x["ok"]).alias("bad_spacing"),
                some(h, lambda x: x["kind"].startswith("guillemet") & ~x["ok"]).alias("guillemet_bad"),
                total("src_flows", "quotes").alias("source_quote_marks"),
                total("hyp_flows", "guillemets").alias("hyp_guillemets"),
                total("hyp_flows", "en_quotes").alias("en_quotes"),
                total("hyp_flows", "nbsp").alias("nbsp_count"),
            )
        }
    )
    n = F.col("_n")
    omitted = F.greatest(F.lit(0), n["source_linguistic"] - n["hyp_linguistic"])
    omitted_quotes = F.greatest(F.lit(0), n["source_quote_marks"] - n["hyp_guillemets"])
    english = F.when(n["source_quote_marks"] > 0, n["en_quotes"]).otherwise(0)
    penalty = omitted + n["bad_spacing"] + n["guillemet_bad"] + omitted_quotes + english
    base = n["source_linguistic"] + n["source_quote_marks"]
    score = F.when(penalty == 0, 1.0).otherwise(py_round(F.greatest(F.lit(0.0), 1.0 - penalty / F.greatest(base, F.lit(1))), 4))
    kept = [n[k].alias(k) for k in ("source_linguistic", "hyp_linguistic", "bad_spacing", "guillemet_bad", "source_quote_marks", "hyp_guillemets", "nbsp_count")]
    typography = F.struct(
        score.alias("score"),
        *kept,
        omitted.alias("omitted_marks"),
        omitted_quotes.alias("omitted_quotes"),
        english.alias("english_quotes_penalized"),
        penalty.alias("penalty"),
        base.alias("base"),
        F.slice(F.transform(F.filter(h, lambda x: spoken(x) & ~x["ok"]), lambda x: x["excerpt"]), 1, 12).alias("bad_excerpts"),
    )
    unsure = F.filter(h, lambda x: x["ambiguous"])
    failures = F.size("gate_failures")
    p = p.withColumns(
        {
            "gate_passed": failures == 0,
            "typography": F.when(tree, typography),
            "ambiguous_spans": F.when(tree, unsure).otherwise(F.array()),
            "missing_literals": F.slice(F.coalesce(o["missing"], F.array()), 1, 12),
            "structure_reasons": F.coalesce(o["reasons"], F.array()),
            "error": o["error"],
        }
    )
    low = py_round(-1.0 + 0.99 * ((len(GATES) - failures) / len(GATES)), 4)
    gated = F.when(~o["src_ok"], F.lit(-1.0)).when(F.col("gate_passed"), F.col("typography.score")).otherwise(low)
    return p.withColumn("oracle_reward", gated).drop("_o", "_s", "_h", "_n")


def sites(scored: DataFrame, side: str = "hyp") -> DataFrame:
    """(id, flow, site fields): one row a mark, for analysis."""
    flowed = scored.select("id", F.posexplode(xml.oracle_facts(F.col("src"), F.col("hyp"))[f"{side}_flows"]).alias("flow", "_f"))
    return flowed.select("id", "flow", F.inline("_f.sites"))


def rescore(rows: DataFrame, sources: DataFrame, published: tuple[str, ...] = ()) -> DataFrame:
    """Both evaluators beside published values that stay untouched; rows whose source is missing count."""
    both = rows.join(sources.select("id", "src"), "id", "left")
    keep = [c for c in published if c in rows.columns]
    scored = oracle(count_violations(both.filter("src IS NOT NULL")))
    scored = scored.select("file", "id", *keep, "violations", "oracle_reward", "gate_passed", F.lit(False).alias("source_missing"))
    lost = both.filter("src IS NULL").select("file", "id", *keep, F.lit(None).cast("int").alias("violations"), F.lit(None).cast("double").alias("oracle_reward"), F.lit(None).cast("boolean").alias("gate_passed"), F.lit(True).alias("source_missing"))
    return scored.unionByName(lost)


def rescore_summary(rescored: DataFrame) -> DataFrame:
    """One row a file: means are null where all sources are missing."""
    return rescored.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("source_missing").alias("n_missing"),
        F.avg("violations").alias("mean_violations"),
        F.avg("oracle_reward").alias("mean_reward"),
        F.count_if(F.coalesce("gate_passed", F.lit(False))).alias("n_gate_passed"),
    )
