"""Synthetic bilingual pairs, repairs of them, and fixtures of the typography oracle.

Rows are pure functions of an index, so any part of a table can be made anew on its own."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import xml
from ..functions.text import NBSP, NNBSP
from .formats import oracle

# --- fixed values: words of the generated sentences --------------------------------------
NOUNS = (
    ("note", "la note"), ("file", "le fichier"), ("page", "la page"), ("list", "la liste"), ("value", "la valeur"),
    ("name", "le nom"), ("step", "l'étape"), ("menu", "le menu"), ("view", "la vue"), ("table", "la table"),
)
TEMPLATES = (
    ("See {en}: details {i}.", "Voir {fr}{n}: détails {i}."),
    ("Is {en} open? Answer {i}.", "Ouvrir {fr}{n}? Réponse {i}."),
    ("Save {en}! Copy {i}.", "Garder {fr}{n}! Copie {i}."),
    ("Read {en}; then close {i}.", "Lire {fr}{n}; puis fermer {i}."),
)
MIXED = (
    ("Open <codeph>xs:{i}</codeph> for {en}: done.", "Ouvrir <codeph>xs:{i}</codeph> pour {fr}{n}: fini."),
    ("Meet {en} at 12:30; copy {i}.", "Retrouver {fr} à 12:30{n}; copie {i}."),
    ("See http://example.com/a:b and {en}: {i}.", "Voir http://example.com/a:b et {fr}{n}: {i}."),
)
# ------------------------------------------------------------------------------------------


def topic(body: Column, title: Column | str = "Titre", ident: Column | str = "t1") -> Column:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE topic PUBLIC "-//OASIS//DTD DITA Topic//EN" "topic.dtd">\n<topic id="'
    return F.concat(F.lit(head), col(ident), F.lit('">\n  <title>'), col(title), F.lit("</title>\n  <body>\n    "), body, F.lit("\n  </body>\n</topic>\n"))


def _filled(templates: tuple[tuple[str, str], ...], side: int, i: Column, noun: Column) -> Column:
    picked = F.element_at(F.array(*[F.lit(t[side]) for t in templates]), (i % len(templates) + 1).cast("int"))
    for slot, value in (("{i}", i.cast("string")), ("{n}", F.lit(NBSP)), ("{en}", noun), ("{fr}", noun)):
        picked = F.replace(picked, F.lit(slot), value)
    return picked


def synthetic_pairs(spark: SparkSession, n: int, bucket: str = "synthetic", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """n pairs: nouns and templates take turns by the index."""
    i = F.col("i")
    noun = lambda side: F.element_at(F.array(*[F.lit(x[side]) for x in NOUNS]), (i % len(NOUNS) + 1).cast("int"))
    ident = F.format_string(f"{bucket}-%05d", i)
    rows = spark.range(n).withColumnRenamed("id", "i")
    para = lambda side: F.concat(F.lit("<p>"), _filled(templates, side, i, noun(side)), F.lit("</p>"))
    return rows.select(
        "i",
        ident.alias("id"),
        F.lit(bucket).alias("bucket"),
        F.lit("translate").alias("task"),
        F.concat(F.lit(f"{bucket}-"), noun(0)).alias("family"),
        topic(para(0), "Title", ident).alias("source_xml"),
        topic(para(1), "Titre", ident).alias("target_xml"),
        F.lit(False).alias("verified_real"),
    )


def mixed_pairs(spark: SparkSession, n: int) -> DataFrame:
    """Pairs whose sentences hold literals beside the marks."""
    return synthetic_pairs(spark, n, "mixed", MIXED)


def repair_pairs(pairs: DataFrame, n: int = 50) -> DataFrame:
    """The first n pairs whose target scores 1.0 and, with plain spaces for its no-break spaces, less
    but with all gates passed: the source of a repair is that worse text. Fewer than n is an error."""
    bad = F.replace("target_xml", F.lit(NBSP), F.lit(" "))
    some = _whole(pairs.filter(F.instr("target_xml", NBSP) > 0)).withColumn("_bad", bad)
    score = xml.gated_scalar(F.col("target_xml"), F.col("_bad"))  # below 0: a gate fails
    return _derived(some.withColumn("_r", score).filter("_r >= 0 AND _r < 1"), F.col("_bad"), "repair", n)


def noop_pairs(pairs: DataFrame, n: int = 50) -> DataFrame:
    """The first n pairs whose target scores 1.0 against itself, so nothing is to be done. Fewer than n is an error."""
    return _derived(_whole(pairs), F.col("target_xml"), "noop", n)


def _whole(pairs: DataFrame) -> DataFrame:
    """Pairs whose target scores 1.0 against itself."""
    return pairs.withColumn("_own", xml.gated_scalar(F.col("target_xml"), F.col("target_xml"))).filter("_own = 1").drop("_own")


def _derived(pairs: DataFrame, source: Column, task: str, n: int) -> DataFrame:
    first = pairs.orderBy("i").limit(n)
    # the count rides along, so that a shortfall fails the job that reads the rows
    total = first.agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") < n, F.raise_error(F.concat(F.lit(f"{task}: {n} pairs asked for, found "), "_n"))).otherwise(F.col("_n")).alias("_n"))
    rows = first.crossJoin(F.broadcast(total)).filter("_n > 0")  # one row
    return rows.select("i", F.concat(F.lit(f"{task}-"), "id").alias("id"), F.lit(task).alias("bucket"), F.lit(task).alias("task"), "family", source.alias("source_xml"), "target_xml", "verified_real")


def failing_targets(pairs: DataFrame) -> DataFrame:
    """Pairs whose target does not score 1.0: a generator's self-check expects none."""
    return oracle(pairs.select("id", F.col("source_xml").alias("src"), F.col("target_xml").alias("hyp"))).filter("oracle_reward < 1.0").select("id", "oracle_reward", "gate_failures")


# -- fixtures: what the oracle has to say, rule by rule ----------------------------------------

#: Ways to write the space before a mark, and whether the oracle takes them.
GAPS = (("char", NBSP, True), ("decimal", "&#160;", True), ("hexadecimal", "&#xa0;", True), ("name", "&nbsp;", True), ("blank", " ", False), ("none", "", False))
_CASE = "id string, category string, source string, hyp string, raw boolean, expect_gate boolean, expect_reward double, expect_ambiguous boolean, reward_lt_id string, reward_le_id string"


def _cases() -> Iterator[tuple]:
    """Rows of _CASE. A rule is a sentence about each noun, in both languages, and what must come of it."""

    def case(rule: str, k: object, source: str, hyp: str, gate: bool = True, reward: float | None = 1.0, unsure: bool | None = None, below: str | None = None, most: str | None = None, raw: bool = False) -> tuple:
        return f"{rule}/{k}", rule, source, hyp, raw, gate, reward if gate else None, unsure, below, most

    p = lambda x: f"<p>{x}</p>"
    n, codes = NBSP, ("xi:text", "oxy:end", "a:b", "xsl:when", "xs:token")
    for k, (en, fr) in enumerate(NOUNS):
        source = p(f"Close {en}: part {k}.")
        told = lambda gap, k=k, fr=fr: p(f"Fermer {fr}{gap}: partie {k}.")
        yield case("gap_of_noun", k, source, told(n))
        good = f"gap_of_noun/{k}"
        for tag in ("b", "i", "ph", "cite", "q"):
            held = p(f"Print <{tag}>{en}</{tag}>! Part {k}.")
            yield case("after_inline", f"{k}-{tag}-in", held, p(f"Imprimer <{tag}>{fr}{n}</{tag}>! Partie {k}."))
            yield case("after_inline", f"{k}-{tag}-out", held, p(f"Imprimer <{tag}>{fr}</{tag}>&#160;! Partie {k}."))
            yield case("after_inline", f"{k}-{tag}-blank", held, p(f"Imprimer <{tag}>{fr}</{tag}> ! Partie {k}."), reward=0.0)
        for j, run in enumerate(("?!", "!!", "??", "!?")):
            asked = p(f"Lost {en}{run} Part {k}.")
            yield case("run_of_marks", f"{k}-{j}", asked, p(f"Perdu {fr}{n}{run} Partie {k}."))
            yield case("run_of_marks", f"{k}-{j}-glued", asked, p(f"Perdu {fr}{run} Partie {k}."), reward=0.0)
        yield case("mark_left_out", k, source, p(f"Fermer {fr} en partie {k}."), reward=0.0, below=good)
        yield case("prose_left_out", k, source, p("Fermer."), reward=0.0, below=good)
        code, other = codes[k % 5], codes[(k + 1) % 5]
        named = p(f"Call {code} of {en}.")
        yield case("literal_kept", f"{k}-name", named, p(f"Appeler {code} pour {fr}."))
        yield case("literal_changed", f"{k}-other", named, p(f"Appeler {other} pour {fr}."), gate=False, below=f"literal_kept/{k}-name")
        yield case("literal_changed", f"{k}-spaced", named, p(f"Appeler {code.replace(':', n + ':')} pour {fr}."), gate=False, below=f"literal_kept/{k}-name")
        for j, (kind, text) in enumerate((("clock", f"0{k}:45"), ("score", f"{k}:7"), ("address", f"https://example.org/{k}:x"), ("file", f"part{k}.xml"), ("style", ":hover"), ("code", "<codeph>k:v</codeph>"))):
            yield case("literal_kept", f"{k}-{kind}", p(f"Take {text} with {en}; part {j}."), p(f"Prendre {text} avec {fr}{n}; partie {j}."))
        yield case("wrapper_added", k, source, p(f"Fermer {fr} <codeph>:</codeph> partie {k}."), gate=False, below=good)
        yield case("mark_in_code", k, source, p(f"Fermer <codeph>{fr}:</codeph> partie {k}."), gate=False, below=good)
        for kind, before, after in (("lead", "Voici :\n", ""), ("thought", "<think>oui</think>", ""), ("fence", "```\n", "\n```"), ("tail", "", "\nFin.")):
            yield case("more_than_xml", f"{k}-{kind}", source, f"{before}{{doc}}{after}", gate=False, below=good, raw=True)
        yield case("no_xml", f"{k}-cut", source, f"<topic><body><p>Fermer {fr}", gate=False, below=good, raw=True)
        yield case("no_xml", f"{k}-torn", source, f"<topic><p>Fermer {fr}</body></topic>", gate=False, below=good, raw=True)
        rows = lambda *x, k=k: "<ol>" + "".join(f'<li id="r{k}{c}">{t}</li>' for c, t in x) + "</ol>"
        listed = rows(("x", en), ("y", "end"))
        yield case("siblings", f"{k}-kept", listed, rows(("x", fr), ("y", "fin")))
        yield case("siblings", f"{k}-moved", listed, rows(("y", "fin"), ("x", fr)), gate=False, below=f"siblings/{k}-kept")
        yield case("siblings", f"{k}-lost", listed, rows(("x", fr)), gate=False, below=f"siblings/{k}-kept")
        styled = lambda *x, t: f"<p {' '.join(x)}>{t}</p>"
        yield case("siblings", f"{k}-attributes", styled('id="s"', 'platform="p"', t=en), styled('platform="p"', 'id="s"', t=fr), gate=False)
        yield case("narrow_space", k, source, told(NNBSP), reward=0.0, unsure=True, most=good)
        yield case("spaced_ratio", k, p(f"Cut {en} {k + 2} : 3 now."), p(f"Couper {fr} {k + 2} : 3 ici."), reward=None, unsure=True)
        yield case("more_spaces", k, source, p(f"Fermer{n}{fr}{n}: partie{n}{k}."), most=good)
        yield case("other_forms", f"{k}-ligature", p(f"The ﬂow of {en}: part {k}."), p(f"Le ﬂux de {fr}{n}: partie {k}."))
        yield case("other_forms", f"{k}-wide", source, p(f"Fermer {fr}： partie {k}."), reward=0.0, below=good)
        quoted = p(f'Say "{en}" to part {k}.')
        yield case("quotes", f"{k}-spaced", quoted, p(f"Dire «{n}{fr}{n}» à la partie {k}."))
        yield case("quotes", f"{k}-inline", p(f'Say "<b>{en}</b>" to part {k}.'), p(f"Dire «<b>{n}{fr}{n}</b>» à la partie {k}."))
        yield case("quotes", f"{k}-blank", quoted, p(f"Dire « {fr} » à la partie {k}."), reward=0.0, below=f"quotes/{k}-spaced")
        yield case("quotes", f"{k}-english", quoted, p(f'Dire "{fr}" à la partie {k}.'), reward=0.0, below=f"quotes/{k}-spaced")


def fixtures(spark: SparkSession) -> DataFrame:
    """Cases of the oracle with what is expected of them: every noun with every mark and way to write
    the space before it, and the rules of _cases."""
    nouns = spark.createDataFrame([(k, e, f) for k, (e, f) in enumerate(NOUNS)], "k int, en string, fr string").coalesce(1)
    marks = spark.createDataFrame([(m,) for m in "!:;?"], "mark string")
    gaps = spark.createDataFrame(list(GAPS), "gap string, space string, fine boolean")
    grid = nouns.crossJoin(F.broadcast(marks)).crossJoin(F.broadcast(gaps))  # 10 x 4 x 6
    c = F.col
    para = lambda *parts: topic(F.concat(F.lit("<p>"), *parts, F.lit(".</p>")), "T")
    product = grid.select(
        F.concat_ws("/", F.lit("gap"), "gap", "mark", c("k").cast("string")).alias("id"),
        F.when(c("fine"), "gap_fine").otherwise("gap_wrong").alias("category"),
        para(F.lit("Here is "), c("en"), c("mark"), F.lit(" more")).alias("source"),
        para(F.lit("Voici "), c("fr"), c("space"), c("mark"), F.lit(" encore")).alias("hyp"),
        F.lit(True).alias("expect_gate"),
        c("fine").cast("double").alias("expect_reward"),
        F.lit(None).cast("boolean").alias("expect_ambiguous"),
        F.when(~c("fine"), F.concat_ws("/", F.lit("gap"), F.lit("char"), "mark", c("k").cast("string"))).alias("reward_lt_id"),
        F.lit(None).cast("string").alias("reward_le_id"),
    )
    rules = spark.createDataFrame(list(_cases()), _CASE).coalesce(1)
    hyp = F.when(c("raw"), F.replace("hyp", F.lit("{doc}"), topic(F.lit("<p>Fermer la note&#160;: partie 1.</p>"), "T"))).otherwise(topic(c("hyp"), "T"))
    rules = rules.withColumns({"hyp": hyp, "source": topic(c("source"), "T")}).drop("raw")
    return product.unionByName(rules)


def unmet_expectations(scored: DataFrame) -> DataFrame:
    """(id, unmet): the expectations that scored fixtures do not meet; rewards are held against those of
    the named rows by a join of the table with itself."""
    known = scored.select(F.col("id").alias("of"), F.col("oracle_reward").alias("value"))
    low, most = known.toDF("reward_lt_id", "lt"), known.toDF("reward_le_id", "le")
    c = F.col
    unmet = {
        "gate": c("gate_passed") != c("expect_gate"),
        "reward": c("oracle_reward") != c("expect_reward"),
        "ambiguous": c("expect_ambiguous") & (F.size("ambiguous_spans") == 0),
        "sign": (c("oracle_reward") >= 0) != c("gate_passed"),
        "below": c("reward_lt_id").isNotNull() & ~F.coalesce(c("oracle_reward") < c("lt"), F.lit(False)),
        "at_most": c("reward_le_id").isNotNull() & ~F.coalesce(c("oracle_reward") <= c("le"), F.lit(False)),
    }
    rows = scored.join(low, "reward_lt_id", "left").join(most, "reward_le_id", "left")
    listed = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in unmet.items()]))
    return rows.select("id", listed.alias("unmet")).filter(F.size("unmet") > 0)
