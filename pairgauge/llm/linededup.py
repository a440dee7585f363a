"""Line dedup by a deletion-neighbourhood join, native.

Lines (split at \\n) of ``min_chars`` code points or more are compared over the whole corpus. An
occurrence goes if an equal line, or one within edit distance 1, stands earlier; order is by
(doc_id, line number), nulls last. Whether that earlier line stays itself makes no difference, so
the result does not depend on the order of work. With ``short``, shorter lines that are not blank
go too if an equal one stands earlier (an edit would make too many of them alike); without it, and
if blank, they always stay.

A deletion neighbourhood of whole long lines would have as many variants as there are bytes, so it
is refined in three equi-joins that lose no pair. For lines of c and of c (or c+1) characters:
1. halves: one edit leaves the head or the tail half equal, so lines that share neither drop out;
2. segments: of those left, variants without one of c/64 (8 or more) segments are joined;
3. characters: variants of the segment without one character, and the segment itself, are joined.
Variants with the same gap and length are all within one substitution of each other, and a
segment equal to another's variant is one insertion away, so the earliest of each class is all a
line needs: no pairs of a group are made. The earliest partner of each line is verified with
levenshtein on the texts.

Rows with equal doc_id and text are one document and get one result; null texts stay null and have
no lines. Texts that share an id are documents of their own; lines of equal id and number go by a hash of
the text. Edits in a line within one character of it are found at any length. An empty table gives an empty
result; extra columns are only returned by ``clean_documents`` and where ``also`` names them. Lines
are known by 128 bits of hashes, so equal lines are deleted without their texts being compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, let, table

MIN_CHARS = 20
SEGMENT = 64
SEGMENTS = 8
_LAST = 2**63 - 1


def _doc_key() -> Column:
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("x"))


def _takes_part(t: Column, min_chars: int, short: bool) -> Column:
    long = F.length(t) >= min_chars
    return long | t.rlike(r"[^\x20\x09-\x0D]") if short else long


def _lines(docs: DataFrame, min_chars: int, short: bool = False) -> DataFrame:
    """(d, x, ln, t, n, h, g): the lines that take part, n their length, h and g the two halves of a 128-bit hash."""
    rows = docs.select(_doc_key().alias("k"), F.posexplode(F.split("text", "\n")).alias("ln", "t"))
    rows = rows.select("k.d", "k.x", "ln", "t", F.length("t").alias("n")).filter(_takes_part(F.col("t"), min_chars, short))
    return rows.withColumns({"h": F.xxhash64("t", "n"), "g": F.xxhash64(F.lit("line"), "t")})


def _ends(c: Column, half: Column) -> Column:
    """The two keys of a line in class c: its head, and its tail of c - half characters."""
    tail = F.substring("t", F.col("n") - (c - half) + 1, c - half)
    return F.array(F.xxhash64(F.lit("head"), c, F.substring("t", F.lit(1), half)), F.xxhash64(F.lit("tail"), c, tail))


def _multi(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key belongs to two lines or more; counted before anything is shuffled."""
    keys = df.groupBy(key).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select(key)
    keys = table(keys)
    return df.join(F.broadcast(keys) if few(keys) else keys, key)


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g, partner_d, partner_ln): lines whose first occurrence has an earlier one within one edit."""
    lines = _lines(docs, min_chars)
    classes = F.array(F.col("n"), F.col("n") - 1)
    ends = F.flatten(F.transform(classes, lambda c: F.transform(_ends(c, F.floor(c / 2).cast("int")), lambda k: F.struct(c.alias("c"), k.alias("k")))))
    keys = lines.select("h", F.inline(ends)).groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    keys = table(keys.filter("lo != hi").select("k"))
    if few(keys):
        some = lines.select("*", F.inline(ends)).join(F.broadcast(keys), "k")
        cs = F.collect_set("c")
    else:
        gated = lines.select("h", "g", F.inline(ends)).join(keys, "k").groupBy("h", "g").agg(F.collect_set("c").alias("cs"))
        some = lines.join(gated, ["h", "g"])
        cs = F.first("cs")
    some = some.groupBy("h", "g").agg(F.min(F.struct("d", "ln", "x")).alias("first"), F.first("t").alias("t"), F.first("n").alias("n"), cs.alias("cs"))
    some = table(some.select("h", "g", "first", "t", "n", "cs"))

    # segments: (class, gap) and what surrounds the gap
    cut = some.select("h", "g", "t", "n", F.struct("first.d", "first.ln").alias("first"), F.explode("cs").alias("c"))
    cut = cut.withColumn("parts", F.greatest(F.lit(SEGMENTS), F.ceil(F.col("c") / SEGMENT).cast("int")))
    cut = cut.select("h", "g", "t", "n", "first", "c", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    cut = cut.withColumns({"s": F.floor(F.col("c").cast("long") * F.col("j") / F.col("parts")).cast("int"), "e": F.floor(F.col("c").cast("long") * (F.col("j") + 1) / F.col("parts")).cast("int")})
    cut = cut.withColumn("right", F.col("c") - F.col("e"))
    cut = cut.select(
        "h",
        "g",
        "n",
        "first",
        F.xxhash64("c", "j", F.substring("t", F.lit(1), F.col("s")), F.when(F.col("right") > 0, F.substring("t", F.col("n") - F.col("right") + 1, F.col("right"))).otherwise("")).alias("k"),
        F.substring("t", F.col("s") + 1, F.col("n") - F.col("s") - F.col("right")).alias("mid"),
    )
    cut = _multi(cut, "k")

    # characters: the segment itself (gap 0) and each variant without one character
    gaps = F.sequence(F.lit(0), F.length("mid"))
    less = F.transform(gaps, lambda p: F.struct(p.alias("p"), F.when(p == 0, F.col("mid")).otherwise(F.concat(F.substring("mid", F.lit(1), p - 1), F.substring(F.col("mid"), p + 1, F.length("mid")))).alias("v")))
    var = table(cut.select("h", "g", "n", "first", "k", F.inline(less)).select("h", "g", "n", "first", "p", F.xxhash64("k", "v").alias("v")))
    # lines alike in variant, gap and length are a class; its earliest partner is that of all its lines
    alike = var.groupBy("v", "p", "n").agg(F.min("first").alias("sub"), F.max("first").alias("last"))
    alike = table(alike)
    whole = alike.groupBy("v").agg(F.min(F.when(F.col("p") == 0, F.col("sub"))).alias("zero"), F.min(F.when(F.col("p") > 0, F.col("sub"))).alias("one"))
    whole = whole.filter("zero is not null and one is not null")
    early = alike.join(whole, "v", "left").withColumn("o", F.when(F.col("p") == 0, F.col("one")).otherwise(F.least("zero", "sub")))
    early = table(early.filter("o < last").select("v", "p", "n", "o"))
    early = var.join(F.broadcast(early) if few(early) else early, ["v", "p", "n"])
    early = early.filter("o < first").groupBy("h", "g").agg(F.min("o").alias("o"))

    # the edit distance itself, on the texts of the line and its earliest partner
    named = some.select("h", "g", "t", "first.d", "first.ln")
    asked = early.join(named.select("h", "g", "t"), ["h", "g"]).select("h", "g", "t", F.col("o.d").alias("d"), F.col("o.ln").alias("ln"))
    told = asked.join(named.select(F.col("t").alias("pt"), "d", "ln"), ["d", "ln"])
    return told.filter((F.col("t") != F.col("pt")) & (F.levenshtein("t", "pt", 1) >= 0)).select("h", "g", F.col("d").alias("partner_d"), F.col("ln").alias("partner_ln")).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, also: tuple[str, ...] = (), short: bool = False) -> DataFrame:
    """(doc_id, text, kept_text, n_lines, n_removed) and the columns ``also`` for every row of ``docs``."""
    d = docs.select("doc_id", "text")
    first = _lines(d, min_chars, short).groupBy("h", "g").agg(F.min(F.struct("d", "ln", "x")).alias("f"))
    gone = table(removed_lines(d, min_chars).select("h", "g").distinct())
    first = first.join(F.broadcast(gone) if few(gone) else gone, ["h", "g"], "left_anti")
    kept = first.groupBy(F.col("f.d").alias("d"), F.col("f.x").alias("x")).agg(F.collect_list("f.ln").alias("lns"))
    rows = docs.select("doc_id", "text", *also, _doc_key().alias("_k"))
    rows = rows.join(kept, (rows["_k.d"] == kept["d"]) & (rows["_k.x"] == kept["x"]), "left")
    lns = F.coalesce("lns", F.array().cast("array<int>"))
    flags = lambda ls, at: F.filter(ls, lambda x, i: ~_takes_part(x, min_chars, short) | F.array_contains(at, i))
    both = F.when(F.col("text").isNotNull(), let(F.split("text", "\n"), lambda ls: F.struct(F.size(ls).alias("n"), flags(ls, lns).alias("kept"))))
    rows = rows.select("doc_id", "text", *also, both.alias("b"))
    return rows.select(
        "doc_id",
        "text",
        *also,
        F.array_join("b.kept", "\n").alias("kept_text"),
        F.coalesce(F.col("b.n"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("b.n") - F.size("b.kept"), F.lit(0)).cast("long").alias("n_removed"),
    )



def clean_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with the lines that stay (exact copies go at every length), n_chars (if there is such a column) made to fit."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    out = dedup_lines(docs.select("doc_id", "text", F.struct(*cols).alias("_row")), min_chars, ("_row",), short=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
