"""Building corpora: eligibility, segments, leakage, caps and splits.

Random order is hash order (``text.hash_order``), so a split does not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import xml


def _head(col: str, n: int) -> Column:
    return F.substring(col, 1, n)


def split_reason(df: DataFrame, raw: str = "raw", dtd_errors: str | None = None) -> DataFrame:
    """Adds ``reason``: the first rule that a topic of the 700..2600 byte split breaks, or eligible."""
    size = F.octet_length(raw)
    invalid = F.coalesce(F.col(dtd_errors), F.lit(0)) > 0 if dtd_errors else F.lit(False)
    public = F.regexp_extract(_head(raw, 1500), r'PUBLIC\s+"([^"]+)"', 1)
    return df.withColumns(
        {
            "public_id": F.nullif(public, F.lit("")),
            "reason": F.when(_head(raw, 600).contains("LIGHTWEIGHT"), "lightweight")
            .when(~_head(raw, 1500).contains("<!DOCTYPE"), "no_doctype")
            .when(~size.between(700, 2600), "size")
            .when(invalid, "dtd")
            .otherwise("eligible"),
        }
    )


def candidate_reason(df: DataFrame, raw: str = "raw", dtd_errors: str | None = None) -> DataFrame:
    """Adds ``reason``: the first rule that a scan candidate breaks, or candidate."""
    size = F.octet_length(raw)
    invalid = F.coalesce(F.col(dtd_errors), F.lit(0)) > 0 if dtd_errors else F.lit(False)
    return df.withColumn(
        "reason",
        F.when(_head(raw, 1200).contains("LIGHTWEIGHT"), "lightweight")
        .when(~_head(raw, 2000).contains("<!DOCTYPE"), "no_doctype")
        .when(size < 400, "too_small")
        .when(size > 4500, "too_large")
        .when(invalid, "dtd")
        .otherwise("candidate"),
    )


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def segments(files: DataFrame) -> DataFrame:
    """(file, pos, tag, src, text, chars) for rows (path, raw): blocks of 25..500 characters and 4 words."""
    cheap = files.filter(~_head("raw", 600).contains("LIGHTWEIGHT"))  # native tests before any parse
    rows = cheap.select(F.col("path").alias("file"), F.posexplode(xml.segments(F.col("raw"))).alias("pos", "s"))
    rows = rows.select("file", "pos", "s.tag", F.col("s.xml").alias("src"), "s.text", F.length("s.text").alias("chars"))
    return rows.filter(F.col("chars").between(25, 500) & (F.size(F.split("text", r"\s+")) >= 4))


def topics(files: DataFrame) -> DataFrame:
    """(id, src, n_bytes, root, prose_chars): topics that can be held out whole."""
    sized = files.filter(F.octet_length("raw").between(700, 3500) & _head("raw", 400).contains("<!DOCTYPE") & ~_head("raw", 600).contains("LIGHTWEIGHT"))
    f = sized.select("path", "raw", xml.topic(F.col("raw")).alias("f")).withColumn("prose_chars", F.length(X.norm(F.col("f.prose"))))
    ok = F.filter("f.texts", lambda t: F.length(t).between(25, 500) & (F.size(F.split(t, r"\s+")) >= 4))
    f = f.filter(F.col("f.ok") & ~F.col("f.reuse") & (F.col("prose_chars") >= 250) & (F.size(ok) >= 2))
    return f.select(F.col("path").alias("id"), F.col("raw").alias("src"), F.octet_length("raw").cast("long").alias("n_bytes"), F.col("f.root").alias("root"), F.col("prose_chars").cast("long").alias("prose_chars"))


def split_by_hash(df: DataFrame, key: str, sizes: dict[str, int], seed: int, rest: str | None = None) -> DataFrame:
    """Adds ``split``: the first rows in hash order make the first split, and so on.

    Only (key, hash) of the rows that are needed are sorted; with ``rest`` the others stay, labelled so."""
    total = sum(sizes.values())
    order = X.hash_order(seed, F.col(key))
    first = df.select(key).distinct().select(F.col(key).alias("_k"), order.alias("_o")).orderBy("_o", "_k").limit(total)
    first = first.withColumn("_n", F.row_number().over(Window.orderBy("_o", "_k")))  # of the few rows kept
    label, at = F.lit(None).cast("string"), total
    for name, n in reversed(sizes.items()):
        label = F.when(F.col("_n") <= at, F.lit(name)).otherwise(label)
        at -= n
    # the cascade runs from the last split to the first, so that the lowest bound wins
    out = df.join(first.select("_k", label.alias("split")), F.col(key) == F.col("_k"), "left" if rest else "inner").drop("_k")
    return out.withColumn("split", F.coalesce("split", F.lit(rest))) if rest else out


def label_by_path(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the split of a path from a small list; paths that it does not name are unused."""
    return df.join(labels.select("path", "split"), "path", "left").withColumn("split", F.coalesce("split", F.lit("unused")))


def held_sentences(held: DataFrame) -> DataFrame:
    """(key): lower-cased block texts of held-out topics."""
    return held.select(F.explode(xml.block_texts(F.col("src"))).alias("t")).select(F.lower("t").alias("key")).distinct()


def drop_leaks(segs: DataFrame, held: DataFrame, sentences: DataFrame) -> DataFrame:
    """Segments of files that are not held out and whose text no held-out topic has."""
    free = segs.join(held.select(F.col("id").alias("file")), "file", "left_anti")
    return free.withColumn("key", F.lower("text")).join(sentences, "key", "left_anti")


def leaks(segs: DataFrame, held: DataFrame, sentences: DataFrame) -> DataFrame:
    free = segs.join(held.select(F.col("id").alias("file")), "file", "left_anti")
    return free.withColumn("key", F.lower("text")).join(sentences, "key", "left_semi")


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first in order. An aggregate, so copies combine before the shuffle."""
    cols = [c for c in df.columns if c not in {*order, key}]
    best = F.min_by(F.struct(*[*order, *cols]), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.*").select(*df.columns)


def cap_per_group(df: DataFrame, group: str, most: int, seed: int, key: str = "src", total: int | None = None) -> DataFrame:
    """At most ``most`` rows of a group, and ``total`` in all, in hash order."""
    d = df.withColumn("_o", X.hash_order(seed, F.col(key)))
    w = Window.partitionBy(group).orderBy("_o", key)
    d = d.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    if total is not None:
        d = d.orderBy("_o", key).limit(total)
    return d.drop("_o", "_n")


def train_segments(segs: DataFrame, held: DataFrame, seed: int, most: int = 3, total: int = 1000) -> DataFrame:
    """The training set: no leaks, no repeated text, few of a file, ids from the content."""
    clean = drop_leaks(segs, held, held_sentences(held))
    once = first_of_each(clean, "key", ["file", "pos"])
    return cap_per_group(once, "file", most, seed, total=total).select(X.segment_id(F.col("src")).alias("id"), "file", "tag", "src", "chars")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether no key is in both."""
    return a.join(b.select(key), key, "left_semi").limit(1).count() == 0


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if not disjoint(a, b, key):
        raise ValueError(f"{key} is in both sets")


def hold_out_families(df: DataFrame, family: str, flag: Column) -> DataFrame:
    """Adds ``held``: whether any member of a row's family is flagged."""
    flagged = df.groupBy(family).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("held"))
    return df.join(flagged, family)


def manifest(df: DataFrame, split: str = "split") -> DataFrame:
    """One row a split: rows, bytes, and a digest of its ids that no order changes: the sum of the
    leading 60 bits of their SHA-256. All of it combines before the shuffle, whatever a split's size."""
    part = F.conv(F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), F.sum(part).cast("string").alias("ids_digest"))


def tag_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")
