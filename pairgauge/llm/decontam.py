"""Benchmark decontamination: size-partitioned MinHash containment search, native.

Test items are short and documents long, so their Jaccard similarity says nothing; the search
is for containment, with a one-sided MinHash: items have sketches, their smallest shingle hashes,
and documents are asked which hashes of a sketch they hold. The share held estimates the
containment. An item of m distinct shingles lies in a document if at least 80 % of them do, so at
most m - ceil(0.8 m) are missing. Items are partitioned by size, in powers of two; in the partition
of sizes from 2**c the containment becomes two parameters: HITS = max(1, 2**c / 8) hashes that have
to be found of a sketch that is m - ceil(0.8 m) + HITS deep. So the sketch of each partition is as
deep as its size calls for, and no true match is lost, wherever in the document its shingles are.
Documents probe the sketches in one streaming pass and are never shuffled; candidates are then
verified by exact containment of shingles. The sketches are broadcast only behind a count.

Words are runs of letters and digits of the lower-cased text. Items with fewer than five words
count as one shingle of their own length; items without words match nothing, nor do null or
empty texts. Repeated rows of an id give one pair; null ids are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few, free_names, let, table

K = 5
#: Containment in percent from which an item counts as found.
PERCENT = 80


def norm_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(ws: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; none if there are fewer words."""
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>")
    )


def _hashes(ws: Column, k: int) -> Column:
    return let(ws, lambda w: shingle_hashes(w, k))


def _labelled(ws: Column, k: int) -> Column:
    return F.transform(F.array_distinct(shingle_hashes(ws, k)), lambda h: F.struct(h.alias("h"), F.lit(k).alias("k")))


def shingle_strings(ws: Column, k: Column) -> Column:
    return F.when((k > 0) & (F.size(ws) >= k), F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.array_join(F.slice(ws, i + 1, k), " "))).otherwise(
        F.array().cast("array<string>")
    )


def sketches(items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row an item: (item_id, k, m, need, hits, shingles, sketch), with the parameters of its size partition."""
    w = items.select(F.col(f"`{item_id}`").alias("item_id"), norm_words(F.col(f"`{text}`")).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("k", F.least(F.lit(k), F.size("w")))
    w = w.withColumn("shingles", F.array_distinct(shingle_strings(F.col("w"), F.col("k")))).withColumn("m", F.size("shingles"))
    need = F.floor((F.col("m") * percent + 99) / 100).cast("int")
    by_k = F.lit(None).cast("array<bigint>")
    for j in range(1, k + 1):
        by_k = F.when(F.col("k") == j, F.sort_array(F.array_distinct(_hashes(F.col("w"), j)))).otherwise(by_k)
    hits = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2("m")) - 3)).cast("int")
    w = w.withColumns({"need": need, "hits": hits})
    return w.withColumn("sketch", F.slice(by_k, 1, F.col("m") - F.col("need") + F.col("hits"))).select("item_id", "k", "m", "need", "hits", "shingles", "sketch")


def _found(docs: DataFrame, items: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(doc_id, x, item_id, n_item_shingles, n_shared): the items in each document, x the hash of its text."""
    sk = table(sketches(items, k=k, percent=percent))
    probes = table(sk.select(F.struct("item_id", "hits").alias("item"), "k", F.explode("sketch").alias("h")).groupBy("h", "k").agg(F.collect_set("item").alias("items")))
    size = sk.agg(F.sum("m"), F.sum(F.size("sketch"))).first()  # shingles and sketch entries, with repeats
    small, light = (size[1] or 0) <= BROADCAST_ROWS // 4, (size[0] or 0) <= BROADCAST_ROWS // 2
    # identical rows are one document here
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    ks = [r[0] for r in probes.select("k").distinct().limit(k + 1).collect()]  # at most k values
    grams = let(
        norm_words(F.col("text")),
        lambda w: F.flatten(F.array(*[_labelled(w, j) for j in ks]))
        if ks
        else F.array().cast("array<struct<h:bigint,k:int>>"),
    )
    key = F.struct("doc_id", F.xxhash64("text").alias("x")).alias("key")
    hits = d.select(key, F.inline(grams)).join(F.broadcast(probes) if small else probes, ["h", "k"])
    hits = hits.select("key", "h", F.inline("items")).groupBy("key", "item_id", "hits").agg(F.countDistinct("h").alias("n"))
    found = table(hits.filter("n >= hits").select("key", "item_id"))
    keys = found.select("key").distinct()
    some = d.withColumn("key", key)
    near = found.count() <= BROADCAST_ROWS // 4
    some = some.join(F.broadcast(keys) if near else keys, some["key"].eqNullSafe(keys["key"]), "left_semi")
    whole = sk.select(F.col("item_id").alias("own"), "k", "m", "need", "shingles")
    pairs = found.join(F.broadcast(whole) if light else whole, F.col("item_id").eqNullSafe(F.col("own")))
    full = some.dropDuplicates(["key"]).select("key", norm_words(F.col("text")).alias("w")).join(pairs.withColumnRenamed("key", "key2"), F.col("key").eqNullSafe(F.col("key2")))
    shared = F.size(F.array_intersect("shingles", let(F.col("w"), lambda w: shingle_strings(w, F.col("k")))))
    shared = shared.cast("long").alias("n_shared")
    return full.select("key.doc_id", "key.x", "item_id", F.col("m").cast("long").alias("n_item_shingles"), shared, "need").filter("n_shared >= need").drop("need")


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): the items that documents contain."""
    return _found(docs, items, doc_id, text, k, percent).groupBy("doc_id", "item_id", "n_item_shingles").agg(F.max("n_shared").alias("n_shared"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with their own columns only; of rows that share an id, or have none, the others stay."""
    bad = table(_found(docs, items, "doc_id", "text", K, PERCENT).select("doc_id", "x").distinct())
    i, x = free_names(docs, "id", "x")
    bad = bad.toDF(i, x)
    bad = F.broadcast(bad) if few(bad) else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[i]) & (F.xxhash64(docs["text"]) == bad[x]), "left_anti")
