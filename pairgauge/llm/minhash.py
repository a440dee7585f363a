"""MinHash near-dedup by fast similarity sketching, with exact verification.

A document's set is its distinct word shingles. Documents of equal sets form one class, and the
work goes on with classes. A sketch has T coordinates filled in rounds: in each of the first T
rounds every element is hashed to a bin and competes there, in the next T rounds round T + i fills
bin i if it is still empty. A value of an earlier round always wins, so the work stops after the
first round that leaves no bin empty; every coordinate is filled, coordinates agree with the
probability of the Jaccard similarity, and their mean concentrates as sharply as with independent
ones. BANDS bands of ROWS coordinates make candidates: at a similarity of 0.85 a pair shares no
band with a probability of 3e-7.

Groups of copies are linked without making all their pairs: each bucket names a hub, and its
members are verified against the hub by full sets, a hub's set being dealt to as many tasks as its
bucket has SPLIT members. Components then grow over the links; buckets that still hold several
components name other hubs. What is left is sketched again, finer: WIDE coordinates in bands of
WIDE_ROWS part documents that are merely alike from those that are near copies (at the asked
similarity a pair is lost with a probability of 2e-5 at 0.80, 1e-9 at 0.85), and only members of one
such bucket in different components are compared, in blocks of BLOCK shingles, members of smaller
components against all. A bucket that is one component costs one comparison a member.

A set is known by 128 bits of the blake2b digest of its sorted shingle hashes; should two classes
share the 64 bits that name them, one is renamed. Texts without words, and null texts, have an
empty set and no links. Rows with equal ids are linked by their sets like any others and share the
id; rows are told apart by id and text, so equal and null ids do no harm. Results carry the smallest
id of the component; null ids only count where a component has no other. Repeated rows are one
class; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, few, free_names, mix, shingle_sets, steps, table

T, ROWS = 192, 6
BANDS = T // ROWS
WIDE, WIDE_ROWS = 960, 10
HUB_ROUNDS = 1
#: Members of a bucket that one task verifies against its hub, about.
SPLIT = 256
#: Shingles of one side of a block; a larger set is a block of its own.
BLOCK = 40_000
#: Pairs of blocks up to which a bucket's members are compared directly.
DIRECT = 64
_FREE = np.uint64(2**64 - 1)
_SEEDS = mix(np.arange(1, 2 * 4096 + 1, dtype=np.uint64))


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t filled coordinates a set; rows of empty sets stay free."""
    out = np.full((len(sets), t), _FREE, np.uint64)
    flat = out.reshape(-1)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    value_bits = np.uint64(48)
    for i in range(2 * t):
        if not len(live):
            break
        x = np.concatenate([sets[j] for j in live])
        own = np.repeat(live, [len(sets[j]) for j in live])
        h = mix(x ^ _SEEDS[i])
        v = (np.uint64(i) << value_bits) | (h & np.uint64(2**48 - 1))
        # 16 high bits, beyond those of the value, choose the bin
        bins = (((h >> value_bits) * np.uint64(t)) >> np.uint64(16)).astype(np.int64) if i < t else np.full(len(x), i - t)
        at = own * t + bins
        free = flat[at] >= np.uint64(i) << value_bits
        np.minimum.at(flat, at[free], v[free])
        live = live[(out[live] == _FREE).any(axis=1)]
    return out


def band_keys(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = sk.shape
    parts = sk.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (n, t // rows)).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j])
    return key.view(np.int64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a set's digest."""
    a, b = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x, text): x with the id tells texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, x, n, node, mark, bands): the set's size, the halves of its digest, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, off in steps(b.column(2)):
                sets = shingle_sets(data, off, k)
                node, mark = zip(*map(digest, sets), strict=True)
                bands = band_keys(sketches(sets))
                part = [x.tolist() if len(s) else [] for x, s in zip(bands, sets, strict=True)]
                own = [b.column(i).slice(lo, len(sets)) for i in (0, 1)]
                cols = [*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(mark, pa.int64()), pa.array(part, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "x", "n", "node", "mark", "bands"])

    return _rows(docs).mapInArrow(run, "doc_id long, x long, n long, node long, mark long, bands array<long>")


def _classes(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of _describe with a node to each set of its own, and (node, rep, source, bands) a class."""
    by_node = F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "x")).alias("source"), F.first("bands").alias("bands")
    classes = table(d.filter("n > 0").groupBy("node").agg(*by_node, F.min("mark").alias("lo"), F.max("mark").alias("hi")))
    clash = table(classes.filter("lo != hi").select("node", "lo"))
    if clash.limit(1).count():
        new = F.when(F.col("lo").isNotNull() & (F.col("mark") != F.col("lo")), F.xxhash64("node", "mark")).otherwise(F.col("node"))
        d = table(d.join(F.broadcast(clash) if few(clash) else clash, "node", "left").withColumn("node", new).drop("lo"))
        classes = table(d.filter("n > 0").groupBy("node").agg(*by_node))
    return d, classes.select("node", "rep", "source", "bands")


def _sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(node, s) for rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, off in steps(b.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(data, off, k)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return docs.select("node", "text").mapInArrow(run, "node long, s array<long>")


def _finer(sets: DataFrame) -> DataFrame:
    """(node, key): keys of the finer bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                sub = b.slice(lo, 256)
                keys = band_keys(sketches([x.values.to_numpy().view(np.uint64) for x in sub.column(1)], WIDE), WIDE_ROWS)
                node = np.repeat(sub.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.ravel())], names=["node", "key"])

    return sets.mapInArrow(run, "node long, key long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the ends of ``links``."""
    both = table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = table(labels)
    small = few(labels)  # the same number of rows in every round
    while True:
        lookup = F.broadcast(labels) if small else labels
        # one shuffle a round: own labels and neighbours' labels meet by node
        near = both.join(lookup.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        step = near.union(own).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        jump = lookup.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = table(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = new.select("node", "label")
        if not new.filter("old != label").limit(1).count():
            return labels


def similar(percent: int, n: Column, m: Column, both: Column) -> Column:
    return both * 100 >= (n + m - both) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked. The rows (a, b, c) name hubs b of
    buckets of c members: a hub's set goes to a task for every SPLIT of them."""
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / SPLIT)).alias("part")
    pairs = table(pairs.select("a", "b", part).groupBy("a", "b").agg(F.min("part").alias("part")))
    hubs = pairs.select("b", "part").distinct().join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(hubs, ["b", "part"])
    n, m = F.size("sa").cast("long"), F.size("sb").cast("long")
    x = x.filter((n * 100 >= m * percent) & (m * 100 >= n * percent))
    return x.filter(similar(percent, n, m, F.size(F.array_intersect("sa", "sb")).cast("long"))).select("a", "b")


def _work(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (key, node, label, n), and for each bucket its largest component and how many blocks its
    members, and those of other components, make."""
    rows = table(rows.select("key", "node", "label").join(sets.select("node", F.size("s").cast("long").alias("n")), "node"))
    each = rows.groupBy("key", "label").agg(F.sum("n").alias("c"))
    top = each.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    return rows, table(top.select("key", F.col("top.label").alias("main"), blocks(F.col("m")).alias("mb"), blocks(F.col("m") - F.col("top.c")).alias("ob")))


def _blocks(rows: DataFrame, top: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket, compared in blocks; rows and top: see _work."""
    r = rows.join(F.broadcast(top) if few(top) else top, "key").withColumn("h", F.xxhash64("node"))
    mine = r.select("key", "node", "label", F.pmod("h", F.col("mb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("j"), F.lit(0).alias("side"))
    theirs = r.filter("label != main").select("key", "node", "label", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), F.pmod("h", F.col("ob")).alias("j"), F.lit(1).alias("side"))
    held = mine.union(theirs).join(sets, "node")

    def run(t: pa.Table) -> pa.Table:
        side, node, label = (t.column(c).to_numpy() for c in ("side", "node", "label"))
        col = t.column("s").combine_chunks()
        off, flat = col.offsets.to_numpy(), col.flatten().to_numpy()
        off = off - off[0]
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        size = np.diff(off)
        mine = np.flatnonzero(side == 0)
        own = np.repeat(np.arange(len(mine)), size[mine])
        values = np.concatenate([flat[off[k] : off[k + 1]] for k in mine]) if len(mine) else flat[:0]
        order = np.argsort(values, kind="stable")
        values, own = values[order], own[order]
        out = []
        for k in np.flatnonzero(side == 1):
            # shared shingles with all of the block at once
            one = flat[off[k] : off[k + 1]]
            lo, hi = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
            run_ = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(run_)[:-1]]), run_) + np.arange(run_.sum())
            both = np.bincount(own[at], minlength=len(mine))
            near = np.flatnonzero(100 * both >= percent * (len(one) + size[mine] - both))
            for j in near:
                x, y = find(int(label[k])), find(int(label[mine[j]]))
                if x != y:
                    root[x] = y
                    out.append((int(node[k]), int(node[mine[j]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return held.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _split(rows: DataFrame, links: DataFrame, salt: int, verified: int = 2) -> DataFrame | None:
    """The rows (key, node, c, label, hub, hub_label) of buckets that hold several components; None: no such
    bucket. Buckets of ``verified`` members have been compared already."""
    left = table(rows.filter(F.col("c") > verified).join(components(links), "node", "left").select("key", "node", "c", F.coalesce("label", "node").alias("label")))
    split = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct(F.xxhash64("node", F.lit(salt)), "node", "label")).alias("top"))
    split = table(split.filter("lo != hi").select("key", F.col("top.node").alias("hub"), F.col("top.label").alias("hub_label")))
    return left.join(F.broadcast(split) if few(split) else split, "key") if split.limit(1).count() else None


def _ask(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members to hubs of other components."""
    return _verified(left.filter("label != hub_label").select(F.col("node").alias("a"), F.col("hub").alias("b"), "c"), sets, percent)


def _buckets(keyed: DataFrame) -> DataFrame:
    """(key, node, c, hub) for keys of two members or more."""
    buckets = table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("hub")).filter("c > 1"))
    return table(keyed.join(F.broadcast(buckets) if few(buckets) else buckets, "key"))


def _finely(left: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components in buckets too large to compare their members: those that share a finer band."""
    some = table(left.select("node").distinct())
    fine = _buckets(table(_finer(sets.join(F.broadcast(some) if few(some) else some, "node"))))
    split = _split(fine, links, HUB_ROUNDS + 1, 1)
    if split is None:
        return links.limit(0)
    more = table(_ask(split, sets, percent))
    split = _split(fine, links.union(more), HUB_ROUNDS + 2)
    return more if split is None else more.union(_blocks(*_work(split, sets), sets, percent))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, x, n, node, label): rows of equal label are one component; n = 0 has no label."""
    d, classes = _classes(table(_describe(docs, k), TEXT_ROWS))
    rows = _buckets(table(classes.select("node", F.explode("bands").alias("key"))))
    needed = table(rows.select("node").distinct())

    # the text of one document a class, and its full set
    asked = classes.select("node", "source").join(F.broadcast(needed) if few(needed) else needed, "node")
    asked = table(asked.select("node", F.col("source.doc_id").alias("id2"), F.col("source.x").alias("x2")))
    near = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("x") == F.col("x2"))
    sets = table(_sets_of(_rows(docs).join(F.broadcast(asked) if few(asked) else asked, near), k).dropDuplicates(["node"]), TEXT_ROWS)

    links = table(_verified(rows.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "c"), sets, percent))
    for r in range(HUB_ROUNDS + 1):
        left = _split(rows, links, r)
        if left is None or r == HUB_ROUNDS:
            break
        links = table(links.union(_ask(left, sets, percent)))
    if left is not None:
        left, top = _work(left, sets)
        large = top.filter(F.col("mb") * F.col("ob") > DIRECT)
        if large.limit(1).count():
            links = table(links.union(_finely(left.join(F.broadcast(large) if few(large) else large, "key"), links, sets, percent)))
        links = table(links.union(_blocks(left, top.filter(F.col("mb") * F.col("ob") <= DIRECT), sets, percent)))
    # only classes that are linked have another label than their own
    named = components(links)
    out = d.select("doc_id", "x", "n", "node").join(F.broadcast(named) if few(named) else named, "node", "left")
    return out.select("doc_id", "x", "n", "node", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = table(grouped(docs, k, percent))
    least = table(rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    out = rows.join(F.broadcast(least) if few(least) else least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id (rows without
    one come last, ties go by a hash of the text). Of rows of equal id and text the one whose columns
    hash lowest stays; rows without words all stay."""
    rows = table(grouped(docs, k, percent).filter("n > 0").select("doc_id", "x", "label", F.struct(F.col("doc_id").isNull(), "doc_id", "x").alias("o")))
    each = table(rows.groupBy("doc_id", "x", "label", "o").agg(F.count(F.lit(1)).alias("c")))
    first = table(each.groupBy("label").agg(F.min("o").alias("first")))
    told = table(each.join(F.broadcast(first) if few(first) else first, "label").select("doc_id", "x", (F.col("o") != F.col("first")).alias("gone"), "c").filter("gone or c > 1"))
    i, x = free_names(docs, "id", "x")
    told = told.toDF(i, x, "gone", "c")

    def among(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(rows) if few(rows) else rows, docs["doc_id"].cast("long").eqNullSafe(rows[i]) & (F.xxhash64(docs["text"]) == rows[x]), how)

    single = among(told.select(i, x), "left_anti")
    again = told.filter("not gone").select(i, x)
    if not again.limit(1).count():
        return single
    cols = [F.col(f"`{c}`") for c in docs.columns]
    repeated = among(again, "left_semi").select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.struct(*cols).alias("row"))
    repeated = repeated.groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.unionByName(repeated.select("row.*"))
