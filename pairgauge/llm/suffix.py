"""Suffix-array dedup: bytes inside any string of LENGTH bytes that occurs again anywhere.

``maximal_repeats`` is the core: over an enhanced suffix array (ranks by prefix doubling, common
prefixes read off the rank tables) one stack scan builds the tree of common-prefix intervals; an
interval whose occurrences have different bytes on their left is a maximal repeat, and it comes out
with all its occurrences.

One suffix array of a corpus does not fit a machine, so texts are cut to where repeats can be, and
nothing is lost by it. Every window of LENGTH bytes has an anchor, the half-length gram in it with
the smallest hash; equal windows have equal anchors at equal places. Rows with an anchor (some 2 %
of the bytes) are dealt by its hash. An anchor that occurs once settles its windows. Occurrences
with equal surroundings (all windows of the anchor) repeat each other whole, so of thousands of
copies one is looked at further. What is left, the surroundings of anchors that differ, goes
through suffix arrays, whole anchors packed into bundles of bounded size; anchors with more than
HOT different surroundings are dealt again by the hash of each window. All counts are of the input.

Null texts are empty and texts under LENGTH bytes stay whole. Repeated rows are other texts, so each
repeats the other. Ids do not matter to matching, so null and equal ids are kept as they are. An
empty table gives an empty result; extra columns are not read. Strings count as equal by two
64-bit hashes (an anchor's and its surroundings', or two of a window), or byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, TEXT_ROWS, drop_table, few, mix, prefix_hash, span_hash, table

LENGTH = 200
#: Different surroundings of one anchor that one suffix array takes in.
HOT = 1500
BUNDLE_ROWS = 3000
CHUNK = 1 << 20


# -- the enhanced suffix array --------------------------------------------------------------


def _ranks(data: np.ndarray, room: np.ndarray, reach: int) -> list[np.ndarray]:
    """Ranks of all positions by their first 8, 16, 32, ... bytes up to ``reach``; room: bytes left
    to the end of a position's text, beyond which zeros are read."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        part = np.zeros(n, np.uint64)
        part[: n - j] = data[j:]
        part[room <= j] = 0
        key = (key << np.uint64(8)) | part
    out, size = [], 8
    while True:
        out.append(np.unique(key, return_inverse=True)[1].astype(np.int64) + 1)
        if size >= reach:
            return out
        rank = out[-1]
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:]
        after[room <= size] = 0
        key, size = rank * np.int64(n + 2) + after, 2 * size


def _common(ranks: list[np.ndarray], room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of positions a and b."""
    n, found = len(room), np.zeros(len(a), np.int64)
    most = np.minimum(room[a], room[b])
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + found, b + found
        inside = found < most
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][np.minimum(x[inside], n - 1)] == ranks[level][np.minimum(y[inside], n - 1)]
        found += np.where(same, 8 << level, 0)
    return found


def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, text numbers, starts) of the maximal repeats of ``least`` (8 or more) bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(texts)), sizes)
    room = ends[own] - np.arange(len(data))
    ranks = _ranks(data, room, int(sizes.max()))
    at = np.flatnonzero(room >= least)
    order = at[np.argsort(ranks[-1][at], kind="stable")]
    if len(order) < 2:
        return
    lcp = _common(ranks, room, order[:-1], order[1:])
    # within the last 8 bytes the common prefix is counted byte by byte
    a, b = order[:-1] + lcp, order[1:] + lcp
    most = np.minimum(room[order[:-1]], room[order[1:]])
    for _ in range(8):
        live = (lcp < most) & (data[np.minimum(a, len(data) - 1)] == data[np.minimum(b, len(data) - 1)])
        if not live.any():
            break
        lcp, a, b = lcp + live, a + live, b + live
    lcp = np.minimum(lcp, most)
    left = np.where(own[np.maximum(order - 1, 0)] == own[order], data[order - 1].astype(np.int64), -1 - order)
    left[order == 0] = -1
    starts = ends - sizes
    depth = np.where(lcp >= least, lcp, 0).tolist()
    # left bytes differ somewhere in an interval if they differ between neighbours in it
    differ = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    stack: list[tuple[int, int]] = []  # (depth, first entry)
    for i in range(1, len(order) + 1):
        d = depth[i - 1] if i <= len(depth) else 0
        first = i - 1
        while stack and stack[-1][0] > d:
            length, first = stack.pop()
            if differ[i - 1] > differ[first]:
                p = order[first:i]
                yield length, own[p], p - starts[own[p]]
        if d and (not stack or stack[-1][0] < d):
            stack.append((d, first))


# -- anchors ---------------------------------------------------------------------------------


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (text number, offset, bytes) of about CHUNK bytes; long texts overlap by a window."""
    run, size = [], 0
    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[lo : lo + CHUNK + length - 1]
            if len(part) >= length:
                run.append((k, lo, part))
                size += len(part)
            if size >= CHUNK:
                yield run
                run, size = [], 0
    if run:
        yield run


def _anchors(run: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, surroundings' hash, first window, windows)."""
    half = length // 2
    width = length - half + 1
    data = np.frombuffer(b"".join(p for *_, p in run), np.uint8)
    sizes = np.array([len(p) for *_, p in run], np.int64)
    ends = np.cumsum(sizes)
    pre = prefix_hash(data)
    i = np.arange(len(data) - half + 1)
    v = span_hash(pre, i, i + half)
    # leftmost smallest gram of each window, by doubling
    grams, done = v, 1
    at = i.astype(np.int32)
    while done < width:
        hop = min(done, width - done)
        keep = v[:-hop] <= v[hop:]
        at = np.where(keep, at[:-hop], at[hop:])
        v = np.where(keep, v[:-hop], v[hop:])
        done += hop
    s = np.arange(len(v))
    piece = np.searchsorted(ends, s, "right")
    ok = s + length <= ends[piece]
    s, at, piece = s[ok], at[ok].astype(np.int64), piece[ok]
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    lo, hi, piece = s[first], s[last], piece[first]
    begin, base, number = ends - sizes, np.array([b for _, b, _ in run]), np.array([k for k, *_ in run])
    around = span_hash(pre, lo, hi + length)
    return number[piece], grams[at[first]], around, lo - begin[piece] + base[piece], hi - lo + 1


_ROW = "fp long, around long, rk long, s long, m int"


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk = b.column(0).to_numpy()
            for part in _pieces(b.column(1).cast(pa.binary()).to_pylist(), length):
                k, fp, around, s, m = _anchors(part, length)
                cols = [pa.array(fp.view(np.int64)), pa.array(around.view(np.int64)), pa.array(rk[k]), pa.array(s), pa.array(m.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["fp", "around", "rk", "s", "m"])

    return run


_CUT = "fp long, hot boolean, rk long, s long, cut binary"


def _surroundings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, hot, rk, s, cut = [], [], [], [], []
            for key, text, asked in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                text = text.as_py()
                for a in asked:
                    fp.append(a["fp"])
                    hot.append(a["hot"])
                    rk.append(key)
                    s.append(a["s"])
                    cut.append(text[a["s"] : a["s"] + a["m"] + length - 1])
            cols = [pa.array(fp, pa.int64()), pa.array(hot, pa.bool_()), pa.array(rk, pa.int64()), pa.array(s, pa.int64()), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["fp", "hot", "rk", "s", "cut"])

    return run


def _bundle_spans(length: int):
    def run(t: pa.Table) -> pa.Table:
        rk, s = t.column("rk").to_numpy(), t.column("s").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, text, start in maximal_repeats(t.column("cut").to_pylist(), length):
            out.append((rk[text], s[text] + start, s[text] + start + n))
        a, b, c = (np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(3))
        order = np.lexsort((c, b, a))
        a, b, c = a[order], b[order], c[order]
        if len(a):
            # overlapping spans of a text become one
            top = c.copy()
            for lo, hi in zip(*(x.tolist() for x in _bounds(a)), strict=True):
                top[lo:hi] = np.maximum.accumulate(c[lo:hi])
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] > top[:-1])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(a)]]) - 1
            a, b, c = a[first], b[first], top[last]
        return pa.table({"rk": pa.array(a, pa.int64()), "lo": pa.array(b, pa.int64()), "hi": pa.array(c, pa.int64())})

    return run


def _bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(new)
    return first, np.concatenate([first[1:], [len(a)]])


def _window_hashes(length: int):
    """(h, g, rk, c, s): two hashes of each window, its text, the start of its surroundings and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, g, rk, c, s = [], [], [], [], []
            for key, start, cut in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = np.frombuffer(cut.as_py(), np.uint8)
                i = np.arange(len(data) - length + 1)
                pre = prefix_hash(data)
                h.append(span_hash(pre, i, i + length).view(np.int64))
                # the halves hashed apart make a second hash of the window
                two = mix(span_hash(pre, i, i + length // 2)) ^ span_hash(pre, i + length // 2, i + length)
                g.append(two.view(np.int64))
                rk.append(np.full(len(i), key, np.int64))
                c.append(np.full(len(i), start, np.int64))
                s.append(start + i)
            cols = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (h, g, rk, c, s)]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "rk", "c", "s"])

    return run


def _joined_windows(length: int):
    """(rk, lo, hi) of the runs of windows of one surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(key, lo, hi) for key, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for lo, hi in _merged([{"lo": s, "hi": s + length} for s in starts])]
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["rk", "lo", "hi"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(rk, lo, hi): byte spans that lie in repeated strings, for rows (rk, text)."""
    alike = ["fp", "around"]  # equal surroundings are of one length and have their anchor at one place
    rows = table(docs.filter(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length), _ROW), TEXT_ROWS)
    # counted before they are dealt, so that a passage of many copies is one row a task
    classes = table(rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), F.min("rk").alias("rk"), F.min_by("s", "rk").alias("s"), F.min("m").alias("m")))
    again = classes.filter("n > 1").select(*alike)
    whole = rows.join(again, alike)
    whole = table(whole.select("rk", F.col("s").alias("lo"), (F.col("s") + F.col("m") + (length - 1)).alias("hi")))
    drop_table(docs.sparkSession, rows._pairgauge_path)

    # surroundings that differ: one of each kind
    kinds = table(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    edge = classes.join(F.broadcast(kinds) if few(kinds) else kinds, "fp").select("fp", "rk", "s", "m", (F.col("kinds") > hot).alias("hot"))
    edge = table(edge.groupBy("rk").agg(F.collect_list(F.struct("fp", "s", "m", "hot")).alias("asked"), F.count(F.lit(1)).alias("c")))
    drop_table(docs.sparkSession, classes._pairgauge_path)
    n_edges = int(edge.agg(F.sum("c")).first()[0] or 0)
    some = edge.select(F.col("rk").alias("rk2"), "asked")
    if n_edges <= BROADCAST_ROWS // 4 and few(edge):
        some = F.broadcast(some)
    cuts = docs.join(some, F.col("rk") == F.col("rk2")).dropDuplicates(["rk"]).select("rk", "text", "asked")
    cuts = table(cuts.mapInArrow(_surroundings(length), _CUT), TEXT_ROWS)
    bundle = F.pmod(F.xxhash64("fp"), F.lit(max(1, -(-n_edges // BUNDLE_ROWS)))).alias("bundle")
    spans = cuts.filter("not hot").groupBy(bundle).applyInArrow(_bundle_spans(length), "rk long, lo long, hi long")
    windows = cuts.filter("hot").select("rk", "s", "cut").mapInArrow(_window_hashes(length), "h long, g long, rk long, c long, s long")
    twice = table(windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g"))
    windows = windows.join(F.broadcast(twice) if few(twice) else twice, ["h", "g"])
    # the windows of one surroundings are length / 2 + 1 at most
    windows = windows.groupBy("rk", "c").agg(F.collect_list("s").alias("starts")).select("rk", "starts").mapInArrow(_joined_windows(length), "rk long, lo long, hi long")
    return whole.union(spans).union(windows)


def _named(d: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with ``rk``, a number of their own: a hash, and another one where two rows share it."""
    d = d.withColumns({"rk": F.xxhash64("doc_id", "text"), "g": F.xxhash64(F.lit("row"), "text", "doc_id")})
    clash = d.groupBy("rk").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi").select(F.col("rk").alias("shared"))
    clash = table(clash)
    if clash.limit(1).count():
        d = d.join(F.broadcast(clash) if few(clash) else clash, F.col("rk") == F.col("shared"), "left")
        d = d.withColumn("rk", F.when(F.col("shared").isNull(), F.col("rk")).otherwise(F.col("g")))
    return d.select("doc_id", "text", "rk")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the spans removed) per row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = _named(d)
    spans = table(repeated_spans(d.select("rk", "text"), length, hot).groupBy("rk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    spans = spans.withColumnRenamed("rk", "rk2")
    both = d.join(spans, F.col("rk") == F.col("rk2"), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed array<struct<lo:long,hi:long>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, sha, found = [], [], [], [], []
            for text, spans in zip(b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                data, merged = text.as_py(), _merged(spans or [])
                h, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    h.update(data[at:lo])
                    at = hi
                h.update(data[at:])
                size.append(len(data))
                gone.append(sum(hi - lo for lo, hi in merged))
                runs.append(len(merged))
                sha.append(h.hexdigest())
                found.append([{"lo": lo, "hi": hi} for lo, hi in merged])
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))
                names.append("removed")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(run, schema)
