"""LM scoring by prediction with partial matching over bytes.

The model is a trie of byte contexts up to ORDER, learned from the training texts. A byte's
probability is read at its longest context; a symbol not seen there costs an escape (half a count
for each distinct symbol, method D) to the next shorter context, where the symbols of the longer one
are excluded, down to equal shares of what is left of the 256 symbols. Shorter contexts count each
longer context once (update exclusion), as they only serve where longer ones are new. Each text ends
with the byte 0xFF, which UTF-8 never uses, so scores are log10 probabilities of whole texts.

Nothing of the model's size is on one machine. The scan deals texts to blocks of bounded bytes; a
block counts its own (context, symbol) pairs and words before anything is shuffled and packs its
texts, the counts are added up over all blocks, and each block gets back the code lengths of just
the pairs it holds. Code lengths are worked out per bundle of three-byte contexts, which hold all the
longer contexts below them (2**24 pairs each at most, however large the corpus, and as many bundles
as there are pairs for); a bundle is sent the counts of its two-byte contexts, and only the counts
of orders 0 and 1 (65,792 numbers at most) go to every task. ``code_length`` is the adaptive form for one text: it learns as it goes.

Null and empty texts have the end only. Repeated rows are counted and scored each; without training
texts every byte costs 1/256 and no token is known. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, STEP_BYTES, TEXT_ROWS, drop_table, prefix_hash, return_memory, span_hash, steps, table, word_spans

ORDER = 5
#: Text bytes of a block.
BLOCK_BYTES = 24 << 20
#: Keys, and twice the words, that pile up in a block before they are added up.
MERGE_PAIRS = 300_000
#: Pairs that one task codes, about; a three-byte context (at most 2**24 pairs) stays whole.
BUNDLE_PAIRS = 400_000
END = 0xFF


def held_out(fold: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every byte and end: the nearest byte is the highest of the context."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    pad = ORDER + 1
    buf = np.full(len(data) + pad * n + 8, END, np.uint8)
    where = np.repeat(np.arange(n) * pad + ORDER, sizes) + np.arange(len(data))
    buf[where] = data
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    # the eight bytes from the farthest of each context on: the context, the symbol, two more
    word = np.ndarray(len(buf) - 7, "<i8", buf, 0, (1,))[np.arange(at[-1]) + np.repeat(np.arange(n) * ORDER, sizes + 1)]
    key = (word & ((1 << (8 * ORDER)) - 1)) << 8
    word >>= 8 * ORDER
    word &= 255
    key |= word
    return key, at


class _Pairs:
    """Counts of keys, added up whenever enough has piled up."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, key: np.ndarray, learn: np.ndarray) -> None:
        # a sort of bare numbers is several times faster than hashing them; the lowest bit is the count
        both = np.sort((key << 1) | learn)
        key = both >> 1
        first, _ = _runs(key)
        both &= 1
        key, n = key[first], np.add.reduceat(both, first)
        self.parts.append((key, n.astype(np.int32)))
        self.held += len(key)
        if self.held > len(self.parts[0][0]) + MERGE_PAIRS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in ascending order and their counts."""
        key = np.concatenate([k for k, _ in self.parts]) if self.parts else np.empty(0, np.int64)
        n = np.concatenate([c for _, c in self.parts]) if self.parts else np.empty(0, np.int32)
        self.parts = []
        if len(key):
            # the parts are ascending, which a stable sort makes use of
            order = np.argsort(key, kind="stable").astype(np.int32)
            key, n = key[order], n[order]
            first, _ = _runs(key)
            key, n = key[first], np.add.reduceat(n, first)
        self.parts, self.held = [(key, n)], len(key)
        return key, n


class _Words:
    """Counts of words, by their bytes."""

    def __init__(self) -> None:
        self.kept: pa.Table | None = None
        self.parts: list[pa.Table] = []
        self.held = 0

    def add(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> None:
        size = ends - starts
        inside = np.zeros(len(low) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        chars = low[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        col = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(chars)])
        found = col.dictionary_encode()
        n = np.bincount(found.indices.to_numpy(), weights=weight, minlength=len(found.dictionary)).astype(np.int64)
        self.parts.append(pa.table({"word": found.dictionary, "n": n}))
        self.held += len(n)
        if self.held > MERGE_PAIRS // 2:
            self.merge()

    def merge(self) -> pa.Table:
        self.parts += [self.kept] if self.kept is not None else []
        if self.parts:
            t = pa.concat_tables(self.parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            self.kept = pa.table({"word": t.column("word"), "n": t.column("n_sum")}).combine_chunks()
        self.parts, self.held = [], 0
        return self.kept if self.kept is not None else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})


#: The key of the end token; other words' keys are hashes with the sign bit set, pairs' have none.
END_KEY = -1


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (span_hash(prefix_hash(data), starts, ends) | np.uint64(1 << 63)).view(np.int64)


_FACT = "block long, key long, word binary, n long, texts binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.binary())])


class _Block:
    """What a block of texts holds: distinct pairs and words with their counts in training texts, and the texts packed."""

    def __init__(self, number: int) -> None:
        self.number, self.size, self.rows, self.learned = number, 0, 0, 0
        self.pairs, self.words = _Pairs(), _Words()
        self.sink = pa.BufferOutputStream()
        self.out = pa.ipc.new_stream(self.sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def add(self, rows: pa.RecordBatch) -> None:
        self.out.write_batch(rows)
        self.rows += rows.num_rows
        train = rows.column(1).to_numpy(zero_copy_only=False)
        self.learned += int(train.sum())
        for lo, data, offsets in steps(rows.column(2).cast(pa.large_binary())):
            self.size += len(data)
            learn = train[lo : lo + len(offsets) - 1]
            key, at = _keys(data, offsets)
            if len(key):
                self.pairs.add(key, np.repeat(learn, np.diff(at)))
            del key
            low = LOWER[data]
            starts, ends, row = word_spans(low, offsets)
            self.words.add(low, starts, ends, learn[row])

    def facts(self) -> Iterator[pa.RecordBatch]:
        self.out.close()

        def batch(m: int, key=None, word=None, n=None, texts=None) -> pa.RecordBatch:
            cols = [pa.array(np.full(m, self.number)), *(x if x is not None else pa.nulls(m, t) for x, t in ((key, pa.int64()), (word, pa.binary()), (n, pa.int64()), (texts, pa.binary())))]
            return pa.RecordBatch.from_arrays(cols, names=["block", "key", "word", "n", "texts"])

        packed = self.sink.getvalue()
        self.sink = self.out = None
        yield batch(1, texts=pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, packed.size], np.int32)), packed]))
        del packed
        key, n = self.pairs.merge()
        for lo in range(0, len(key), 100_000):
            part = slice(lo, lo + 100_000)
            yield batch(len(key[part]), key=pa.array(key[part]), n=pa.array(n[part].astype(np.int64)))
        del key, n
        yield batch(1, key=pa.array([END_KEY]), word=pa.array([b""], pa.binary()), n=pa.array([self.learned], pa.int64()))
        for b in self.words.merge().to_batches(max_chunksize=50_000):
            for _, data, offsets in steps(b.column(0).cast(pa.large_binary()), 1 << 40):
                yield batch(b.num_rows, key=pa.array(_word_keys(data, offsets[:-1], offsets[1:])), word=b.column(0), n=b.column(1))


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        task, number, block = TaskContext.get().partitionId(), 0, None
        for b in batches:
            text = b.column(2).cast(pa.binary())
            lengths = pc.binary_length(text).to_numpy()
            ends, lo = np.cumsum(lengths), 0
            while lo < b.num_rows:
                # rows of about a step's bytes, so that a block ends soon after its size is reached
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - lengths[lo] + STEP_BYTES, "right")))
                block = block or _Block((task << 24) + number)
                block.add(pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), text.slice(lo, hi - lo)], schema=_ROWS))
                if block.size >= block_bytes:
                    yield from block.facts()
                    number, block = number + 1, None
                    return_memory()
                lo = hi
        if block:
            yield from block.facts()
            del block
        return_memory()

    return run


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of runs of equal keys, and each entry's run."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def code_lengths(key: np.ndarray, n: np.ndarray, two: np.ndarray, two_n: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """log10 probability of each pair. key, n: all pairs of some three-byte contexts and their counts;
    two, two_n: ascending pairs of their two-byte contexts and how many longer contexts have each;
    one[c, a], zero[a]: the same for orders 1 and 0."""
    if not len(key):
        return np.empty(0)
    order = np.argsort(key, kind="stable")
    inverse = np.empty_like(order)
    inverse[order] = np.arange(len(order))
    key, n = key[order], n[order]
    symbol = key & 255
    result, open_ = np.zeros(len(key)), np.ones(len(key), bool)
    seen_n, seen_d = np.zeros(len(key)), np.zeros(len(key))  # of the longer context, as counted here

    def step(mine: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> None:
        left, kinds = total - seen_n, distinct - seen_d
        has = open_ & (left > 0)
        hit = has & (mine > 0)
        result[hit] += np.log10((mine[hit] - 0.5) / left[hit])
        miss = has & ~hit
        result[miss] += np.log10(0.5 * kinds[miss] / left[miss])
        open_[hit] = False

    def counted(pair: np.ndarray) -> np.ndarray:
        """Counts of two-byte pairs; 0 for those that no longer context has."""
        if not len(two):
            return np.zeros(len(pair))
        at = np.minimum(np.searchsorted(two, pair), len(two) - 1)
        return np.where(two[at] == pair, two_n[at], 0).astype(np.float64)

    pair, count = key, n.astype(np.float64)
    back = np.arange(len(key))  # from the full pairs to the pairs of this order
    for k in range(ORDER, 2, -1):
        first, run = _runs(pair >> 8)
        total = np.add.reduceat(count, first)
        distinct = np.add.reduceat((count > 0).astype(np.float64), first)
        step(count[back], total[run][back], distinct[run][back])
        # the pairs one order lower, and how often this context's symbols occur there
        low = _shorter(pair)
        if k > 3:
            uniq, to = np.unique(low, return_inverse=True)
            low_count = np.bincount(to, weights=count > 0, minlength=len(uniq)).astype(np.float64)
            lower = low_count[to]
        else:
            lower = counted(low)
        known = np.add.reduceat(np.where(count > 0, lower, 0), first)
        seen_n, seen_d = known[run][back], distinct[run][back]
        if k > 3:
            pair, count, back = uniq, low_count, to[back]
    # order 2, from the counts over all of its longer contexts
    near = (key >> (8 * ORDER)) & 255
    first, _ = _runs(two >> 8) if len(two) else (np.empty(0, np.int64), None)
    contexts = (two >> 8)[first]
    total = np.add.reduceat(two_n, first).astype(np.float64) if len(two) else np.empty(0)
    distinct = np.diff(np.append(first, len(two))).astype(np.float64)
    below = np.add.reduceat(one[two >> 16, two & 255], first).astype(np.float64) if len(two) else np.empty(0)
    mine = (key >> (8 * (ORDER - 1))) & 0xFFFF
    at = np.minimum(np.searchsorted(contexts, mine), max(0, len(contexts) - 1))
    held = contexts[at] == mine if len(contexts) else np.zeros(len(key), bool)
    of = lambda x: np.where(held, x[at], 0) if len(x) else np.zeros(len(key))
    step(counted((mine << 8) | symbol), of(total), of(distinct))
    seen_n, seen_d = of(below), of(distinct)
    kinds1 = (one > 0).sum(axis=1)
    step(one[near, symbol].astype(np.float64), one.sum(axis=1)[near].astype(np.float64), kinds1[near].astype(np.float64))
    seen_n, seen_d = ((one > 0) * zero).sum(axis=1)[near].astype(np.float64), kinds1[near].astype(np.float64)
    step(zero[symbol].astype(np.float64), np.full(len(key), float(zero.sum())), np.full(len(key), float((zero > 0).sum())))
    result[open_] -= math.log10(max(1, 256 - int((zero > 0).sum())))
    return result[inverse]


def _shorter(pair: np.ndarray) -> np.ndarray:
    """Pairs without the farthest byte of their context."""
    return ((pair >> 16) << 8) | (pair & 255)


def score(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    facts = table(d.mapInArrow(_blocks(block_bytes), _FACT), batch_rows=TEXT_ROWS)

    is_pair = F.col("key") >= 0
    pairs = table(facts.filter(is_pair).groupBy("key").agg(F.sum("n").alias("n")))
    symbol, near = F.col("key").bitwiseAND(255), lambda k: F.shiftright("key", 8 * (ORDER + 1 - k))
    # how many three-byte contexts have a pair of a two-byte context, and so on down
    three = pairs.filter("n > 0").select(near(3).alias("c"), symbol.alias("a")).distinct()
    two = table(three.groupBy(F.shiftright("c", 8).alias("c2"), "a").agg(F.count(F.lit(1)).alias("two_n")))
    low = two.groupBy(F.shiftright("c2", 8).alias("c"), "a").agg(F.count(F.lit(1)).alias("n"))
    one = np.zeros((256, 256), np.int64)
    for r in low.collect():  # 65,536 rows at most
        one[r.c, r.a] = r.n
    zero = (one > 0).sum(axis=0)
    sent = docs.sparkSession.sparkContext.broadcast((one, zero))

    def lengths(t: pa.Table, low: pa.Table) -> pa.Table:
        pair, at = np.unique(low.column("pair").to_numpy(), return_index=True)
        v = code_lengths(t.column("key").to_numpy(), t.column("n").to_numpy(), pair, low.column("two_n").to_numpy()[at], *sent.value)
        return pa.table({"key": t.column("key"), "v": pa.array(v.astype(np.float32))})

    bundles = max(1, -(-pairs.count() // BUNDLE_PAIRS))
    bundle = lambda c3: F.pmod(F.xxhash64(c3), F.lit(bundles)).alias("bundle")
    ours = pairs.select(bundle(near(3)), "key", "n")
    # each bundle gets the two-byte contexts that its three-byte contexts end in
    ends = pairs.select(bundle(near(3)), near(2).alias("c2")).distinct()
    theirs = ends.join(two, "c2").select("bundle", (F.shiftleft("c2", 8) + F.col("a")).alias("pair"), "two_n")
    coded = ours.groupBy("bundle").cogroup(theirs.groupBy("bundle")).applyInArrow(lengths, "key long, v float")

    words = table(facts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    scale, total_n = float(total.n + total.v + 1), int(total.n)

    # a block's rows: the code lengths of its pairs (in single precision), the counts of its words, its texts
    a = facts.filter(is_pair).select("block", "key").join(coded, "key").select("block", "key", F.col("v").cast("double").alias("v"))
    b = facts.filter("word is not null").select("block", "key", "word").join(words, "word").select("block", "key", F.col("c").cast("double").alias("v"))
    own = table(a.union(b))
    for used in (pairs, two, words):
        drop_table(docs.sparkSession, used._pairgauge_path)
    packed = facts.filter("texts is not null").select("block", "texts")
    # few blocks are dealt to more partitions than there are, so that hardly a task gets several of them
    blocks, usual = packed.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = max(usual, min(8 * blocks, 4000))
    packed, own = packed.repartition(dealt, "block"), own.repartition(dealt, "block")

    def block_scores(packed: pa.Table, t: pa.Table) -> pa.Table:
        return_memory()
        known, v = t.column("key").to_numpy(), t.column("v").to_numpy()
        sort = np.argsort(known)
        known, v = known[sort], v[sort]

        def of(key: np.ndarray) -> np.ndarray:
            part = pc.dictionary_encode(pa.array(key))
            distinct = part.dictionary.to_numpy()
            order = np.argsort(distinct)
            found = np.empty(len(distinct))
            found[order] = v[np.searchsorted(known, distinct[order])]
            return found[part.indices.to_numpy()]

        del t, sort
        rows = pa.ipc.open_stream(packed.column("texts")[0].as_buffer())
        ids, learn, scores, tokens, seen, sums = [], [], [], [], [], []
        end = v[np.searchsorted(known, END_KEY)]
        for b in rows:
            ids.append(b.column(0))
            learn.append(b.column(1))
            for _, data, offsets in steps(b.column(2).cast(pa.large_binary())):
                key, at = _keys(data, offsets)
                scores.append(np.add.reduceat(of(key), at[:-1]))
                low, n = LOWER[data], len(offsets) - 1
                starts, ends, row = word_spans(low, offsets)
                count = of(_word_keys(low, starts, ends))
                tokens.append(np.bincount(row, minlength=n) + 1)
                seen.append(np.bincount(row, weights=count > 0, minlength=n).astype(np.int64) + int(end > 0))
                sums.append(np.bincount(row, weights=np.log10((count + 1) / scale), minlength=n) + math.log10((end + 1) / scale))
        tokens, seen, sums, scores = (pa.array(np.concatenate(x)) for x in (tokens, seen, sums, scores))
        cols = [pa.chunked_array(ids), pc.invert(pa.chunked_array(learn)), tokens, seen, pa.array(np.full(len(tokens), total_n)), sums, scores]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(block_scores, schema)


def code_length(data: bytes, order: int = ORDER) -> float:
    """log10 probability of a text and its end under a trie that learns from the text alone."""
    trie: dict[bytes, Counter[int]] = {}
    out, padded = 0.0, bytes([END]) * order + data + bytes([END])
    for i in range(order, len(padded)):
        a, excluded, found = padded[i], set(), -1
        for k in range(order, -1, -1):
            node = trie.get(padded[i - k : i], {})
            live = {s: c for s, c in node.items() if s not in excluded}
            if a in live:
                out += math.log10((live[a] - 0.5) / sum(live.values()))
                found = k
                break
            if live:
                out += math.log10(0.5 * len(live) / sum(live.values()))
            excluded |= set(node)
        else:
            out -= math.log10(256 - len(excluded))
        for k in range(max(found, 0), order + 1):
            trie.setdefault(padded[i - k : i], Counter())[a] += 1
    return out


__all__ = ["code_length", "code_lengths", "held_out", "score"]
