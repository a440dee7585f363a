"""Comparing two systems: paired bootstrap, sign test and blind A/B judging."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .windows import places, ranges


def deltas(a: DataFrame, b: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """(id, measure, delta): b minus a on the topics that both have and where both have a value."""
    both = a.select("id", *[F.col(m).cast("double").alias(f"a_{m}") for m in measures]).join(b.select("id", *[F.col(m).cast("double").alias(f"b_{m}") for m in measures]), "id")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(f"b_{m}") - F.col(f"a_{m}")).alias("delta")) for m in measures]))
    return both.select("id", each.alias("e")).select("id", "e.measure", "e.delta").filter("delta IS NOT NULL")


#: Topics that one task draws, about, and words of Python's generator taken at once.
DRAWS, WORDS = 1 << 24, 1 << 16


class _Draws:
    """What ``random.randrange(n)`` of Python's generator gives, by arrays; it can go on from where another one stood."""

    def __init__(self, n: int, key: np.ndarray, pos: int, skip: int = 0) -> None:
        self.n, self.shift, self.skip = n, np.uint32(32 - n.bit_length()), skip
        self.limit = np.uint32(n << (32 - n.bit_length()))
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": pos}}
        self.words = np.random.Generator(self.bits)

    def raw(self) -> np.ndarray:
        return self.words.integers(0, 1 << 32, WORDS, np.uint32)

    def next(self) -> np.ndarray:
        """Some more numbers: the highest bits of a word, unless they are too large."""
        raw = self.raw()
        out = (raw[raw < self.limit] >> self.shift)[self.skip :]
        self.skip = 0
        return out

    def stands(self, size: int, parts: int) -> Iterator[tuple[bytes, int, int]]:
        """(key, pos, skip) before each of ``parts`` times ``size`` numbers."""
        done = part = 0
        while True:
            at = self.bits.state["state"]
            more = done + np.count_nonzero(self.raw() < self.limit)
            while part * size < more:
                yield at["key"].astype(np.uint32).tobytes(), at["pos"], part * size - done
                part += 1
                if part == parts:
                    return
            done = more


_STANDS = "measure string, resamples long, key binary, pos long, skip long, n long, mean double, up long, down long, equal long"
_FACTS = ("n", "mean", "up", "down", "equal")


def _stands(resamples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, state, _ = random.Random(seed).getstate()
        for measure, x in ((m, v.values.to_numpy()) for b in batches for m, v in zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            n, each = len(x), max(1, min(resamples, DRAWS // len(x)))
            facts = [n, sum(x.tolist()) / n, int((x > 0).sum()), int((x < 0).sum()), int((x == 0).sum())]
            parts = -(-resamples // each)
            draws = _Draws(n, np.array(state[:624], np.uint32), state[624])
            rows = [[measure, min(each, resamples - k * each), *at, *facts] for k, at in enumerate(draws.stands(each * n, parts))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in _STANDS.split(", ")])

    return run


def _sums(x: np.ndarray, draws: _Draws, resamples: int) -> np.ndarray:
    """The sum of each of so many resamples of all of x. Whole numbers add up exactly, others in extended precision."""
    n = len(x)
    if not (np.all(x == np.rint(x)) and np.abs(x).sum() < 1 << 53):
        x = x.astype(np.longdouble)
    out, done = np.zeros(resamples, x.dtype), 0
    while done < resamples * n:
        v = x[draws.next()[: resamples * n - done]]
        if len(v):
            starts = np.arange(-done % n, len(v), n)
            if done % n:
                starts = np.concatenate([[0], starts])
            out[done // n : done // n + len(starts)] += np.add.reduceat(v, starts)
            done += len(v)
    return out


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, (measure, resamples, key, pos, skip, x) in enumerate(zip(*b.columns[:6], strict=True)):
            x = x.values.to_numpy()
            draws = _Draws(len(x), np.frombuffer(key.as_py(), np.uint32), pos.as_py(), skip.as_py())
            means = (_sums(x, draws, resamples.as_py()) / len(x)).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([measure.as_py()]), *(c.slice(i, 1) for c in b.columns[6:]), pa.array([means.tolist()], pa.list_(pa.float64()))], names=["measure", *_FACTS, "m"])


def paired_bootstrap(d: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean difference, its 95 % interval and counts per measure, with Python's generator, topics in the order of ids.

    One task a measure runs through the generator's words and notes where each part of the resamples begins, then the
    parts are drawn and added up by as many tasks. A measure's deltas are one array of up to 2**28; ``bootstrap_at_scale``
    has no such array and needs no generator's order."""
    deltas = d.groupBy("measure", ranges(d, "id").alias("b")).agg(F.array_sort(F.collect_list(F.struct("id", "delta"))).getField("delta").alias("x"))
    x = deltas.groupBy("measure").agg(F.flatten(F.array_sort(F.collect_list(F.struct("b", "x"))).getField("x")).alias("x"))
    tasks = 4 * d.sparkSession.sparkContext.defaultParallelism
    parts = x.mapInArrow(_stands(resamples, seed), _STANDS).repartition(tasks, "measure", "key", "pos", "skip")
    means = parts.join(F.broadcast(x), "measure").select("measure", "resamples", "key", "pos", "skip", "x", *_FACTS)
    means = means.mapInArrow(_means, "measure string, n long, mean double, up long, down long, equal long, m array<double>")
    found = means.groupBy("measure").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"), *[F.first(c).alias(c) for c in _FACTS])  # equal in all parts
    low, high = F.get("m", F.lit(int(0.025 * resamples))), F.get("m", F.lit(int(0.975 * resamples)))
    return found.select("measure", "n", "mean", low.alias("low"), high.alias("high"), "up", "down", "equal")


def bootstrap_at_scale(d: DataFrame, resamples: int = 200, seed: int = 0) -> DataFrame:
    """The same by Poisson resampling: each row draws a weight per resample from a hash, so the whole
    is one map-side combined aggregate of any size."""
    r = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    u = (F.pmod(F.xxhash64(F.lit(seed), "measure", "id", "r"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # the inverse of the Poisson(1) distribution, to where its tail is below 1e-12
    weight, total = F.lit(0), 0.0
    for k in range(14):
        total += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u >= total, 1).otherwise(0)
    drawn = d.withColumn("r", r).withColumn("w", weight)
    means = drawn.groupBy("measure", "r").agg((F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("m"))
    span = means.groupBy("measure").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    counts = d.groupBy("measure").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"), F.count_if(F.col("delta") == 0).alias("equal")
    )
    return counts.join(span, "measure").select("measure", "n", "mean", "low", "high", "up", "down", "equal")


def sign_test(up: int, down: int) -> float:
    """Two-sided p of so uneven a split of up and down."""
    n, k = up + down, min(up, down)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def blind_pairs(a: DataFrame, b: DataFrame, topics: DataFrame, seed: int, shards: int = 4) -> DataFrame:
    """(pair, shard, id, src, A, B, a_is): answers in an order that a coin per id decides, numbered by id."""
    both = topics.select("id", "src").join(a.select("id", F.col("hyp").alias("h1")), "id").join(b.select("id", F.col("hyp").alias("h2")), "id")
    rows = places(both, "id", "src", "h1", "h2").withColumnRenamed("place", "n").withColumn("flip", X.coin(seed, F.col("id")))
    h1, h2 = X.clean_output(F.col("h1")), X.clean_output(F.col("h2"))
    return rows.select(
        F.format_string("p%03d", "n").alias("pair"),
        F.pmod("n", F.lit(shards)).alias("shard"),
        "id",
        "src",
        F.when(F.col("flip"), h2).otherwise(h1).alias("A"),
        F.when(F.col("flip"), h1).otherwise(h2).alias("B"),
        F.when(F.col("flip"), "sys2").otherwise("sys1").alias("a_is"),
    )


def unblind(verdicts: DataFrame, key: DataFrame) -> DataFrame:
    """(id, winner, reason) for verdicts (pair, winner A, B or tie, reason)."""
    w = F.trim("winner")
    other = F.when(F.col("a_is") == "sys1", "sys2").otherwise("sys1")
    who = F.when(w == "tie", "tie").when(w == "A", F.col("a_is")).otherwise(other)
    return verdicts.join(key.select("pair", "id", "a_is"), "pair").select("id", who.alias("winner"), "reason")


def tally(unblinded: DataFrame) -> DataFrame:
    names = ("sys1", "sys2", "tie")
    return unblinded.agg(F.count(F.lit(1)).alias("n_judged"), *[F.count_if(F.col("winner") == n).alias(n) for n in names])
