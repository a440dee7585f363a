"""Operators over ordered rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one Python call may sort and fold.
GROUP_ROWS = 1_000_000


def drop_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    return df.withColumns({"_b": before, "_f": first}).filter(F.col("_f") | ~F.col(value).eqNullSafe(F.col("_b"))).drop("_b", "_f")


def drop_repeats_in(items: Column) -> Column:
    return F.filter(items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - 1)))


def advantages(df: DataFrame, group: str, reward: str, epsilon: float = 1e-6) -> DataFrame:
    """Adds ``advantage``: rewards centred and scaled in their group."""
    w = Window.partitionBy(group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + epsilon))


def spread_groups(df: DataFrame, group: str, reward: str, least: float, by: str = "range") -> DataFrame:
    """(group, spread): groups whose rewards differ by ``least`` or more (range or population deviation)."""
    spread = F.max(reward) - F.min(reward) if by == "range" else F.stddev_pop(reward)
    return df.groupBy(group).agg(spread.alias("spread")).filter(F.col("spread") >= least)


def last_write(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; an aggregate, so rows combine before the shuffle."""
    cols = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(order, *cols), order).alias("_r")).select(key, "_r.*").select(*df.columns)


def chunks(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("chunk", F.floor((n - 1) / size).cast("long"))


def shards(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Adds ``shard``: rows of a group dealt out in turn."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("shard", F.pmod(n - 1, F.lit(k)).cast("int"))


def pack(df: DataFrame, group: str, key: str, length: str, most_rows: int, budget: int) -> DataFrame:
    """Adds ``batch``: rows of a group by length, a new batch where rows or rows x longest grow too many.

    A fold over sorted rows, so one task works on one group: the pool of a step, at most GROUP_ROWS rows."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > GROUP_ROWS:
            raise ValueError(f"a group of {len(p)} rows is no pool of a step")
        p = p.sort_values([length, key], kind="stable")
        batch, rows, out = 0, 0, []
        for n in p[length]:
            if rows and (rows + 1 > most_rows or (rows + 1) * n > budget):
                batch, rows = batch + 1, 0
            rows += 1
            out.append(batch)
        return p.assign(batch=pd.Series(out, index=p.index, dtype="int64"))

    schema = df.select("*", F.lit(0).cast("long").alias("batch")).schema
    return df.groupBy(group).applyInPandas(run, schema)


def scan_until(df: DataFrame, run: str, order: list[str], hit: Column, target: int) -> DataFrame:
    """The rows of each run up to the one that brings the hits to ``target``."""
    w = Window.partitionBy(run).orderBy(*order)
    hits = F.sum(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_h", F.coalesce(hits, F.lit(0))).filter(F.col("_h") < target).drop("_h")


def stop_reason(df: DataFrame, run: str, hit: Column, target: int, wall: float, budget: float) -> DataFrame:
    """(run, scanned, hits, reason): why a scan ended, from its rows' elapsed time and spend."""
    seen = df.groupBy(run).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(hit).alias("hits"), F.max("elapsed").alias("elapsed"), F.max("spent").alias("spent"))
    why = F.when(F.col("hits") >= target, "found_target").when(F.col("elapsed") >= wall, "scan_wall").when(F.col("spent") >= budget, "budget").otherwise("pool_exhausted")
    return seen.select(run, "scanned", "hits", why.alias("reason"))


def epochs(df: DataFrame, key: str, n: int, seed: int, digits: int = 3) -> DataFrame:
    """(epoch, key, ..., place) in hash order, another one each epoch: replay is a filter on epoch and place.

    Hashes spread evenly, so their first ``digits`` deal each epoch to 16**digits tasks; a place is one
    in its task after the rows of the tasks before, whose counts (n * 16**digits at most) are broadcast."""
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")).cast("binary"))
    each = each.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, digits))
    counts = each.groupBy("epoch", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("epoch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("epoch", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("epoch", "_b").orderBy("_o", key)) + F.col("_base")
    return each.join(F.broadcast(counts), ["epoch", "_b"]).withColumn("place", place.cast("long")).drop("_o", "_b", "_base")


def ranges(df: DataFrame, col: str, parts: int = 256, per: int = 16) -> Column:
    """The number of a row's range of ``col``, which rises with it, for rows that are put in order range by range.

    The bounds come from ``parts * per`` rows of df at most, those with the least hashes, so that they are the same in
    every run; a table of fewer rows is one range. All rows have a range, also those that were not looked at."""
    seen = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).orderBy(F.xxhash64(col)).limit(parts * per).collect()]
    bounds = sorted(set(sorted(seen)[per::per])) if len(seen) == parts * per else []
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(col))) if bounds else F.lit(0)


def places(df: DataFrame, *order: str, parts: int = 256, per: int = 16) -> DataFrame:
    """Rows with ``place``, from 0 in ascending order: one in its range after the rows of the ranges before,
    whose counts (``parts`` at most) are broadcast. No task has all rows."""
    each = df.withColumn("_b", ranges(df, order[0], parts, per))
    counts = each.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # of the few ranges
    counts = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1 + F.col("_base")
    return each.join(F.broadcast(counts), "_b").withColumn("place", place.cast("long")).drop("_b", "_base")


def merge_spans(spans: Column) -> Column:
    """Sorted, overlapping or touching structs (s, e) joined."""
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= F.get(acc, F.size(acc) - 1)["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<s:int,e:int>>"), step)


def covered(spans: Column, at: Column) -> Column:
    return F.exists(spans, lambda s: (s["s"] <= at) & (at < s["e"]))


def free_spans(spans: Column) -> Column:
    """Of structs (s, e), the first, and each next one that starts at or after the last kept end."""
    longest_first = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))

    def step(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) == 0) | (x["s"] >= F.get(acc, F.size(acc) - 1)["e"]), F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(longest_first, F.array().cast("array<struct<s:int,e:int>>"), step)


