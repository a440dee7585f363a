"""Streams of run logs: tailing, running snapshots, stop conditions and budget alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X


def tail(spark: SparkSession, folder: str, schema: str = "event string, t string, step long, value double", files: int = 1) -> DataFrame:
    """New lines of a folder of JSON logs; ``t`` in any of its three forms becomes ``ts``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
    return rows.withColumn("ts", X.any_timestamp(F.col("t")))


def windowed(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window; rows later than ``late`` are dropped. Works on batches too."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = e.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def progress(events: DataFrame, key: str, hit: Column) -> DataFrame:
    """Running totals of a scan (output mode complete or update)."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(hit).alias("hits"))


def replay(events: DataFrame, key: str = "step", order: str | tuple[str, ...] = "ts") -> DataFrame:
    """The last row of each key, for a log that was resumed and tells its steps again (output mode update
    or complete; batches too). One row of state a key."""
    by = F.col(order) if isinstance(order, str) else F.struct(*order)
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(key, "_r.*").select(*events.columns)


def best_so_far(events: DataFrame, group: str, measure: str, step: str = "step") -> DataFrame:
    best = F.max(F.struct(F.col(measure).alias("value"), (-F.col(step)).alias("minus")))
    return events.groupBy(group).agg(best.alias("b")).select(group, (-F.col("b.minus")).alias(step), F.col("b.value").alias("value"))


#: Days of event time without a row after which a key's state is dropped.
IDLE_DAYS = 30


def _keep(state: GroupState, value: tuple, latest: pd.Timestamp | None) -> None:
    """Update a state; with the latest event time of its rows it is dropped IDLE_DAYS after that."""
    state.update(value)
    if latest is not None:
        now = max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(now + IDLE_DAYS * 86_400_000)


def _stateful(rows: DataFrame, key: str, run, out: str, state: str, mode: str, ts: str | None) -> DataFrame:
    """Groups with state; with an event time ``ts`` the state of a key that stays idle is dropped."""
    if ts:
        rows = rows.withWatermark(ts, "1 hour")
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, state, mode, timeout)


def budget_alerts(events: DataFrame, stage: str, cap: float, rate: str = "rate", seconds: str = "seconds", ts: str | None = None) -> DataFrame:
    """(stage, spent): one row for each stage, when its spend first reaches the cap.

    The state of a stage is its spend and whether it has fired, so it never fires twice. With an event
    time ``ts``, a stage that is idle for IDLE_DAYS starts anew; without one, states stay."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, fired = state.get if state.exists else (0.0, False)
        latest = None
        for p in batches:
            latest = p[ts].max() if ts else None
            spent += float((p[rate] * p[seconds]).sum() / 3600)
        now = spent >= cap and not fired
        _keep(state, (spent, fired or now), latest)
        if now:
            yield pd.DataFrame({stage: [key[0]], "spent": [spent]})

    kind = dict(events.dtypes)[stage]
    rows = events.select(stage, F.col(rate).cast("double").alias(rate), F.col(seconds).cast("double").alias(seconds), *([ts] if ts else []))
    return _stateful(rows, stage, run, f"{stage} {kind}, spent double", "spent double, fired boolean", "append", ts)


def scan_progress(events: DataFrame, run_id: str, hit: str, target: int, ts: str | None = None) -> DataFrame:
    """(run, scanned, hits, done) per batch; rows after the target count no more. With an event time
    ``ts``, the state of a run that is idle for IDLE_DAYS is dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scanned, hits = state.get if state.exists else (0, 0)
        latest = None
        for p in batches:
            latest = p[ts].max() if ts else None
            for is_hit in p.sort_values("place")[hit]:
                if hits >= target:
                    break
                scanned, hits = scanned + 1, hits + int(is_hit)
        _keep(state, (scanned, hits), latest)
        yield pd.DataFrame({run_id: [key[0]], "scanned": [scanned], "hits": [hits], "done": [hits >= target]})

    kind = dict(events.dtypes)[run_id]
    rows = events.select(run_id, F.col(hit).cast("boolean").alias(hit), F.col("place").cast("long").alias("place"), *([ts] if ts else []))
    return _stateful(rows, run_id, run, f"{run_id} {kind}, scanned long, hits long, done boolean", "scanned long, hits long", "update", ts)


def snapshot(df: DataFrame, path: str, checkpoint: str):
    """A running snapshot that each batch overwrites."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).start()
