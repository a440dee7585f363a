"""Aggregates over scored rows, logs, ledgers and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import lora_parameters, py_round, spend, training_bytes


def report_summary(reports: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The measures of a system over its topics; means are null without rows."""
    c = F.col
    yes = lambda name: F.count_if(c(name)).alias(name)
    clean = c("structure_ok") & (c("n_typo") == 0) & (c("n_calque") == 0) & (c("titlecase") == 0) & ~c("untranslated")
    mean = lambda name, digits: py_round(F.avg(name), digits).alias(f"mean_{name}")
    return reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *map(yes, ("xml_ok", "skeleton_ok", "header_ok", "structure_ok", "untranslated")),
        *[F.sum(x).alias(x) for x in ("protected_changed", "protected_total", "n_typo", "n_calque", "titlecase", "titles")],
        *[F.sum(f"typo.{x}").alias(x) for x in ("nbsp_missing", "guillemet_space", "en_quotes")],
        mean("reward", 4),
        mean("chrf", 2),
        mean("english_ratio", 4),
        mean("len_ratio", 4),
        F.count_if(clean).alias("clean_topics"),
    )


def map_totals(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, total): sums of an open map's values."""
    return df.select(*by, F.explode(col).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("total"))


def format_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(x).alias(x) for x in ("well_formed", "skeleton_match", "dtd_valid", "format_broken", "truncated")],
        F.coalesce(F.avg("format_reward"), F.lit(0.0)).alias("mean_reward"),
        F.coalesce(F.avg("lcs"), F.lit(0.0)).alias("mean_lcs"),
        F.coalesce(F.avg("attr_recall"), F.lit(0.0)).alias("mean_attr_recall"),
    )


def reason_histogram(df: DataFrame) -> DataFrame:
    """(reason, n): a row counts once for each of its reasons."""
    return df.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def primary_histogram(df: DataFrame) -> DataFrame:
    broken = df.filter("format_broken")
    return broken.groupBy(F.coalesce("primary_reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def violation_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with violations of one kind only, of both, and sums of occurrences."""
    s, p = F.col("schema") > 0, F.col("punct") > 0
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s | p).alias("violated"),
        F.count_if(s & p).alias("both"),
        F.count_if(~s & p).alias("punct_only"),
        F.count_if(s & ~p).alias("schema_only"),
        F.sum("violations").alias("violations"),
        F.sum("schema").alias("schema"),
        F.sum("punct").alias("punct"),
        F.coalesce(F.avg("violation_reward"), F.lit(0.0)).alias("mean_reward"),
    )


def latency(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact median, mean and extremes of the values that are there."""
    c = F.col(col)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def changed(before_after: DataFrame, before: str = "before", after: str = "after", by: tuple[str, ...] = ()) -> DataFrame:
    b, a = F.col(before), F.col(after)
    return before_after.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a > b).alias("improved"),
        F.count_if(a < b).alias("regressed"),
        F.count_if(a == b).alias("unchanged"),
        F.avg(b).alias("mean_before"),
        F.avg(a).alias("mean_after"),
    )


def multiset_recall(source: DataFrame, hyp: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """(keys, recall): the share of source items that the hypothesis has, each as often as it has it."""
    need = source.groupBy(*keys, *item).agg(F.count(F.lit(1)).alias("need"))
    have = hyp.groupBy(*keys, *item).agg(F.count(F.lit(1)).alias("have"))
    both = need.join(have, [*keys, *item], "left")
    hit = F.sum(F.least("need", F.coalesce("have", F.lit(0))))
    return both.groupBy(*keys).agg((hit / F.sum("need")).alias("recall"))


def judge_means(df: DataFrame, scores: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the scores that are numbers; a judge may also answer n/a."""
    return df.groupBy(*by).agg(*[F.avg(X.numeric_score(F.col(s))).alias(f"mean_{s}") for s in scores], *[F.count(X.numeric_score(F.col(s))).alias(f"n_{s}") for s in scores])


def parse_judgement(answer: Column) -> Column:
    return F.from_json(X.json_object(answer), "faithfulness string, fluency string, french string, note string")


def step_means(df: DataFrame, measures: tuple[str, ...], width: int = 1) -> DataFrame:
    """Means per step, or per run of ``width`` steps counted from step 1."""
    step = F.floor((F.col("step") - 1) / width).alias("bin") if width > 1 else F.col("step")
    return df.groupBy(step).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in measures])


def best_step(df: DataFrame, measure: str = "mean_reward") -> DataFrame:
    """The step with the highest measure; of equal ones the first."""
    best = F.max(F.struct(F.col(measure).alias("value"), (-F.col("step")).alias("minus")))
    return df.agg(best.alias("b")).select((-F.col("b.minus")).alias("step"), F.col("b.value").alias("value"))


def shortest(df: DataFrame, size: Column, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    least = F.min(F.struct(size.alias("size"), F.col(key).alias("key")))
    return df.groupBy(*by).agg(least.alias("b")).select(*by, F.col("b.key").alias(key), F.col("b.size").alias("size"))


def largest_useful_batch(df: DataFrame, gain: float = 1.15) -> DataFrame:
    """The largest batch, short of the first failure, at ``gain`` times the throughput of batch 1."""
    end = df.filter("failed").agg(F.min("batch").alias("stop"))
    one = df.filter("batch = 1 AND NOT failed").agg(F.max("tok_s").alias("one"))
    ok = df.filter("NOT failed").crossJoin(F.broadcast(end)).crossJoin(F.broadcast(one))  # one row each
    good = ok.filter((F.col("stop").isNull() | (F.col("batch") < F.col("stop"))) & (F.col("tok_s") >= gain * F.col("one")))
    return good.agg(F.coalesce(F.max("batch"), F.lit(1)).alias("batch"))


def pod_spend(ledger: DataFrame) -> DataFrame:
    """(pod, seconds, usd): time between creation and termination at the pod's rate."""
    t = F.unix_micros(F.to_timestamp("t")) / 1e6
    rows = ledger.filter("pod IS NOT NULL").groupBy("pod").agg(
        F.min(F.when(F.col("event") == "create", t)).alias("start"),
        F.max(F.when(F.col("event") == "terminate", t)).alias("end"),
        F.max("cost_per_hr").alias("rate"),
    )
    return rows.filter("start IS NOT NULL AND end IS NOT NULL").select("pod", (F.col("end") - F.col("start")).alias("seconds"), spend(F.col("rate"), F.col("end") - F.col("start")).alias("usd"))


def balance_spend(ledger: DataFrame) -> DataFrame:
    b = F.struct(F.to_timestamp("t").alias("t"), F.col("client_balance").alias("v"))
    has = ledger.filter("client_balance IS NOT NULL")
    return has.agg((F.min(b)["v"] - F.max(b)["v"]).alias("usd"))


def may_run(dev: DataFrame, left: Column | float, cost: float, measure: str = "reward", enough: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean, run): whether a next stage is worth its cost (the mean is short of enough) and can be paid for."""
    mean = F.avg(measure)
    money = left if isinstance(left, Column) else F.lit(float(left))
    return dev.groupBy(*by).agg(mean.alias("mean"), F.min(money).alias("_left")).select(*by, "mean", F.coalesce((F.col("mean") < enough) & (F.col("_left") >= cost), F.lit(False)).alias("run"))


def adapter_sizes(maps: DataFrame, rank: int) -> DataFrame:
    """(part, n_layers, params) for rows (part, name, width_in, width_out, layers): what adapters of a rank add to each part."""
    rows = maps.withColumn("p", lora_parameters(F.lit(rank), F.col("width_in"), F.col("width_out"), F.col("layers")))
    return rows.groupBy("part").agg(F.max("layers").cast("long").alias("n_layers"), F.sum("p").cast("long").alias("params"))


def adapter_choice(sizes: DataFrame, plans: DataFrame, weights: int, allowance: int, device: int) -> DataFrame:
    """(plan, params, bytes, fits, chosen) for plans (rank, plan, part): the first plan by rank that fits the device
    is chosen, or else the last."""
    each = plans.join(sizes, "part").groupBy("rank", "plan").agg(F.sum("params").cast("long").alias("params"))
    need = training_bytes(F.lit(weights), F.col("params"), allowance)
    each = each.withColumn("bytes", need).withColumn("fits", F.col("bytes") < device)
    pick = each.agg(F.coalesce(F.min(F.when(F.col("fits"), F.col("rank"))), F.max("rank")).alias("pick"))
    return each.crossJoin(F.broadcast(pick)).select("plan", "params", "bytes", "fits", (F.col("rank") == F.col("pick")).alias("chosen"))  # one row


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reward_groups(df: DataFrame) -> DataFrame:
    """(rewards, n): how often each list of rewards came up."""
    return df.groupBy("rewards").agg(F.count(F.lit(1)).alias("n"))


def present(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The listed columns that there are."""
    return df.select(*[k for k in keys if k in df.columns])


def keep_payload(df: DataFrame, payload: str, keep: Column) -> DataFrame:
    return df.withColumn(payload, F.when(keep, F.col(payload)).otherwise(F.lit("")))


def generation_rows(df: DataFrame) -> DataFrame:
    """Adds hit_cap and tok_s to rows (new_tokens, max_new, latency_s)."""
    c = F.col
    return df.withColumns({"hit_cap": c("new_tokens") >= c("max_new") - 1, "tok_s": F.when(c("latency_s") > 0, c("new_tokens") / c("latency_s"))})


def with_failures(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Scored rows and rows of runs that failed, with nulls where these have no values."""
    return rows.unionByName(failures, allowMissingColumns=True)
