"""Training metrics and schedules as DataFrame queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .names import reserve
from .stream import range_of


def _blocks(log: DataFrame, by: list[str], order: list[str], buckets: int | None) -> DataFrame:
    """`log` with run_ (all of `by`; nulls are a value) and block_: the rows' first order column cut at its quantiles, nulls first.

    A run's rows of one block are what a task sees at once; so a run of most rows is many tasks' work. `order[0]` is a number or a time.
    """
    buckets = buckets or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = log.agg(F.percentile_approx(order[0], [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets).alias("b")).first().b or []
    block = F.coalesce(range_of(F.col(order[0]), sorted(set(bounds))) + F.lit(1), F.lit(0)) if bounds else F.lit(0)
    return log.withColumn("run_", F.struct(*by)).withColumn("block_", F.when(F.col(order[0]).isNull(), 0).otherwise(block))


def _inside(order: list[str]) -> WindowSpec:
    return Window.partitionBy("run_", "block_").orderBy(*order)


def _blocks_before() -> WindowSpec:
    return Window.partitionBy("run_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)


def running_best(log: DataFrame, value: str, order: list[str], by: list[str], buckets: int | None = None) -> DataFrame:
    """`log` with best (the least value so far, this row's included) and improved (strictly less than all before).

    NaN and null never improve; they don't count for the best. A prefix minimum in two levels: a row for each run and block with
    what comes before the block, and a window inside it.
    """
    reserve(log, "improved", "best", "run_", "block_", "prior_", "carry_", "least_")
    rows = _blocks(log, by, order, buckets)
    number = F.when(~F.isnan(value), F.col(value))
    least = rows.groupBy("run_", "block_").agg(F.min(number).alias("least_"))
    carry = least.select("run_", "block_", F.min("least_").over(_blocks_before()).alias("carry_"))
    before = _inside(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("prior_", F.min(number).over(before)).join(carry, ["run_", "block_"])
    prior = F.least("prior_", "carry_")
    improved = F.coalesce(number.isNotNull() & (prior.isNull() | (number < prior)), F.lit(False))
    found = joined.withColumn("improved", improved).withColumn("best", F.when(F.col("improved"), F.col(value)).otherwise(prior))
    return found.drop("run_", "block_", "prior_", "carry_")


def early_stop(log: DataFrame, patience: int, order: list[str], by: list[str], buckets: int | None = None) -> DataFrame:
    """A running_best() log up to and with the row where `patience` rows in a row didn't improve (0: all), and `stale`, their number.

    Row numbers and the last improvement's number come in two levels, as in running_best(); the first row that stops a run is a
    minimum by run.
    """
    reserve(log, "rn_", "stale", "run_", "block_", "in_", "last_", "rows_", "start_", "before_", "stop_")
    rows = _blocks(log, by, order, buckets).withColumn("in_", F.row_number().over(_inside(order)).cast("long"))
    better = F.when(F.col("improved"), F.col("in_"))
    sums = rows.groupBy("run_", "block_").agg(F.count("*").alias("rows_"), F.max(better).alias("last_"))
    started = sums.withColumn("start_", F.coalesce(F.sum("rows_").over(_blocks_before()), F.lit(0)))
    carry = started.select("run_", "block_", "start_", F.max(F.col("start_") + F.col("last_")).over(_blocks_before()).alias("before_"))
    upto = _inside(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("last_", F.max(better).over(upto)).join(carry, ["run_", "block_"])
    last = F.coalesce(F.col("start_") + F.col("last_"), "before_", F.lit(0))
    counted = joined.withColumn("rn_", F.col("start_") + F.col("in_")).withColumn("stale", F.col("rn_") - last).drop("block_", "in_", "last_", "start_", "before_")
    if patience:
        stops = counted.where(F.col("stale") >= patience).groupBy("run_").agg(F.min("rn_").alias("stop_"))
        counted = counted.join(stops, "run_", "left").where(F.col("stop_").isNull() | (F.col("rn_") <= F.col("stop_"))).drop("stop_")
    return counted.drop("run_", "rn_")


def batch_means(losses: DataFrame, value: str, batch: Column, by: list[str]) -> DataFrame:
    """The mean loss of each batch."""
    return losses.groupBy(*by, batch.alias("batch")).agg(F.avg(value).alias("loss"))


def perplexity(batches: DataFrame, by: list[str]) -> DataFrame:
    """exp of the unweighted mean of the batches' losses: a short last batch counts as much as the others."""
    return batches.groupBy(*by).agg(F.exp(F.avg("loss")).alias("ppl"))


def every_k(log: DataFrame, k: int, step: str = "step") -> DataFrame:
    return log.where(F.col(step) % k == 0)


def tokens_seen(step: Column, batch: int, context: int) -> Column:
    """step * batch * context, also where the last batch was short."""
    return step.cast("long") * (batch * context)


def within_budget(log: DataFrame, budget: int, batch: int, context: int, step: str = "step") -> DataFrame:
    """Steps up to and with the first that reaches the token budget; 0: all."""
    seen = tokens_seen(F.col(step), batch, context)
    return log if not budget else log.where(seen - batch * context < budget)


def total_steps(budget: int, batch: int, context: int, loader: int) -> int:
    return budget // (batch * context) if budget else loader


def learning_rate(t: Column, total: int, rate: float) -> Column:
    """The rate after t scheduler updates: linear warm-up over 2 % of the steps from 1e-5 of the rate, then a cosine to 10 % of it."""
    warm = max(1, int(0.02 * total))
    rest = max(1, total - warm)
    up = F.lit(rate) * (1e-5 + (1 - 1e-5) * t / F.lit(warm))
    down = 0.1 * rate + 0.9 * rate * (1 + F.cos(F.lit(math.pi) * (t - warm) / F.lit(rest))) / 2
    return F.when(t < warm, up).otherwise(down)


def schedule(spark: SparkSession, total: int, rate: float) -> DataFrame:
    """step, lr for steps 1 to total, as logged: after the step's update."""
    return spark.range(1, total + 1).select(F.col("id").alias("step"), learning_rate(F.col("id").cast("double"), total, rate).alias("lr"))


def counts(tokens: DataFrame, block: int, batch: int) -> DataFrame:
    """documents, tokens, samples, batches of a (doc_id, n) table."""
    total = tokens.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return total.withColumn("samples", F.greatest(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block).cast("long"))).withColumn("batches", F.ceil(F.col("samples") / batch).cast("long"))


def eval_records(log: DataFrame, k: int, total: int) -> DataFrame:
    """Every k-th step of (step, loss, val_loss, lr) as a log row: step, total_steps, loss, train_ppl, val_ppl, lr."""
    return every_k(log, k).select("step", F.lit(total).alias("total_steps"), "loss", F.exp("loss").alias("train_ppl"), F.exp("val_loss").alias("val_ppl"), "lr")


def final_metrics(log: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The last row's value and the best one of each run; NaN is never the best."""
    number = F.when(~F.isnan(value), F.col(value))
    return log.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("final"), F.min(number).alias("best"), F.count("*").alias("rows"))
