"""Analysis of compute-budget sweeps: sizes, optima, power laws and learning-rate schedules, all as DataFrame queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_parameters(d: Column, layers: Column) -> Column:
    """Non-embedding parameters for a feed-forward width of 4 d, without biases and norms."""
    return (12 * layers * d * d).cast("long")


def total_parameters(d: Column, layers: Column, ff: Column, vocab: int, context: int) -> Column:
    """All parameters: blocks with biases and two norms, embeddings, last norm, head."""
    blocks = layers * (4 * (d * d + d) + 2 * d * ff + ff + d + 4 * d)
    return (blocks + vocab * d + context * d + 2 * d + d * vocab + vocab).cast("long")


def measures(sweep: DataFrame) -> DataFrame:
    """`sweep` with n (parameters), tokens, compute (6 n tokens), ratio (tokens / n) and ln_ppl."""
    n = block_parameters(F.col("d"), F.col("l"))
    tokens = (F.col("tokens_m") * 1_000_000).cast("long")
    return sweep.withColumn("n", n).withColumn("tokens", tokens).withColumn("compute", 6.0 * F.col("n") * F.col("tokens")).withColumn("ratio", F.col("tokens") / F.col("n")).withColumn("ln_ppl", F.ln("val_ppl"))


def optimum(measured: DataFrame, by: str = "c") -> DataFrame:
    """For each budget the row of the least perplexity (ties: fewer parameters): n, tokens, ratio, val_ppl, ln_ppl, lr."""
    best = F.min_by(F.struct("n", "tokens", "ratio", "val_ppl", "ln_ppl", "lr"), F.struct("val_ppl", "n")).alias("b")
    return measured.groupBy(by).agg(best).select(by, "b.*")


def interior(measured: DataFrame, by: str = "c") -> DataFrame:
    """Each budget's optimum and whether sizes on both sides were tried: interior."""
    over = Window.partitionBy(by)
    placed = measured.withColumn("up", F.row_number().over(over.orderBy("n", "tokens"))).withColumn("down", F.row_number().over(over.orderBy(F.desc("n"), F.desc("tokens"))))
    best = F.min_by(F.struct("n", "up", "down"), F.struct("val_ppl", "n")).alias("b")
    return placed.groupBy(by).agg(best).select(by, "b.n", ((F.col("b.up") > 1) & (F.col("b.down") > 1)).alias("interior"))


def power_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """exponent and log_factor of y = exp(log_factor) * x^exponent, by least squares on logarithms."""
    return points.agg(F.regr_slope(F.ln(y), F.ln(x)).alias("exponent"), F.regr_intercept(F.ln(y), F.ln(x)).alias("log_factor"))


def extrapolate(fit: DataFrame, at: float) -> DataFrame:
    return fit.select(F.lit(at).alias("x"), F.exp(F.col("log_factor") + F.col("exponent") * F.ln(F.lit(at))).alias("y"))


def best_rates(rates: DataFrame, by: str = "d") -> DataFrame:
    """The learning rate of the least perplexity for each width."""
    return rates.groupBy(by).agg(F.min_by("lr", F.struct("val_ppl", "lr")).alias("lr"), F.min("val_ppl").alias("val_ppl"))


def interpolated_rates(configs: DataFrame, anchors: DataFrame) -> DataFrame:
    """`configs` (with n) with rate: linear in ln n between anchors (n, lr), carried on beyond the first and last.

    Anchors become segments, one row each, which are few; a config joins the segment that it lies in.
    """
    order = Window.orderBy("n")  # anchors: a handful
    a = anchors.select("n", "lr").withColumn("n2", F.lead("n").over(order)).withColumn("lr2", F.lead("lr").over(order)).withColumn("k", F.row_number().over(order)).where("n2 IS NOT NULL")
    last = a.agg(F.max("k").alias("last_k"))
    s = a.crossJoin(last)  # one row
    low = F.when(F.col("k") == 1, F.lit(float("-inf"))).otherwise(F.col("s.n").cast("double"))
    high = F.when(F.col("k") == F.col("last_k"), F.lit(float("inf"))).otherwise(F.col("s.n2").cast("double"))
    s = s.alias("s").select(low.alias("low"), high.alias("high"), F.col("s.n").alias("n1"), F.col("s.lr").alias("lr1"), "n2", "lr2")
    joined = configs.join(s, (configs.n >= F.col("low")) & (configs.n < F.col("high")))
    part = (F.ln(configs.n) - F.ln("n1")) / (F.ln("n2") - F.ln("n1"))
    return joined.withColumn("rate", F.col("lr1") + (F.col("lr2") - F.col("lr1")) * part).drop("low", "high", "n1", "n2", "lr1", "lr2")


def compare(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two sweeps on their configuration: loss and val_ppl of each, and the change."""
    a = one.select(*on, F.col("val_ppl").alias("ppl_1"), F.col("loss").alias("loss_1"))
    b = two.select(*on, F.col("val_ppl").alias("ppl_2"), F.col("loss").alias("loss_2"))
    return a.join(b, on, "full").withColumn("ppl_change", F.col("ppl_2") - F.col("ppl_1"))


def numbered(sweep: DataFrame, order: list[str]) -> DataFrame:
    """Runs in order, with their number."""
    return sweep.withColumn("run", F.row_number().over(Window.orderBy(*order)))  # a sweep has some dozens of rows


def valid(runs: DataFrame) -> DataFrame:
    """Runs with a flag: the budget was reached (a shorter stream ends the single pass early)."""
    return runs.withColumn("valid", F.col("tokens_seen") >= F.col("token_budget"))
