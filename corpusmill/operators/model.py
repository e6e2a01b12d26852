"""The dense operations of a decoder over arrays and relations; meant for inspection and tests, not for training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """array<double>: weights (one row for each output) times x, plus the bias."""
    rows = [dot(x, F.array(*[F.lit(float(v)) for v in w])) + F.lit(float(bias[i]) if bias else 0.0) for i, w in enumerate(weights)]
    return F.array(*rows)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def softmax(x: Column) -> Column:
    """array<double> of an array; the largest value is taken off first."""
    raised = let(_doubles(x), lambda n: let(F.array_max(n), lambda top: F.transform(n, lambda v: F.exp(v - top))))
    return let(raised, lambda e: let(_sum(e), lambda total: F.transform(e, lambda v: v / total)))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps), without scale and shift."""
    centred = let(_doubles(x), lambda n: let(_sum(n) / F.size(n), lambda mean: F.transform(n, lambda v: v - mean)))
    return let(centred, lambda c: let(F.sqrt(_sum(F.transform(c, lambda v: v * v)) / F.size(c) + eps), lambda width: F.transform(c, lambda v: v / width)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """ln(sum(exp(z - max))) + max - z[target] of one position; target counts from 0."""
    return let(_doubles(logits), lambda n: let(F.array_max(n), lambda top: F.ln(_sum(F.transform(n, lambda v: F.exp(v - top)))) + top - F.get(n, target)))


def split_cross_entropy(slices: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """key, loss: cross_entropy() of positions whose logits are spread over rows of `slices` (key, first, z): z holds the logits from
    number `first` on. `targets` (key, target) says which one counts; a target in no slice gives null.

    A slice gives its largest logit, its sum of exp(z - largest), and the target's logit if it has it; these are merged by position,
    so that no row ever holds a position's whole vocabulary. Empty slices add nothing.
    """
    at = slices.join(targets.select(key, "target"), key).where(F.size("z") > 0)
    inside = (F.col("target") >= F.col("first")) & (F.col("target") < F.col("first") + F.size("z"))
    own = F.when(inside, F.get("z", (F.col("target") - F.col("first")).cast("int")).cast("double"))
    part = let(_doubles(F.col("z")), lambda n: let(F.array_max(n), lambda top: F.struct(top.alias("m"), _sum(F.transform(n, lambda v: F.exp(v - top))).alias("s"))))
    merged = at.select(key, part.alias("p"), own.alias("z_")).groupBy(key).agg(F.collect_list("p").alias("p"), F.max("z_").alias("z_"))
    total = let(F.col("p"), lambda p: let(F.array_max(F.transform(p, lambda q: q["m"])), lambda top: F.ln(_sum(F.transform(p, lambda q: q["s"] * F.exp(q["m"] - top)))) + top))
    return merged.select(key, (total - F.col("z_")).alias("loss"))


def heads(x: DataFrame, count: int, value: str = "x") -> DataFrame:
    """`x` (seq, t, value: array) with a row for each head: head, and its slice of the value; the width must divide evenly."""
    width = F.size(value)
    fits = F.when(width % count != 0, F.raise_error(F.lit("the width isn't a multiple of the heads"))).otherwise(F.lit(0))
    each = x.withColumn("head", F.explode(F.sequence(fits, F.lit(count - 1))))
    return each.withColumn(value, F.slice(value, F.col("head") * (width / count).cast("int") + 1, (width / count).cast("int")))


def attention_scores(x: DataFrame, value: str = "x", causal: bool = True) -> DataFrame:
    """seq, head, q, k, score: scaled dot products; causal: only k <= q, as a condition of the equi-join on seq and head."""
    a = x.select("seq", "head", F.col("t").alias("q"), F.col(value).alias("a"))
    b = x.select(F.col("seq").alias("seq_"), F.col("head").alias("head_"), F.col("t").alias("k"), F.col(value).alias("b"))
    on = (F.col("seq") == F.col("seq_")) & (F.col("head") == F.col("head_"))
    joined = a.join(b, on & (F.col("k") <= F.col("q")) if causal else on)
    return joined.select("seq", "head", "q", "k", (dot("a", "b") / F.sqrt(F.size("a").cast("double"))).alias("score"))


def attention(scores: DataFrame) -> DataFrame:
    """scores with p, the softmax over the keys of a query."""
    over = Window.partitionBy("seq", "head", "q")
    raised = scores.withColumn("e_", F.exp(F.col("score") - F.max("score").over(over)))
    return raised.withColumn("p", F.col("e_") / F.sum("e_").over(over)).drop("e_")


def mean_over_heads(probabilities: DataFrame) -> DataFrame:
    return probabilities.groupBy("seq", "q", "k").agg(F.avg("p").alias("p"))


def attend(probabilities: DataFrame, x: DataFrame, value: str = "x") -> DataFrame:
    """seq, head, t, dim, o: the values weighted by attention."""
    v = x.select("seq", "head", F.col("t").alias("k"), F.posexplode(value).alias("dim", "v"))
    out = probabilities.join(v, ["seq", "head", "k"]).groupBy("seq", "head", F.col("q").alias("t"), "dim")
    return out.agg(F.sum(F.col("p") * F.col("v").cast("double")).alias("o"))


def last_position(x: DataFrame, value: str = "x") -> DataFrame:
    """seq, and the value at its last position."""
    return x.groupBy("seq").agg(F.max_by(value, "t").alias(value))


def residual(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def feed_forward(x: Column, up: list[list[float]], up_bias: list[float], down: list[list[float]], down_bias: list[float]) -> Column:
    """Linear, ReLU, linear; dropout is the identity."""
    return let(relu(linear(x, up, up_bias)), lambda h: linear(h, down, down_bias))


def embed(tokens: DataFrame, token_table: DataFrame, position_table: DataFrame) -> DataFrame:
    """seq, t, x: token vector plus position vector of (seq, t, id); two equi-joins with (id, v) and (t, v)."""
    at = tokens.join(token_table.select("id", F.col("v").alias("a")), "id").join(position_table.select("t", F.col("v").alias("b")), "t")
    return at.select("seq", "t", F.zip_with("a", "b", lambda x, y: x.cast("double") + y.cast("double")).alias("x"))


def pick(probabilities: Column, u: Column) -> Column:
    """The first index whose cumulative probability is at least u (the last index beyond the sum)."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    step = lambda at, v: F.struct((at["s"] + v).alias("s"), (at["i"] + F.when(at["s"] + v < u, 1).otherwise(0)).alias("i"))
    return let(probabilities, lambda p: F.aggregate(p, start, step, lambda at: F.least(at["i"], F.size(p) - 1)))


# The whole decoder, for a batch of sequences in a task. Parameters by name: arrays of a trained or random model.


def decoder(params: dict[str, np.ndarray], ids: np.ndarray, n_heads: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits (T, V) of one sequence, and each layer's attention averaged over its heads. Pre-norm, causal, no dropout."""
    block = len(params["positions"])
    if len(ids) > block:
        raise ValueError(f"{len(ids)} ids exceed the block of {block}")
    x = params["tokens"][ids] + params["positions"][: len(ids)]
    maps, layer = [], 0
    while f"{layer}.q" in params:
        part = lambda name, h, layer=layer: h @ params[f"{layer}.{name}"].T + params[f"{layer}.{name}_b"]
        h = _norm(x)
        q, k, v = (part(n, h).reshape(len(ids), n_heads, -1).transpose(1, 0, 2) for n in "qkv")
        s = q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[-1])
        s = np.where(np.tri(len(ids), dtype=bool), s, -np.inf)
        p = _softmax(s)
        maps.append(p.mean(axis=0))
        x = x + part("o", (p @ v).transpose(1, 0, 2).reshape(len(ids), -1))
        x = x + part("down", np.maximum(part("up", _norm(x)), 0))
        layer += 1
    return _norm(x) @ params["head"].T + params["head_b"], maps


def _norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def random_decoder(vocab: int, block: int, d: int, layers: int, ff: int, seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shapes = {"q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "up": (ff, d), "down": (d, ff)}
    made = {"tokens": r.normal(size=(vocab, d)), "positions": r.normal(size=(block, d)), "head": r.normal(size=(vocab, d)) / d**0.5, "head_b": np.zeros(vocab)}
    for layer in range(layers):
        for name, shape in shapes.items():
            made |= {f"{layer}.{name}": r.normal(size=shape) / shape[1] ** 0.5, f"{layer}.{name}_b": np.zeros(shape[0])}
    return made


def generate(prompts: DataFrame, params: dict[str, np.ndarray], n_heads: int, *, steps: int = 300, temperature: float = 0.1, seed: int = 42) -> DataFrame:
    """`prompts` (key, ids) with `output`: ids drawn one by one from the softmax of the last logits over the temperature.

    The context is the last ids that fit the block; nothing stops early. Draws depend on seed and key only.
    """
    shared = prompts.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        block = len(own["positions"])
        for batch in batches:
            outputs = []
            for key, ids in zip(batch["key"], batch["ids"]):
                r, now = np.random.default_rng([seed, int(key)]), list(ids)
                for _ in range(steps):
                    logits, _ = decoder(own, np.array(now[-block:]), n_heads)
                    sums = np.cumsum(_softmax(logits[-1] / temperature))
                    now.append(min(int(np.searchsorted(sums, r.random())), len(sums) - 1))
                outputs.append(now)
            yield pd.DataFrame({"key": batch["key"], "output": outputs})

    return prompts.select("key", "ids").mapInPandas(run, "key long, output array<int>")
