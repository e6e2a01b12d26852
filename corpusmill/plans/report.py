"""What a run says about itself: texts generated from prompts, kept in the run's configuration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bpe, model


def generated(prompts: DataFrame, tokenizer: bpe.Tokenizer, params: dict[str, np.ndarray], n_heads: int, **options) -> DataFrame:
    """key, prompt, output of `prompts` (key, prompt): encoded, continued by the decoder, and decoded again, the prompt included."""
    spark = prompts.sparkSession
    ids = bpe.encode_documents(prompts.select("key", F.col("prompt").alias("text")), tokenizer, key="key")
    drawn = model.generate(ids, params, n_heads, **options).select("key", F.col("output").alias("ids"))
    texts = bpe.decode_documents(drawn, bpe.vocab_frame(spark, tokenizer), "key")
    return prompts.select("key", "prompt").join(texts.withColumnRenamed("text", "output"), "key")


def with_generation(config: DataFrame, texts: DataFrame) -> DataFrame:
    """`config` (one row) with `generation`: prompt and output of a run's few prompts, in key order."""
    listed = texts.agg(F.array_sort(F.collect_list(F.struct("key", "prompt", "output"))).alias("all_"))
    pairs = F.transform("all_", lambda x: F.struct(x["prompt"].alias("prompt"), x["output"].alias("output")))
    return config.drop("generation").crossJoin(F.broadcast(listed)).withColumn("generation", pairs).drop("all_")  # one row each
