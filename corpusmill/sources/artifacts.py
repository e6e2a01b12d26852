"""Files of a training run: tokenizer JSON, cached scans, token caches, logs and run configurations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe import Tokenizer

TOKENIZER = "vocab map<string,string>, merges array<array<string>>, special_tokens array<string>"
#: One schema for both variants of a run's configuration; a field that a variant lacks is null.
RUN_CONFIG = """timestamp string, seed int, device string,
 data struct<data_dir:string,num_docs:bigint,total_tokens:bigint,train_samples:bigint,val_samples:bigint>,
 tokenizer struct<vocab_size:int,special_tokens:array<string>>,
 model struct<context_length:int,d_model:int,d_ff:int,num_heads:int,num_layers:int,total_params:bigint>,
 training struct<batch_size:int,learning_rate:double,eval_interval:int,early_stop:int,token_budget:bigint,tokens_seen:bigint,
  final_step:int,total_steps:int,best_val_ppl:double,final_train_ppl:double,final_val_ppl:double>,
 generation array<struct<prompt:string,output:string>>"""
LOG = "step int, total_steps int, loss double, train_ppl double, val_ppl double, lr double"


def save_tokenizer(spark: SparkSession, tokenizer: Tokenizer, path: str) -> None:
    """One JSON document; tokens in hex. Written by Spark, so `path` may be in any store."""
    text = json.dumps(
        {"vocab": {str(i): t.hex() for i, t in tokenizer.vocab.items()}, "merges": [[a.hex(), b.hex()] for a, b in tokenizer.merges], "special_tokens": tokenizer.specials}
    )
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """A tokenizer of save_tokenizer() or of a plain JSON file of the same form; explicit schema, no inference."""
    row = spark.read.schema(TOKENIZER).json(path, multiLine=True).first()
    vocab = {int(i): bytes.fromhex(t) for i, t in row.vocab.items()}
    return Tokenizer(dict(sorted(vocab.items())), [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in row.merges], list(row.special_tokens))


def merges_frame(spark: SparkSession, path: str) -> DataFrame:
    """rank, l, r (hex) of a tokenizer file."""
    return spark.read.schema(TOKENIZER).json(path, multiLine=True).select(F.posexplode("merges").alias("rank", "m")).select("rank", F.get("m", F.lit(0)).alias("l"), F.get("m", F.lit(1)).alias("r"))


def exists(spark: SparkSession, path: str) -> bool:
    """True if Spark's file system has the path (with its success mark, for a table that Spark wrote)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and (not fs.getFileStatus(at).isDirectory() or fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, made and written first if it isn't there."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(tokenizer: Tokenizer) -> str:
    body = json.dumps([[(i, t.hex()) for i, t in sorted(tokenizer.vocab.items())], [(a.hex(), b.hex()) for a, b in tokenizer.merges], tokenizer.specials])
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def token_cache_path(base: str, tokenizer: Tokenizer, docs: int) -> str:
    """The key names the tokenizer itself, not its size alone."""
    return f"{base}/vocab_size={tokenizer.vocab_size}/docs={docs}/tokenizer={fingerprint(tokenizer)}"


def write_log(log: DataFrame, path: str) -> None:
    """CSV with fixed precision: losses 6 digits, perplexities 4, rates 6 in exponent form."""
    shown = {"step": F.col("step"), "total_steps": F.col("total_steps"), "loss": F.format_string("%.6f", "loss"), "train_ppl": F.format_string("%.4f", "train_ppl"), "val_ppl": F.format_string("%.4f", "val_ppl"), "lr": F.format_string("%.6e", "lr")}
    log.select(*[shown[c].alias(c) for c in log.columns]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Logs with or without a rate (null then); columns go by the header's names."""
    plain = spark.read.csv(path, header=True, enforceSchema=False)
    kinds = [x.strip().split(" ") for x in LOG.split(",")]
    return plain.select(*[(F.col(n) if n in plain.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def write_run_config(config: DataFrame, path: str) -> None:
    config.coalesce(1).write.mode("overwrite").json(path)


def read_run_configs(spark: SparkSession, glob: str) -> DataFrame:
    """All configurations below a glob, of either variant, with the file's name."""
    return spark.read.schema(RUN_CONFIG).json(glob, multiLine=True).withColumn("file", F.input_file_name())


def overridden(defaults: dict, given: dict) -> dict:
    """Defaults, with those given in place of them that aren't None."""
    return defaults | {k: v for k, v in given.items() if v is not None}


def run_name(at):
    """yyyyMMdd_HHmmss of a timestamp column."""
    return F.date_format(at, "yyyyMMdd_HHmmss")
