"""From documents to shuffled training batches and validation chunks: the operators in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bpe, stream
from ..sources import artifacts


@dataclass
class Prepared:
    tokenizer: bpe.Tokenizer
    tokens: DataFrame  # doc_id, ids
    train: DataFrame  # chunk_id, x, y, place, batch_id
    val: DataFrame  # chunk_id, x, y


def prepare(
    spark: SparkSession, docs: DataFrame, base: str, *, num_docs: int, vocab_size: int = 4000, specials: tuple[str, ...] = ("<|endoftext|>",), block: int = 1024, batch: int = 32, most_val: int = 1_000_000, seed: int = 42
) -> Prepared:
    """The first `num_docs` documents, tokenized, split at the tail, chunked and shuffled.

    Scan, tokenizer and tokens are kept below `base` and read again if they are there; the tokens' key names the tokenizer itself.
    """
    scanned = artifacts.cached(spark, f"{base}/docs/{num_docs}", lambda: stream.head(docs.select("doc_id", "text"), num_docs))
    at = f"{base}/tokenizer/{vocab_size}/{num_docs}"
    if not artifacts.exists(spark, at):
        artifacts.save_tokenizer(spark, bpe.Tokenizer.train(scanned, vocab_size, list(specials)), at)
    tokenizer = artifacts.load_tokenizer(spark, at)
    tokens = artifacts.cached(spark, artifacts.token_cache_path(f"{base}/tokens", tokenizer, num_docs), lambda: bpe.encode_documents(scanned, tokenizer, end=specials[0]))
    sized = tokens.select("doc_id", F.size("ids").cast("long").alias("n"))
    placed = stream.offsets(sized)
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.lit(0).alias("z")).select(stream.split_tail(F.col("t"), most_val).alias("b")).first().b
    sides = stream.split_sizes(placed, total).select("doc_id", "train").join(tokens, "doc_id")
    cut = F.col("train").cast("int")
    train = sides.select("doc_id", F.slice("ids", F.lit(1), cut).alias("ids"))
    val = sides.select("doc_id", F.slice("ids", cut + 1, F.greatest(F.lit(0), F.size("ids") - cut)).alias("ids"))
    return Prepared(tokenizer, tokens, stream.permuted_batches(stream.chunks(train, block), batch, seed), stream.chunks(val, block))
