"""Word frequency over a stream of documents (an extension: the batch operator of operators.bpe, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import pretokens


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n so far; for output mode update or complete. State is a row for each distinct word."""
    return docs.select(F.explode(pretokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def windowed_counts(docs: DataFrame, time_col: str, window: str, late: str, text_col: str = "text") -> DataFrame:
    """window, word, n for output mode append: a window is given out once nothing later than `late` can still fall into it."""
    words = docs.withWatermark(time_col, late).select(time_col, F.explode(pretokens(F.col(text_col))).alias("word"))
    return words.groupBy(F.window(time_col, window), "word").agg(F.count("*").alias("n"))


def to_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataStreamWriter:
    """A writer into an in-memory table, for inspection."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
