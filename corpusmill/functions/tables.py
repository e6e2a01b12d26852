"""Table functions for SQL: pre-tokens and token ids of a text, for use with LATERAL.

    register(spark)
    SELECT doc_id, t.at, t.word FROM documents, LATERAL pretokens(text) t
    SELECT doc_id, t.at, t.id, t.token FROM documents, LATERAL token_ids(text, '/shared/tokenizer', '<|endoftext|>') t

The argument types are checked when the query is analysed; there, too, the tokenizer's file is read, once, and goes to the tasks
with the plan. Null and empty text have no rows (but for the end token, if one is named).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .text import PRETOKEN


def _string(name: str, argument: AnalyzeArgument, constant: bool = False) -> str | None:
    """The value of a string argument, if it is a constant; another type raises."""
    if argument.isTable or not isinstance(argument.dataType, StringType):
        raise TypeError(f"{name} must be a string")
    if constant and (not argument.isConstantExpression or argument.value is None):
        raise ValueError(f"{name} must be a constant")
    return argument.value


class Pretokens:
    """at, word: the pre-tokens of a text in order."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _string("text", text)
        return AnalyzeResult(StructType().add("at", IntegerType()).add("word", StringType()))

    def __init__(self):
        self.find = regex.compile(PRETOKEN).finditer

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for at, m in enumerate(self.find(text or "")):
            yield at, m.group()


@dataclass
class WithTokenizer(AnalyzeResult):
    """The result's columns, and the tokenizer's file."""

    spec: str = ""
    end: str = ""


def _read(path: str) -> str:
    """A tokenizer file, or the folder that save_tokenizer() writes."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    names = [at]
    if store.get_file_info(at).type == fs.FileType.Directory:
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-"))
    parts = []
    for name in names:
        with store.open_input_stream(name) as stream:
            parts.append(stream.read().decode())
    return "".join(parts)


class TokenIds:
    """at, id, token: the ids of a text in order, then that of the end token, if one is named."""

    @staticmethod
    def analyze(text: AnalyzeArgument, path: AnalyzeArgument, end: AnalyzeArgument | None = None) -> WithTokenizer:
        _string("text", text)
        spec = _read(_string("path", path, True))
        name = _string("end", end, True) if end is not None else ""
        if name and name not in json.loads(spec)["special_tokens"]:
            raise ValueError(f"{name!r} is no special token of the tokenizer")
        return WithTokenizer(StructType().add("at", IntegerType()).add("id", IntegerType()).add("token", BinaryType()), spec=spec, end=name)

    def __init__(self, analyzed: WithTokenizer):
        from ..operators.bpe import Tokenizer

        spec = json.loads(analyzed.spec)
        vocab = {int(i): bytes.fromhex(t) for i, t in spec["vocab"].items()}
        self.tokenizer = Tokenizer(dict(sorted(vocab.items())), [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in spec["merges"]], spec["special_tokens"])
        self.tail = [self.tokenizer.ids[analyzed.end.encode()]] if analyzed.end else []

    def eval(self, text: str, path: str, end: str | None = None) -> Iterator[tuple[int, int, bytes]]:
        for at, i in enumerate([*self.tokenizer.encode(text or ""), *self.tail]):
            yield at, i, self.tokenizer.vocab[i]


def register(spark: SparkSession) -> None:
    """Name the functions `pretokens` and `token_ids` in a session."""
    spark.udtf.register("pretokens", udtf(Pretokens))
    spark.udtf.register("token_ids", udtf(TokenIds))
