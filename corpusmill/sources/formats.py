"""A run's files as Spark data sources: `spark.read.format(...)` and `df.write.format(...)` after register(spark).

| format | rows | files |
|-|-|-|
| corpusmill_tokens | doc_id long, ids array<int> | Parquet, a file a task; option `tokenizer`: the fingerprint that the ids belong to |
| corpusmill_tokenizer | rank int, l string, r string (hex) | one JSON document; option `specials`: special tokens, a line each |
| corpusmill_log | step, total_steps int; loss, train_ppl, val_ppl, lr double | CSV, a file a task, with the log's fixed precision |

All three write by one protocol. A task writes to a name of its own and tells the driver; a failed one removes what it wrote. The
driver's commit names the files in `_committed.json`, which appears at once and last; only files that it names are read. So a
write that fails, or a task that is lost or repeated, leaves nothing that a reader sees; what a task still wrote after its write
had failed stays until swept() removes it. The folder must be one that pyarrow can
reach from all executors (a shared file system, hdfs, s3, gs).
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

COMMITTED = "_committed.json"
#: Bytes of ids that a task of the tokens' writer or reader holds at once, a row at least.
GROUP_BYTES = 8 << 20


class Folder:
    """Files of one path, in whatever store pyarrow finds it."""

    def __init__(self, path: str):
        self.path = path

    def _at(self, name: str):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, f"{at.rstrip('/')}/{name}"

    def write(self, name: str, body: bytes | Callable[[BinaryIO], None]) -> None:
        """The whole file appears at once, by a rename. What `body` writes to a stream isn't held."""
        store, at = self._at(name)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        temporary = f"{at}.{uuid.uuid4().hex}.tmp"
        try:
            with store.open_output_stream(temporary, compression=None) as out:
                body(out) if callable(body) else out.write(body)
            store.move(temporary, at)
        except BaseException:
            if store.get_file_info(temporary).type.name == "File":
                store.delete_file(temporary)
            raise

    def open(self, name: str) -> pa.NativeFile:
        """For reading at any place."""
        store, at = self._at(name)
        return store.open_input_file(at)

    def read(self, name: str) -> bytes:
        store, at = self._at(name)
        with store.open_input_stream(at, compression=None) as stream:
            return stream.read()

    def remove(self, name: str) -> None:
        store, at = self._at(name)
        try:
            store.delete_file(at)
        except FileNotFoundError:
            pass

    def names(self) -> list[str]:
        from pyarrow import fs

        store, at = self._at("")
        return [f.base_name for f in store.get_file_info(fs.FileSelector(at.rstrip("/"), allow_not_found=True))]

    def committed(self) -> dict | None:
        """What the last commit said, or None before any."""
        store, at = self._at(COMMITTED)
        return json.loads(self.read(COMMITTED)) if store.get_file_info(at).type.name == "File" else None


def swept(path: str) -> list[str]:
    """Remove files that no commit names, of writes that failed; for a time when nobody writes there. Returns their names."""
    folder = Folder(path)
    said = folder.committed()
    gone = [n for n in folder.names() if n.startswith("part-") and n not in (said["files"] if said else ())]
    for name in gone:
        folder.remove(name)
    return gone


@dataclass
class Written(WriterCommitMessage):
    """A task's file; without rows there is none."""

    name: str
    rows: int


@dataclass
class Part(InputPartition):
    name: str


class Committer:
    """The driver's half of a write, and a task's names."""

    kind = ""

    def __init__(self, options: dict, overwrite: bool):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.folder, self.options, self.overwrite = Folder(options["path"]), dict(options), overwrite

    def note(self) -> dict:
        """What else a commit says; it must agree with the commits before, unless these are overwritten."""
        return {}

    def task_file(self, body: bytes | Callable[[BinaryIO], None], rows: int) -> Written:
        name = f"part-{uuid.uuid4().hex}.{self.kind}"
        self.folder.write(name, body)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        before = self.folder.committed() or {"files": [], "note": self.note()}
        if not self.overwrite and before["note"] != self.note():
            self.abort(messages)
            raise ValueError(f"what is there belongs to {before['note']}, not to {self.note()}")
        files = [m.name for m in messages if m and m.rows]
        kept = [] if self.overwrite else before["files"]
        self.folder.write(COMMITTED, json.dumps({"files": kept + files, "note": self.note()}).encode())
        for name in {*before["files"], *(m.name for m in messages if m and m.rows)} - {*kept, *files}:
            self.folder.remove(name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.rows:
                self.folder.remove(m.name)


class Reader(DataSourceReader):
    """A partition for each committed file."""

    def __init__(self, options: dict):
        self.folder = Folder(options["path"])
        self.said = self.folder.committed()
        if self.said is None:
            raise FileNotFoundError(f"nothing is committed at {options['path']}")

    def partitions(self) -> list[Part]:
        return [Part(name) for name in self.said["files"]]


# --- tokens


class TokenWriter(Committer, DataSourceArrowWriter):
    kind = "parquet"

    def note(self) -> dict:
        return {"tokenizer": self.options.get("tokenizer", "")}

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A batch is written when it comes, in row groups of about GROUP_BYTES: a task holds one, however long its file is."""
        parts = (part for batch in batches for part in _groups(batch))
        first = next(parts, None)
        if first is None:
            return Written("", 0)
        rows = 0

        def fill(out: BinaryIO) -> None:
            nonlocal rows
            with pq.ParquetWriter(out, first.schema) as writer:
                for part in itertools.chain([first], parts):
                    writer.write_batch(part)
                    rows += part.num_rows

        name = self.task_file(fill, 0).name
        return Written(name, rows)


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about GROUP_BYTES of ids, a row at least."""
    ends = np.concatenate([[0], np.cumsum(4 * pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy())])
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + GROUP_BYTES, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class TokenReader(Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        wanted = options.get("tokenizer")
        if wanted is not None and wanted != self.said["note"]["tokenizer"]:
            raise ValueError(f"the ids belong to tokenizer {self.said['note']['tokenizer']!r}, not to {wanted!r}")

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """A row group at a time."""
        with self.folder.open(part.name) as file:
            tokens = pq.ParquetFile(file, pre_buffer=False)
            for k in range(tokens.num_row_groups):
                yield from tokens.iter_batches(4096, row_groups=[k])


class Tokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusmill_tokens"

    def schema(self) -> str:
        return "doc_id long, ids array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TokenReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema] != ["doc_id", "ids"]:
            raise ValueError(f"doc_id and ids are written, not {[f.name for f in schema]}")
        return TokenWriter(self.options, overwrite)


# --- a tokenizer


class TokenizerWriter(Committer, DataSourceWriter):
    kind = "json"

    def note(self) -> dict:
        return {"special_tokens": [x for x in self.options.get("specials", "").split("\n") if x]}

    def write(self, rows: Iterator[Row]) -> Written:
        merges = [(r.rank, r.l, r.r) for r in rows]
        return self.task_file(json.dumps(merges).encode(), len(merges)) if merges else Written("", 0)

    def commit(self, messages: list[Written | None]) -> None:
        """The tasks' merges, a row for each id of the vocabulary at most, as one document."""
        parts = [m for m in messages if m and m.rows]
        if not self.overwrite and self.folder.committed():
            self.abort(messages)
            raise ValueError("a tokenizer is one document: it can be overwritten, not added to")
        merges = [m[1:] for m in sorted(m for p in parts for m in json.loads(self.folder.read(p.name)))]
        specials = self.note()["special_tokens"]
        tokens = [s.encode().hex() for s in specials] + [f"{b:02x}" for b in range(256)] + [left + right for left, right in merges]
        body = json.dumps({"vocab": {str(i): t for i, t in enumerate(tokens)}, "merges": merges, "special_tokens": specials})
        whole = self.task_file(body.encode(), 1)
        super().commit([whole])
        self.abort(parts)


class TokenizerReader(Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        for rank, (left, right) in enumerate(json.loads(self.folder.read(part.name))["merges"]):
            yield rank, left, right


class TokenizerFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusmill_tokenizer"

    def schema(self) -> str:
        return "rank int, l string, r string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TokenizerReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TokenizerWriter(self.options, overwrite)


# --- a log

#: Columns of a log, and how they are written.
PRECISION = {"step": "{:d}", "total_steps": "{:d}", "loss": "{:.6f}", "train_ppl": "{:.4f}", "val_ppl": "{:.4f}", "lr": "{:.6e}"}


class LogWriter(Committer, DataSourceWriter):
    kind = "csv"

    def write(self, rows: Iterator[Row]) -> Written:
        out, n = io.StringIO(), 0
        lines = csv.writer(out)
        for row in rows:
            if not n:
                lines.writerow(row.__fields__)
            lines.writerow(["" if row[k] is None else PRECISION[k].format(row[k]) for k in row.__fields__])
            n += 1
        return self.task_file(out.getvalue().encode(), n) if n else Written("", 0)


class LogReader(Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        for row in csv.DictReader(io.StringIO(self.folder.read(part.name).decode())):
            yield tuple((int if kind == "{:d}" else float)(row[k]) if row.get(k) else None for k, kind in PRECISION.items())


class Log(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusmill_log"

    def schema(self) -> str:
        return "step int, total_steps int, loss double, train_ppl double, val_ppl double, lr double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        unknown = [f.name for f in schema if f.name not in PRECISION]
        if unknown:
            raise ValueError(f"a log has no columns {unknown}")
        return LogWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (Tokens, TokenizerFile, Log):
        spark.dataSource.register(source)
