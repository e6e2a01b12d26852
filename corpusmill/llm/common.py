"""What the operators of this subpackage share: the shared folder, written tables, Arrow row streams."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize, new_dir, shared_dir, temporary  # noqa: F401  for the operators


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, no copies: `rows` rows and about `size` bytes of the column at most, one row at least.

    Spark bounds an Arrow batch by the session's rows and by bytes (64 MiB), and a row is never cut; what an operator makes of
    a batch is many times larger, so it works on parts. No setting of the session is changed.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    begin = held = 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= rows or held + n > size):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield batch.slice(begin)


_forgets: dict[str, Callable[[], None]] = {}


def only(owner: str, forget: Callable[[], None]) -> None:
    """Called where a task begins: what other operators remember in this worker process is dropped (by the `forget` that each gave).

    Spark keeps worker processes from stage to stage; so one holds the memory of one operator, however many ran before.
    """
    others = [name for name in _forgets if name != owner]
    for name in others:
        _forgets.pop(name)()
    _forgets[owner] = forget
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
        if trim:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of `df`, under new names; others (and clashing names among them) are left behind.

    A name that occurs twice, or in another case, resolves to the exact spelling, and then to its first occurrence.
    """
    names = df.columns
    picked = [(place(names, old), new) for new, old in columns.items()]
    unique = df.toDF(*[f"c{i}_" for i in range(len(names))])
    return unique.selectExpr(*[f"c{i}_ AS `{new}`" for i, new in picked])


def place(names: list[str], name: str) -> int:
    """Where a column is among names that may clash: by exact spelling first, then in any case; the first of several."""
    exact = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if not exact:
        raise ValueError(f"column {name!r} is missing; there are {names}")
    return exact[0]


def kept_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """`docs`, all columns as they are, with the rows of which a text is kept: one pass, nothing is shuffled.

    `judge()` is called once a task and gives the function that judges a part's texts.
    """
    names = docs.columns
    at = place(names, text_col)
    plain = docs.toDF(*[f"c{i}_" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def join_hot(rows: DataFrame, by_key: DataFrame, key: str | list[str], share: int = 1024) -> DataFrame:
    """`rows` joined with `by_key`, which has each key once and says how many rows `n` have it.

    Keys of over one row in `share` are `share` at most; their part of `by_key` is broadcast, so that no task gets a key's rows.
    """
    total = by_key.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share > total
    by_key = by_key.withColumn("n", F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    few = F.broadcast(by_key.where(hot).drop("n"))
    names = [key] if isinstance(key, str) else key
    return rows.join(few, names).unionByName(rows.join(few.select(*names), names, "left_anti").join(by_key.where(~hot).drop("n"), names))


def often(rows: DataFrame, keys: list[str], share: int = 1024) -> DataFrame | None:
    """The values of `keys` (none of them null) that over one row in `share`, and more than one, has; `share` values at most, written. None: no such value.

    The first key is counted alone, for which a scan reads nothing else; the others only where the first repeats so often.
    """
    total = rows.count()

    def repeated(some: DataFrame, by: list[str]) -> DataFrame:
        return some.groupBy(*by).agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * share > total)).select(*by)

    first = repeated(rows, keys[:1])
    if first.isEmpty():
        return None
    found = materialize(repeated(rows.join(F.broadcast(first), keys[:1], "left_semi"), keys), "often")
    return None if found.isEmpty() else found


def left_join_often(rows: DataFrame, by_key: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """`rows` with what `by_key`, which has a value of `keys` once, says of them (or null). Values that `often` found meet
    theirs by broadcast, so that no task gets all rows of one."""
    if hot is None:
        return rows.join(by_key, keys, "left")
    few = F.broadcast(hot)
    near = rows.join(few, keys, "left_semi").join(F.broadcast(by_key.join(few, keys, "left_semi")), keys, "left")
    return near.unionByName(rows.join(few, keys, "left_anti").join(by_key, keys, "left"))


def batch_of(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def open_fs(uri: str):
    """pyarrow filesystem and path of a URI or plain path (file, hdfs, s3, gs as pyarrow provides them)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_atomically(uri: str, write) -> int:
    """`write(stream)` into a temporary name beside `uri`, then rename: a lost or repeated task leaves no half file."""
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary, compression=None) as stream:
        write(stream)
        size = stream.tell()
    filesystem.move(temporary, path)
    return size
