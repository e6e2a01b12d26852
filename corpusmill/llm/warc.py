"""WARC files whose records are compressed one by one with a Zstandard dictionary made from them.

File layout (the public "WARC with Zstandard" format): a skippable frame that holds the dictionary (zstd inside), then
one frame for each record, so any record can be read alone. The dictionary is trained on the file's first records up to
`sample_bytes` (a bound, for compression only: all records are archived whole).

A payload is the page's html in UTF-8. Of the pages with equal payloads of at least `least_bytes` (by SHA-1 and length), the
one with the largest page_id is a `response`; the others are `revisit` records, without the payload, that refer to it.

Defined results: null html is the empty payload; null page_id is smaller than any other; rows that repeat the largest
page_id of their payload are all responses; null url is archived as urn:page:ID; an empty table makes no file and an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, left_join_often, materialize, new_dir, often, open_fs, own_columns, partitions, temporary, write_atomically

SKIPPABLE_DICTIONARY = 0x184D2A5D  # fixed value of the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of WARC 1.1


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; `html` is left out of a revisit, but its length and digest are kept."""
    name = "null" if page_id is None else page_id
    url = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:page:{name}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"version": lines[0], "http": {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes, or b"" where there is too little to learn from."""
    total = sum(map(len, samples))
    size = min(size, total // 10)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class WarcWriter:
    """Holds records back until the dictionary's sample is full or the file ends."""

    def __init__(self, stream, *, sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 6):
        self.stream, self.sample_bytes, self.dictionary_bytes, self.level = stream, sample_bytes, dictionary_bytes, level
        self.sample: list[bytes] | None = []
        self.held = self.records = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.sample is None:
            self.stream.write(self.compress(raw))
            return
        self.sample.append(raw)
        self.held += len(raw)
        if self.held >= self.sample_bytes:
            self._begin()

    def _begin(self) -> None:
        held, self.sample = self.sample, None
        pieces = [x[i : i + 8192] for x in held for i in range(0, len(x), 8192)]
        trained = train_dictionary(pieces, self.dictionary_bytes)
        options = {"level": self.level, "write_checksum": True}
        if trained:
            body = zstandard.ZstdCompressor(level=19).compress(trained)
            self.stream.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(body)) + body)
            made = zstandard.ZstdCompressionDict(trained)
            made.precompute_compress(level=self.level)
            options = {"write_checksum": True, "dict_data": made}
        self.compress = zstandard.ZstdCompressor(**options).compress
        for raw in held:
            self.stream.write(self.compress(raw))

    def close(self) -> None:
        if self.sample is not None:
            self._begin()


def read_records(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The plain records of a file, one after another; memory holds a block and a record."""
    head = stream.read(8)
    trained = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE_DICTIONARY:
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(struct.unpack("<I", head[4:])[0])))
        head = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    data, of, out = head + stream.read(block), None, []
    while data:
        of = of or decompressor.decompressobj()
        out.append(of.decompress(data))
        if of.eof:
            data, of = of.unused_data, None
            yield b"".join(out)
            out = []
        else:
            data = b""
        data = data or stream.read(block)
    if of is not None:
        raise EOFError("the last record is cut off")


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def decide(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, digest, keeper of the pages that are to be revisits of the response `keeper`.

    Rows that repeat a page are one from the first step on. Digests are grouped with partial sums, and only those of several pages
    are joined back; both sides are some dozens of bytes a page, and a digest that very many pages share is dealt over `salts` keys.
    """
    salts = 16
    known = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("size")).where(F.col("size") >= least_bytes).distinct()
    shared = known.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1").drop("n")
    salted = shared.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(salted, ["digest", "size", "salt"]).where("page_id IS DISTINCT FROM keeper").select("page_id", "digest", "size", "keeper")


def write_warc(pages: DataFrame, out_dir: str, *, least_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Archive `pages` in files below `out_dir`; returns the manifest: path, records, bytes.

    Each html is shuffled at most once, by page_id, to meet its page's decision; pages that very many rows repeat (no id, one payload)
    meet theirs where they are. A repeated task writes the same name anew.
    """
    own = own_columns(pages, page_id=id_col, url=url_col, html=html_col).selectExpr("CAST(page_id AS BIGINT) page_id", "url", "html")
    page = F.coalesce("page_id", F.lit(-(2**63)).cast("long")).alias("page")
    no_id = F.col("page_id").isNull().alias("no_id")
    revisits = decide(own, least_bytes).select(page, no_id, "digest", "size", "keeper", F.lit(True).alias("revisit"))
    digest, size = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size")
    keys = ["page", "no_id", "digest", "size"]
    keyed = own.select("page_id", "url", "html", page, no_id, digest, size)
    joined = left_join_often(keyed, revisits, keys, often(keyed, keys))
    rows = joined.select("page_id", "url", "html", "digest", "keeper", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, said = f"{out_dir}/pages-{TaskContext.get().partitionId():08d}.warc.zst", {}

        def fill(stream):
            writer, batch = WarcWriter(stream, **options), first
            while batch is not None:
                for page_id, url, html, digest, keeper, revisit in zip(*batch.columns):
                    writer.add(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), keeper.as_py(), revisit.as_py(), date))
                batch = next(batches, None)
            writer.close()
            said["records"] = writer.records

        size = write_atomically(name, fill)
        yield batch_of({"path": [name], "records": [said["records"]], "bytes": [size]}, MANIFEST)

    # Each task of the join writes a file, in page_id order, so that a repeated task writes the same records in the same order.
    dealt = rows.sortWithinPartitions(F.col("page_id").asc_nulls_first(), "url", "digest")
    return materialize(dealt.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the manifest's files.

    A response's length and digest are taken from the payload that was read, and must equal the digest in its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                filesystem, path = open_fs(name)
                with filesystem.open_input_stream(path, compression=None) as stream:
                    rows: list[tuple] = []
                    for raw in read_records(stream):
                        rows.append(_row(parse(raw)))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    files = manifest.select("path").repartition(max(1, partitions(manifest.sparkSession)))
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _row(r: dict) -> tuple:
    digest, size = r["warc-payload-digest"].removeprefix("sha1:"), int(r["http"]["content-length"])
    if r["warc-type"] == "response":
        if (digest, size) != (hashlib.sha1(r["payload"]).hexdigest(), len(r["payload"])):
            raise ValueError(f"{r['warc-record-id']}: the payload isn't what its header says")
    return _id(r["warc-record-id"]), size, digest, r["warc-type"], _id(r.get("warc-refers-to"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(dict(zip(PAGES.names, map(list, zip(*rows)))), PAGES)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Archive `pages` in the shared folder, where the files stay until the application ends, and read every record back."""
    return read_warc(write_warc(pages, temporary(pages.sparkSession, new_dir(pages.sparkSession, "warc")), **options))
