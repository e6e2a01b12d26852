import hashlib
import io
import random
import struct

import zstandard
from pyspark.sql import functions as F

from corpusmill.llm import warc


def test_records_round_trip():
    out = io.BytesIO()
    writer = warc.WarcWriter(out, sample_bytes=20_000)
    r = random.Random(1)
    pages = [("<html><body>" + " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(1, 400)))).encode() for _ in range(80)] + [b"", b"\r\n\r\n", b"x" * 200_000]
    for i, p in enumerate(pages):
        writer.add(warc.record(i, f"http://a/é {i}\n", p, hashlib.sha1(p).hexdigest(), None, False, "2020-01-01T00:00:00Z"))
    writer.close()
    raw = out.getvalue()
    assert struct.unpack("<I", raw[:4])[0] == warc.SKIPPABLE_DICTIONARY
    parsed = [warc.parse(x) for x in warc.read_records(io.BytesIO(raw), block=777)]
    assert [p["payload"] for p in parsed] == pages
    assert parsed[1]["version"] == "WARC/1.1" and parsed[1]["warc-target-uri"] == "http://a/%C3%A9%201%0A"
    # Any record can be read alone, with the dictionary of the first frame.
    size = struct.unpack("<I", raw[4:8])[0]
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
    assert warc.parse(one.decompress(raw[8 + size :]))["payload"] == pages[0]


def test_few_records_need_no_dictionary():
    out = io.BytesIO()
    writer = warc.WarcWriter(out)
    writer.add(warc.record(1, None, b"a", "d", None, False, "x"))
    writer.close()
    assert [warc.parse(x)["warc-target-uri"] for x in warc.read_records(io.BytesIO(out.getvalue()))] == ["urn:page:1"]


def test_pages(spark):
    big, other = "<p>" + "word " * 300, "<b>" + "é" * 600
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (9, "u", "x" * 1000), (10, "u", "x" * 999), (11, "u", "x" * 999), (5, "u", big)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = {}
    for r in warc.archive(pages).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    of = lambda html, kind, to=None: (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest(), kind, to)
    assert got == {
        1: [of(big, "revisit", 5)], 3: [of(big, "revisit", 5)], 5: [of(big, "response")] * 2, 2: [of("small", "response")], 4: [of("small", "response")], 6: [of(None, "response")], 7: [of("", "response")],
        8: [of(other, "response")], None: [of(other, "revisit", 8)], 9: [of("x" * 1000, "response")], 10: [of("x" * 999, "response")], 11: [of("x" * 999, "response")],
    }
    assert warc.archive(pages.where("false")).count() == 0


def test_one_page_in_very_many_rows(spark):
    """A third of all rows without an id and with one payload; as many repeat one id."""
    n, big = 6000, "<p>" + "word " * 300
    page = F.when(F.col("id") % 3 == 1, F.lit(7)).when(F.col("id") % 3 == 2, F.col("id"))
    html = F.when(F.col("id") % 3 == 2, F.concat(F.lit(big), "id")).otherwise(F.lit(big))
    pages = spark.range(n).select(page.alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    got = {tuple(r) for r in warc.archive(pages).groupBy(F.col("page_id").isNull(), "record_type", "refers_to").count().collect()}
    assert got == {(True, "revisit", 7, n // 3), (False, "response", None, 2 * n // 3)}
