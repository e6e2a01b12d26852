import io
import struct
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from corpusmill.llm import tokenbin

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The CAT's hat.", "", "x" * 3000, "é ñ ΑΣ İ!  ..,", "<|endoftext|> a", "don't stop!?\nnow", "á ́b", " ", "½ ② 10", "\x85a b　c"]


@pytest.fixture(scope="module")
def library():
    """The library's tokenizer as it is read, nothing set."""
    return Tokenizer.from_file(PATH)


def letters_that_change():
    """Letters whose normal form isn't all letters."""
    every = map(chr, [*range(0xD800), *range(0xE000, 0x110000)])
    return [c for c in every if c.isalpha() and not unicodedata.normalize("NFC", c).isalpha()]


def test_encoding_by_words_equals_the_library(library):
    import random

    r = random.Random(3)
    pool = ["a", "The", "ing", "é", "é", "́", "\n", " ", "  ", "1", "!", ".", ",", " ", "　", "'S", "'ll", "Σ", "İ", "ß", "\t", "\x1c", "ǅ", "..."]
    odd = letters_that_change()
    assert len(odd) > 50
    pool += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", *r.sample(odd, 6)]
    texts = TEXTS + ["".join(r.choice(pool) for _ in range(r.randrange(25))) for _ in range(3000)]
    texts += [f"{a}{c}{b}" for c in odd for a in ("", "a", " ") for b in ("", "a", ".", ". b", ", ")]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>.", "A <|EndOfText|> b, c."]
    assert tokenbin.separable(PATH)
    for text, packed in zip(texts, tokenbin.encode_packed(texts, PATH, 1, 2)):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [1], repr(text)


HISTORY = ["He met (Maria) and (Eva).", "(Maria), Łucja", 'She said "Yes" and "No".', '"Yes", she said, and didn’t go', "(A). Ł", "A) b", "x), y). Ω", "“Oui”, dit-il.", "“Oui”. Non", "it's (it's), Ł", "é), É), ñ!. Ł", "!? ., ?!"]


@pytest.mark.parametrize("order", range(6))
def test_ids_do_not_depend_on_what_came_before(library, order):
    import random

    r = random.Random(order)
    words = ["Maria", "yes", "(Eva", "no)", '"Hm"', "Ł", "Ω", "é", "İ", "'s", "1", "..", ",,", "a.b", "“q”"]
    texts = HISTORY + [" ".join(r.choice(words) + r.choice(["", "", ".", ",", ")", "),", "!."]) for _ in range(r.randrange(1, 9))) for _ in range(400)]
    r.shuffle(texts)
    tokenbin._words.cache_clear()
    for text in texts:  # a call each
        (packed,) = tokenbin.encode_packed([text], PATH, 1, 2)
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [1], repr(text)


def test_files_have_the_same_bytes_in_any_order(spark):
    rows = [(i, t) for i, t in enumerate(HISTORY * 3)]
    read = lambda m: [open(r.path.removeprefix("file://"), "rb").read() for r in m.orderBy("shard").collect()]
    made = []
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(2)
        made.append(read(tokenbin.write_token_files(docs, PATH, tokenbin.new_dir(spark, "tokens"), shards=3)))
    assert made[0] == made[1]


def test_long_texts_go_in_pieces(library, monkeypatch):
    monkeypatch.setattr(tokenbin, "PIECE_CHARS", 50)
    monkeypatch.setattr(tokenbin, "PIECES_CHARS", 120)
    texts = ["word, " * 100 + "end.", "x" * 300, "a b\nc " * 40 + "y" * 200 + " z", "", "one. " * 30 + "<|endoftext|> two"]
    for text, packed in zip(texts, tokenbin.encode_packed(texts, PATH, 1, 2)):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [1]


def test_one_id_may_fill_several_shards(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, "none")] * 200 + [(i, "x") for i in range(100, 200)] + [(-5, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = tokenbin.write_token_files(docs, PATH, tokenbin.new_dir(spark, "tokens"), shards=8)
    assert max(r.docs for r in manifest.collect()) < 300
    got = sorted(tokenbin.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("frame_bytes", [1, 64, 1 << 20])
def test_file_round_trip(frame_bytes):
    docs = [(None, [7]), (-3, []), (5, list(range(100))), (5, [1]), (9, [65_535] * 10)]
    out = io.BytesIO()
    writer = tokenbin.TokenFileWriter(out, id_bytes=2, frame_bytes=frame_bytes)
    for d, ids in docs:
        writer.add(d, np.array(ids, "<u2").tobytes())
    writer.close()
    raw = out.getvalue()
    reader = tokenbin.TokenFileReader(io.BytesIO(raw))
    assert len(reader) == 5 and [reader.ids(i).tolist() for i in (4, 0, 2, 1, 3)] == [docs[i][1] for i in (4, 0, 2, 1, 3)]
    assert [reader.find(d) for d in (-3, 5, 9, 8)] == [1, 2, 4, -1]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(np.array(x, "<u2").tobytes() for _, x in docs)
    assert struct.unpack("<I", raw[-4:])[0] == tokenbin.SEEKABLE_FOOTER


def test_only_the_wanted_frame_is_read_and_damage_is_found():
    out = io.BytesIO()
    writer = tokenbin.TokenFileWriter(out, id_bytes=4, frame_bytes=1)
    for d in range(50):
        writer.add(d, np.array([d] * 50, "<u4").tobytes())
    writer.close()
    raw = bytearray(out.getvalue())
    reader = tokenbin.TokenFileReader(io.BytesIO(raw))
    broken = bytearray(raw)
    broken[reader.offsets[7] + 9] ^= 255
    other = tokenbin.TokenFileReader(io.BytesIO(broken))
    assert other.ids(8).tolist() == [8] * 50
    with pytest.raises((tokenbin.CorruptFrame, zstandard.ZstdError)):
        other.ids(7)
    with pytest.raises(tokenbin.CorruptFrame):
        tokenbin.TokenFileReader(io.BytesIO(bytes(raw[:-1]) + b"x"))


def test_documents(spark, library):
    rows = [(30 - i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (31, None, "z"), (4, "again", "q"), (4, "again", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = tokenbin.token_files(docs, PATH, end_id=1, shards=3, frame_bytes=100).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    crc = lambda t: zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(d), crc(t)) for d, t, _ in rows)
    assert tokenbin.token_files(docs.where("false"), PATH, end_id=1).count() == 0


def test_points_and_commas_behind_words_need_no_encoding_of_their_own(library, monkeypatch):
    """One word with many tails, and capitals, goes through the library once for each spelling; ids stay the library's."""
    stems = ["Heron", "heron", "ÉTÉ", "Straße", "millrace"]
    words = [s + t for s in stems for t in ("", ".", ",", "..", ".,", ",,.")] + ["it's.", "1.5,", "a.b.", ".", ",.", "é.", "é.", "ǅ.", "İ,", "ΣΑΣ.", "<|endoftext|>.", "x<|endoftext|>,"]
    tokenbin._words.cache_clear()
    new, tailed = tokenbin._unknown([words], {}, PATH)
    assert len(tailed) == 5 * len(stems) + 1 and {*stems, "é", ".", ",", "..", ".,", ",,."} <= new
    for some in (words, words[::-1], [" ".join(words)]):
        got = tokenbin.encode_packed(some, PATH, None, 4)
        assert [list(memoryview(x).cast("I")) if x else [] for x in got] == [library.encode(w, add_special_tokens=False).ids for w in some]
