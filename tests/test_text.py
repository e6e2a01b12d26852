import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T

CASES = [
    "", " ", "  a", "a  b", "don't WE'LL 'tis", "x  \n y", "日本 語", "é̂ñ", "1२३ ４", "a b", "a  b", "a\u0085\u0085b", "a  b", "tab\tx  ", "😀😀 ok!?", "\x00\x1c a",
]


def pieces(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.p for r in df.select("i", T.pretokens(F.col("t")).alias("p")).orderBy("i").collect()]


def test_pretokens_match_the_pattern(spark):
    assert pieces(spark, CASES) == [regex.findall(T.PRETOKEN, t) for t in CASES]


def test_pretokens_of_null(spark):
    assert pieces(spark, [None]) == [[]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \n\t'slé  !", max_size=20), min_size=1, max_size=20))
def test_pretokens_are_lossless(spark, texts):
    assert ["".join(p) for p in pieces(spark, texts)] == texts


def test_bytes_and_pairs(spark):
    df = spark.createDataFrame([("aé",), ("",), ("x",)], "t string")
    rows = df.select(T.byte_hex(F.col("t")).alias("b"), T.byte_ids(F.col("t")).alias("i"), T.pairs(T.byte_hex(F.col("t"))).alias("p")).collect()
    assert [r.b for r in rows] == [["61", "c3", "a9"], [], ["78"]]
    assert [r.i for r in rows] == [[0x61, 0xC3, 0xA9], [], [0x78]]
    assert [[tuple(p) for p in r.p] for r in rows] == [[("61", "c3"), ("c3", "a9")], [], []]


def brute_merge(tokens, left, right):
    out, k = [], 0
    while k < len(tokens):
        if tokens[k : k + 2] == [left, right]:
            out.append(left + right)
            k += 2
        else:
            out.append(tokens[k])
            k += 1
    return out


def test_merges_go_left_to_right(spark):
    cases = [(["61"] * n, "61", "61") for n in range(6)] + [(["61", "62"] * 2, "61", "62"), (["61", "6161", "61"], "61", "61"), (["6161", "61"], "61", "61")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t array<string>, l string, r string")
    got = df.select("i", T.unspelled(T.merge_pair(T.spelled(F.col("t")), F.col("l"), F.col("r"))).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [brute_merge(*c) for c in cases]


def test_special_tokens(spark):
    df = spark.createDataFrame([("<a>x<ab><a>",), ("",), ("no",), ("<a><a>",), ("a\nb<a>",)], "t string")
    assert [r.p for r in df.select(T.split_specials(F.col("t"), ["<a>", "<ab>"]).alias("p")).collect()] == [["<a>", "x", "<ab>", "<a>"], [], ["no"], ["<a>", "<a>"], ["a\nb", "<a>"]]
    overlap = spark.createDataFrame([("abc",)], "t string")
    assert overlap.select(T.split_specials(F.col("t"), ["ab", "abc"]).alias("p")).first().p == ["ab", "c"]
    assert overlap.select(T.split_specials(F.col("t"), ["abc", "ab"]).alias("p")).first().p == ["abc"]
    assert overlap.select(T.split_specials(F.col("t"), []).alias("p")).first().p == ["abc"]


def test_decoding_replaces_bad_bytes(spark):
    raw = [b"\xff", b"a\xc3", b"\xe2\x82", b"\x80x", "é".encode(), b""]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    assert [r.t for r in df.select(T.decoded(F.col("b")).alias("t")).collect()] == [b.decode("utf-8", "replace") for b in raw]
