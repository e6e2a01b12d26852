import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pii, queries

CARD = "4111 1111 1111 1111"


def brute_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_base(text):
    """The base by its patterns as they stand."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and brute_luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return found


def spans(text, base=None):
    return [(pii.KINDS[x.kind], x.start, x.end) for x in pii.find(text) if base is None or x.base == base]


def check_base(text):
    assert spans(text, True) == brute_base(text), repr(text)
    assert all(0 <= x.start < x.end <= len(text) for x in pii.find(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@", "@", ".", "-", "1", "12", "255", "256", "+1", "+", " ", "(", ")", "4111", "1111", "é", "_", "%", "0", "com", "１", "\n", " at ", " dot ", "[at]", "one", "l", "O"]), max_size=40).map("".join))
def test_base_equals_the_patterns(text):
    check_base(text)


def test_base_of_numbers_near_the_limits():
    r = random.Random(4)
    for _ in range(3000):
        digits = "".join(r.choice("0123456789") for _ in range(r.randrange(14, 22)))
        check_base("".join(d + r.choice(["", "", " ", "-", "  "]) for d in digits) + r.choice(["", ".", "x", " 5"]))
        check_base(".".join(str(r.randrange(300)) for _ in range(r.randrange(3, 10))) + r.choice(["", ".", "..1"]))
        check_base("+" + "".join(r.choice("0123456789 ().-") for _ in range(r.randrange(20))) + "x")


@pytest.mark.parametrize(
    "kind, hidden, value",
    [
        ("email", "john.doe [at] example [dot] com", "john.doe@example.com"),
        ("email", "john(at)example(dot)com", "john@example.com"),
        ("email", "john {AT} example {DOT} co {dot} uk", "john@example.co.uk"),
        ("email", "john dot doe at example dot com", "john.doe@example.com"),
        ("email", "john_at_example_dot_com", "john@example.com"),
        ("email", "john AT example.com", "john@example.com"),
        ("email", "john @ example . com", "john@example.com"),
        ("email", "john@example[.]com", "john@example.com"),
        ("email", "juan arroba ejemplo punto es", "juan@ejemplo.es"),
        ("email", "john *at* example *dot* com", "john@example.com"),
        ("email", "john -at- example -dot- com", "john@example.com"),
        ("email", "john_doe (ät) example (punkt) de", "john_doe@example.de"),
        ("email", "john&#64;example&#46;com", "john@example.com"),
        ("email", "john%40example.com", "john@example.com"),
        ("email", "johnⓐexample.com", "john@example.com"),
        ("email", "john underscore doe at example dash mail dot com", "john_doe@example-mail.com"),
        ("email", "jоhn@exаmple.com", "john@example.com"),
        ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
        ("email", "j​ohn@exam­ple.com", "john@example.com"),
        ("email", "𝐣𝐨𝐡𝐧@example.com", "john@example.com"),
        ("email", "jоhn [at] exаmple [dot] com", "john@example.com"),
        ("ip", "192[.]168[.]1[.]77", "192.168.1.77"),
        ("ip", "192 dot 168 dot 1 dot 77", "192.168.1.77"),
        ("ip", "one nine two dot one six eight dot one dot seven seven", "192.168.1.77"),
        ("ip", "l92.168.O.77", "192.168.0.77"),
        ("ip", "１９２．１６８．１．７７", "192.168.1.77"),
        ("card", "four one one one " + "one one one one " * 2 + "one one one one", "4111111111111111"),
        ("card", "four-one-one-one, " + "one-one-one-one, " * 2 + "one-one-one-one", "4111111111111111"),
        ("card", "4lll 1111 1111 1111", CARD),
        ("card", "4S39 S7B9 OOOO 9991", "4539 5789 0000 9991"),
        ("card", "4111–1111–1111–1111", CARD.replace(" ", "-")),
        ("card", "٤١١١ ١١١١ ١١١١ ١١١١", CARD),
        ("phone", "plus four four seven seven zero zero nine zero zero one two three", "+447700900123"),
        ("phone", "+44 77OO 9OO l23", "+44 7700 900 123"),
        ("phone", "plus one, five five five, oh one two, three four five six", "+15550123456"),
        ("phone", "plus eins zwei drei vier fünf sechs sieben acht neun", "+123456789"),
        ("phone", "+1 double five five oh one double two", "+15550122"),
    ],
)
@pytest.mark.parametrize("before, after", [("", ""), ("Call me: ", ", please."), ("Ünd é\n(", ")")])
def test_disguises_are_mapped_back(kind, hidden, value, before, after):
    text = before + hidden + after
    found = [x for x in pii.find(text) if pii.KINDS[x.kind] == kind and not x.base]
    assert (len(before), len(before) + len(hidden), value) in [(x.start, x.end, x.value) for x in found], pii.find(text)


@pytest.mark.parametrize(
    "text",
    [
        "Meet me at home. Look at example.com, or at noon.",
        "The dot at the end. A point at issue, at last.",
        "One, two, three, four, five, six, seven, eight, nine.",
        "I ate one at nine and two at ten.",
        "In 2010 I saw 5 l of oil at 10 O clock.",
        "Привет, мир. Это текст о том, как жить.",
        "x² + y² = 1, ½, № 5, 10–12, «deux points»",
        "un deux trois nous irons au bois quatre cinq six",
        "The end | 10 | 20 | 30 | I.",
        "version 1.2.3 of (a) and [b]; f(at) = 3.",
    ],
)
def test_clean_texts_stay_clean(text):
    assert spans(text) == brute_base(text) == []


@pytest.mark.parametrize("after", [" I am", " Il est", " | x", " O, no", " l'eau", " un six", " one"])
def test_words_behind_a_number_are_no_part_of_it(after):
    text = "+1 (599) 555-3756" + after
    assert spans(text) == brute_base(text) == [("phone", 0, 17)]


def test_base_spans_stay_beside_added_ones():
    text = "jоhn@example.com and ann@example.com, 10.0.0.1"
    assert spans(text) == [("email", 0, 16), ("email", 2, 16), ("email", 21, 36), ("ip", 38, 46)]
    assert spans(text, False) == [("email", 0, 16)]


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, " " * 1_000_000, "[" * 1_000_000, "a@" * 500_000, "one " * 250_000, "l" * 1_000_000, " at a dot" * 100_000, "+1" * 500_000, "о" * 1_000_000, "a." * 500_000 + "@"):
        pii.find(text)
    assert time.time() - began < 60


def test_redaction_keeps_other_columns(spark):
    rows = [(1, "Mail jоhn [at] example.com or +1 555 012 3456!", "a"), (2, None, "b"), (3, "", "c"), (4, "nothing", None)]
    got = {r[0]: (r[1], r[2]) for r in pii.redact(spark.createDataFrame(rows, "id long, text string, Text2 string")).collect()}
    assert got == {1: ("Mail [EMAIL] or [PHONE]!", "a"), 2: (None, "b"), 3: ("", "c"), 4: ("nothing", None)}


def test_documents(spark):
    texts = ["", None, "a@b.c", "a@b.c", "john [at] b [dot] c", "x" * 100_000 + " 10.0.0.1", CARD + " 😀 +44 7700 900123"]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "q@r.s", "z"), (2, "a@b.c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    out = pii.digests(pii.find_personal_data(docs)).collect()
    want = []
    for d, t, _ in rows:
        base = brute_base(t or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        every = ",".join(f"{k}:{s}:{e}" for k, s, e in spans(t or ""))
        want.append((str(d), *(sum(k == x for k, *_ in base) for x in pii.KINDS), hashlib.sha256(said.encode()).hexdigest(), every))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in out) == sorted(want)
    assert sum(r.n_added for r in out) == 1
    assert pii.find_personal_data(docs.where("false")).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: (r.base_sha256, r.spans) for r in queries.op11_personal_data(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for d in docs:
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(d.text or ""))
        assert got[d.doc_id] == (hashlib.sha256(said.encode()).hexdigest(), said)
