"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling; DataFrame functions only.

The corpus is one sequence of lines for each document. A repeated run is a row of consecutive lines of a document whose
lines also stand, in the same order, somewhere else. A line goes if it lies in a repeated run of at least `min_words` words
(a line counts one word at least) of which an equal copy begins earlier, by doc_id and then by line.

How:
  * Lines of one position are discarded. What is left are islands, rows of consecutive repeated lines, of enough words; a
    suffix is the lines from a position to the end of its island, and ends there with a sign that is smaller than any line.
  * Prefix doubling sorts the suffixes: a rank is the place in the suffix array of the first suffix with the same 2^k lines;
    level k + 1 orders the suffixes of one rank by their ranks 2^k lines on. Suffixes that are alone with their rank, and
    those that have ended, are sorted and take no part in further levels. Ranks are sums over classes of equal suffixes, dealt
    over ranges, so no task orders the corpus. With w words needed there are 1 + log2(w) levels at most, whatever the input.
  * Neighbours in the suffix array are compared for their longest common prefix. Suffixes of a run of m lines are an interval in
    which no common prefix is shorter than m; the run's copies are the interval's positions, and the first of them stays.
  * A maximal repeated run of enough words is the union of the shortest such runs that begin, or that end, at its lines, so
    only intervals of these lengths (of `min_words` lines at most) are asked for. They depend on the lines alone, hence on the
    class of equal suffixes; positions meet their class once, at the end.

Defined results: null text has no lines and stays null; empty text has one empty line; null doc_id is smaller than any
other; rows that repeat both doc_id and text are one document, and get the same result each; rows that repeat a doc_id
alone are ordered by a hash of their texts; an empty table gives an empty table; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, left_join_often, materialize, often, place

DOC = ["d", "h"]
SALTS = 16
RANGES, RANGES_BEHIND = 4096, 256  # of the order of lines; of the ranks behind one rank
SPAN = 65_536  # places of the suffix array that one task walks


def _lines(own: DataFrame) -> DataFrame:
    """d, h, p, line (MD5), w: every line of every document."""
    lines = own.select("d", "h", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("d", "h", "p", F.unhex(F.md5("line")).alias("line"), F.greatest(F.lit(1), F.regexp_count("line", F.lit(r"\S+"))).cast("long").alias("w"))


def _before(classes: DataFrame, within: list[str], bucket: Column, order: str) -> DataFrame:
    """`classes` with `before_`: how many positions (n) the classes of `within` hold whose `order` is smaller.

    In two steps, so that no task gets all classes: sums of RANGES buckets, which keep the order, then a window in each bucket.
    """
    dealt = classes.withColumn("b_", bucket)
    sums = dealt.groupBy(*within, "b_").agg(F.sum("n").alias("s_"))
    earlier = Window.partitionBy(*within).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    starts = sums.select(*within, "b_", F.coalesce(F.sum("s_").over(earlier), F.lit(0)).alias("o_"))
    inside = Window.partitionBy(*within, "b_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("i_", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counted.join(starts, [*within, "b_"]).withColumn("before_", F.col("o_") + F.col("i_")).drop("b_", "o_", "i_")


def _met(positions: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Positions and their class; each class is dealt to SALTS keys, so that a very common line's positions spread over as many tasks."""
    salted = classes.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return positions.withColumn("salt_", F.pmod(F.hash("d", "p"), F.lit(SALTS))).join(salted, [*key, "salt_"]).drop("salt_")


def _repeated(lines: DataFrame) -> DataFrame:
    """d, h, p, w, r: the positions of lines that have several, ranked by their lines."""
    classes = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    two_bytes = F.conv(F.hex(F.substring("line", 1, 2)), 16, 10).cast("int")
    ranked = _before(classes, [], F.floor(two_bytes * RANGES / 65_536).cast("int"), "line")
    # A document's repeated rows have the same positions: they add no class of their own, and are put together here.
    return _met(lines, ranked.select("line", F.col("before_").alias("r")), ["line"]).select(*DOC, "p", "w", "r").repartition(*DOC).dropDuplicates([*DOC, "p"])


def _islands(ranked: DataFrame, min_words: int) -> DataFrame:
    """Positions in rows of consecutive repeated lines with enough words: d, h, p, r, w, i (island), e (words from its begin to the line's end)."""
    doc = Window.partitionBy(*DOC).orderBy("p")
    island = Window.partitionBy(*DOC, "i")
    upto = island.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranked.withColumn("i", F.col("p") - F.row_number().over(doc))
    return placed.withColumn("e", F.sum("w").over(upto)).withColumn("all_", F.sum("w").over(island)).where(F.col("all_") >= min_words).drop("all_")


def _shortest_runs(islands: DataFrame, min_words: int) -> DataFrame:
    """d, h, s, m: the shortest runs with enough words that begin, and those that end, at each position."""
    base = islands.select(*DOC, "i", "p", (F.col("e") - F.col("w")).alias("b"), "e")

    def asked(have: Column, want: Column, nearest, order: list[Column], rows: tuple) -> DataFrame:
        both = base.select(*DOC, "i", have.alias("v"), F.lit(0).alias("q"), "p").unionAll(base.select(*DOC, "i", want.alias("v"), F.lit(1).alias("q"), "p"))
        over = Window.partitionBy(*DOC, "i").orderBy(*order).rowsBetween(*rows)
        return both.withColumn("o", nearest(F.when(F.col("q") == 0, F.col("p")), ignorenulls=True).over(over)).where("q = 1 AND o IS NOT NULL")

    # The first line that ends at or after the words needed from p on; q orders a line's own value before or after the question.
    ends = asked(F.col("e"), F.col("b") + min_words, F.first, [F.col("v"), F.col("q").desc()], (Window.currentRow, Window.unboundedFollowing))
    begins = asked(F.col("b"), F.col("e") - min_words, F.last, [F.col("v"), F.col("q")], (Window.unboundedPreceding, Window.currentRow))
    forward = ends.select(*DOC, F.col("p").alias("s"), (F.col("o") - F.col("p") + 1).alias("m"))
    backward = begins.select(*DOC, F.col("o").alias("s"), (F.col("p") - F.col("o") + 1).alias("m"))
    return forward.unionAll(backward).distinct()


def _doubled(level: DataFrame, k: int, width: int) -> DataFrame:
    """Ranks by 2^(k+1) lines from those by 2^k lines; `width`: ranks in a range."""
    step = 2**k
    on = Window.partitionBy(*DOC, "i").orderBy("p").rangeBetween(step, step)
    pairs = level.withColumn("two", F.when(~F.col("done"), F.coalesce(F.first("r").over(on), F.lit(-1))))
    going = pairs.where("NOT done").withColumnRenamed("r", "one").drop("done")
    classes = going.groupBy("one", "two").agg(F.count("*").alias("n"))
    ranked = _before(classes, ["one"], F.floor((F.col("two") + 1) / width).cast("int"), "two")
    ranked = ranked.select("one", "two", (F.col("one") + F.col("before_")).alias("r"), ((F.col("n") == 1) | (F.col("two") < 0)).alias("done"))
    again = _met(going, ranked, ["one", "two"]).drop("one", "two").withColumn("path", F.concat("path", F.array("r")))
    return pairs.where("done").drop("two").unionByName(again)


def suffix_array(islands: DataFrame, depth: int) -> DataFrame:
    """d, h, p, i, r, path: r orders the suffixes by their first `depth` lines at least and is equal where these are equal; path has
    the ranks by 1, 2, 4 ... lines, up to the one that sorts the suffix."""
    width = islands.agg(F.max("r")).first()[0] // RANGES_BEHIND + 1
    level = materialize(islands.select(*DOC, "p", "i", "r", F.lit(False).alias("done"), F.array("r").alias("path")), "line-ranks")
    k = 0
    while 2**k < depth:
        before, level = level, materialize(_doubled(level, k, width), "line-ranks")
        discard(before)
        k += 1
    return level


def _first_lines(islands: DataFrame, of: DataFrame, depth: int) -> DataFrame:
    """`of` (d, h, p, i and more) with `lines`, the ranks of its next `depth` lines, fewer at an island's end."""
    blocks = islands.withColumn("b", F.floor(F.col("p") / depth)).groupBy(*DOC, "i", "b").agg(F.array_sort(F.collect_list(F.struct("p", "r"))).alias("x"))
    after = Window.partitionBy(*DOC, "i").orderBy("b")
    both = blocks.select(*DOC, "i", "b", F.col("x")[0]["p"].alias("begin"), F.concat("x.r", F.coalesce(F.lead("x.r").over(after), F.array().cast("array<long>"))).alias("two"))
    found = of.withColumn("b", F.floor(F.col("p") / depth)).join(both, [*DOC, "i", "b"])
    return found.withColumn("lines", F.slice("two", F.col("p") - F.col("begin") + 1, depth)).drop("b", "begin", "two")


def common_prefix(a: Column, b: Column) -> Column:
    """How many lines two suffixes share from their begin."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), True)
    return F.when(differ > 0, differ - 1).otherwise(n)


def _copies(islands: DataFrame, array: DataFrame, runs: DataFrame, depth: int) -> DataFrame:
    """r, first (a struct of d, h, p), own, all: how many lines go at the first position of a class and at its others (null: none).

    Each class stands for its suffixes by the first position. The intervals of runs of m lines lie within the suffixes that share
    their first 2^k <= m lines, so the array is walked there.
    """
    classes = array.groupBy("r").agg(F.min(F.struct(*DOC, "p", "i", "path")).alias("first"), F.count("*").alias("n"))
    flat = classes.select("r", "n", "first.*")
    asked = flat.join(runs.select(*DOC, F.col("s").alias("p"), "m"), [*DOC, "p"])
    known = _first_lines(islands, asked, depth).withColumn("share", F.element_at("path", F.least(F.size("path"), F.floor(F.log2("m")).cast("int") + 1)))
    several = _earliest(known.select("m", "share", "r", "n", F.struct(*DOC, "p").alias("first"), "lines")).groupBy("r").agg(
        F.first("first").alias("first"),
        F.max(F.when(F.col("first") != F.col("earliest"), F.col("m"))).alias("own"),
        F.max(F.when(F.col("n") > 1, F.col("m"))).alias("others"),
    )
    return several.select("r", "first", "own", F.greatest("own", "others").alias("all")).where("all IS NOT NULL")


def _earliest(known: DataFrame) -> DataFrame:
    """m, r, n, first and `earliest`: the first position of the interval of m common lines that r lies in.

    The places of one (m, share) are walked in ranges of `SPAN`. An interval is called by the rank that it begins with. In a
    range, the piece before its first new interval (`begin` -1) may go on from the range before; that is decided over one row a
    range, and only pieces at a range's ends meet those of other ranges.
    """
    at = ["m", "share", "g"]
    inside = Window.partitionBy(*at).orderBy("r")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = known.withColumn("g", F.floor(F.col("r") / SPAN)).withColumn("above", F.lag("lines").over(inside)).withColumn("last", F.lead("r").over(inside).isNull())
    new = F.col("above").isNotNull() & (common_prefix(F.col("above"), F.col("lines")) < F.col("m"))
    placed = placed.withColumn("begin", F.coalesce(F.max(F.when(new, F.col("r"))).over(upto), F.lit(-1).cast("long")))
    placed = placed.withColumn("least", F.min("first").over(Window.partitionBy(*at, "begin")))
    # Ranks of one share are its own rank or larger: a range behind that of the share goes on from another one.
    behind = F.col("g") > F.floor(F.col("share") / SPAN)
    head, tail = F.when(F.col("above").isNull() & behind, F.col("lines")), F.when(F.col("last"), F.col("lines"))
    placed = materialize(placed.select(*at, "r", "n", "first", "begin", "least", head.alias("head"), tail.alias("tail")), "line-places")
    groups = placed.where(behind).select("m", "share").distinct()
    ranges = placed.join(groups, ["m", "share"], "left_semi").groupBy(*at).agg(
        F.min("r").alias("low"), F.max("begin").alias("end"), F.first("head", ignorenulls=True).alias("head"), F.first("tail", ignorenulls=True).alias("tail")
    )
    order = Window.partitionBy("m", "share").orderBy("g")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("above", F.lag("tail").over(order))
    ranges = ranges.withColumn("own", F.when(F.col("above").isNull() | (common_prefix(F.col("above"), F.col("head")) < F.col("m")), F.col("low")))
    ranges = ranges.withColumn("open", F.coalesce("own", F.max(F.greatest("end", "own")).over(earlier))).select(*at, "end", "open")
    ends = placed.select(*at, "begin", "least").join(ranges, at).where("begin = -1 OR begin = end").groupBy(*at, "begin", "open").agg(F.first("least").alias("least"))
    whole = Window.partitionBy("m", "share", F.when(F.col("begin") < 0, F.col("open")).otherwise(F.col("begin")))
    ends = ends.withColumn("whole", F.min("least").over(whole)).select(*at, "begin", "whole")
    return placed.join(ends, [*at, "begin"], "left").select("m", "r", "n", "first", F.coalesce("whole", "least").alias("earliest"))


def removed_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """d, h, removed (ascending places of lines that go) of the documents (d, h, text) that lose lines."""
    lines = materialize(_lines(docs), "lines")
    islands = materialize(_islands(_repeated(lines), min_words), "line-islands")
    runs = materialize(_shortest_runs(islands, min_words), "line-runs")
    longest = runs.agg(F.max("m")).first()[0]
    if longest is None:
        return docs.select(*DOC).where("false").withColumn("removed", F.array().cast("array<int>"))
    array = suffix_array(islands, longest)
    copies = materialize(_copies(islands, array, runs, longest), "line-copies")
    length = F.when(F.struct(*DOC, "p") == F.col("first"), F.col("own")).otherwise(F.col("all"))
    later = _met(array.select(*DOC, "p", "r"), copies, ["r"]).withColumn("m", length).where("m IS NOT NULL")
    places = later.select(*DOC, F.explode(F.sequence("p", F.col("p") + F.col("m").cast("int") - 1)).alias("p"))
    return places.groupBy(*DOC).agg(F.array_sort(F.collect_set("p")).alias("removed"))


def _deduplicated(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column, Column, list[Column]]:
    """`docs` with its columns renamed by place and what is to be removed; the new text, lines, removed lines; its columns."""
    names = docs.columns
    at_id, at_text = place(names, id_col), place(names, text_col)
    plain = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    keyed = plain.withColumn("d", F.coalesce(F.col(f"c{at_id}_").cast("long"), F.lit(-(2**63)).cast("long"))).withColumn("text", F.col(f"c{at_text}_")).withColumn("h", F.xxhash64("text"))
    hot = often(keyed, DOC)
    own = keyed.where("text IS NOT NULL").select(*DOC, "text")
    if hot is not None:  # rows that repeat one document very often are one from here on; tasks put theirs together first
        few = F.broadcast(hot)
        own = own.join(few, DOC, "left_anti").unionByName(own.join(few, DOC, "left_semi").groupBy(*DOC).agg(F.first("text").alias("text")))
    joined = left_join_often(keyed, removed_lines(own, min_words), DOC, hot)
    lines, gone = F.split("text", "\n"), F.col("removed")
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(gone, i - 1))  # noqa: E731  the removed line before the i-th
    kept = F.flatten(
        F.concat(
            F.transform(gone, lambda r, i: F.slice(lines, before(i) + 2, r - before(i) - 1)),
            F.array(F.slice(lines, F.element_at(gone, -1) + 2, F.greatest(F.lit(0), F.size(lines) - F.element_at(gone, -1) - 1))),
        )
    )
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")
    return joined, text, n_lines, n_removed, [text if i == at_text else F.col(f"c{i}_") for i in range(len(names))]


def deduplicate_lines(docs: DataFrame, min_words: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its text less the later copies of repeated runs, and n_lines_, n_removed_ (long)."""
    joined, _, n_lines, n_removed, columns = _deduplicated(docs, min_words, id_col, text_col)
    return joined.select(*columns, n_lines, n_removed).toDF(*docs.columns, "n_lines_", "n_removed_")


def drop_repeated_lines(docs: DataFrame, min_words: int = 50, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """`docs` with its text less the later copies of repeated runs; documents of which no line is left go, and `chars_col`, where
    there is one, has the new length of texts that lost lines."""
    joined, text, n_lines, n_removed, columns = _deduplicated(docs, min_words, id_col, text_col)
    if chars_col in docs.columns:
        i = docs.columns.index(chars_col)
        columns[i] = F.when(n_removed > 0, F.length(text).cast(docs.dtypes[i][1])).otherwise(columns[i])
    return joined.where((n_removed == 0) | (n_removed < n_lines)).select(*columns).toDF(*docs.columns)
