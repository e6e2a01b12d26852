"""Queries over the given tables for each operator, with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..operators import blocks, bpe, metrics, model, scaling, stream
from ..sources import artifacts, formats, shared, sweeps

END = "<|endoftext|>"
BLOCK = 256
BUDGET_BATCH = 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Pre-tokens in SQL: RE2 has no look-ahead, so a mark is set where a run of blanks gives up its last one.
_W = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _of(template: str, part: str) -> str:
    return template.replace("{0}", part)


def _pieces(text: str) -> str:
    marked = f"regexp_replace({text}, '([{_W}]+)([{_W}])([^{_W}])', '\\1' || chr(1) || '\\2\\3', 'g')"
    pattern = rf"''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+"
    return f"flatten(list_transform(string_split({marked}, chr(1)), lambda p: regexp_extract_all(p, '{pattern}')))"


_BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda k: lower(substr(hex(encode({0})), 2 * k - 1, 2)))"


def _bytes(text: str) -> str:
    return _of(_BYTES, text)


# --- scans and words


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def corpus_head(spark, sf_dir):
    return stream.head(read(spark, sf_dir, "documents").select("doc_id", "text"), 100)


_WORDS = f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({_pieces('text')}) AS w FROM {{0}}) GROUP BY w"


@query(f"{_of(_WORDS, 'documents')} ORDER BY n DESC, word LIMIT 50")
def pretok_topk(spark, sf_dir):
    return bpe.word_table(read(spark, sf_dir, "documents")).orderBy(F.desc("n"), "word").limit(50)


@query(_of(_WORDS, "documents"))
def word_frequency(spark, sf_dir):
    return bpe.word_table(read(spark, sf_dir, "documents"))


@query(_of(_WORDS, "documents"))
def pretokens_from_sql(spark, sf_dir):
    """The same in SQL, by the table function."""
    tables.register(spark)
    return spark.sql("SELECT t.word, count(*) AS n FROM {docs}, LATERAL pretokens(text) t GROUP BY t.word", docs=read(spark, sf_dir, "documents"))


@query(f"SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest({_pieces('text')}) AS w FROM documents) GROUP BY ALL")
def word_freq_by_lang(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("lang", F.explode(T.pretokens(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


@query(f"SELECT b AS byte, count(*) AS n FROM (SELECT unnest({_bytes('text')}) AS b FROM documents) GROUP BY b")
def byte_hist(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.explode(T.byte_hex(F.col("text"))).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


# --- byte-pair encoding

_SPELLED = f"SELECT '<' || array_to_string({_bytes('word')}, '><') || '>' AS toks, n FROM ({_of(_WORDS, 'documents')})"
_LIST = "regexp_extract_all(toks, '[0-9a-f]+')"
_PAIRS = f"SELECT p[1] AS l, p[2] AS r, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(list_transform(range(1, len({_LIST})), lambda i: [{_LIST}[i], {_LIST}[i + 1]])) AS p, n FROM ({{0}})) GROUP BY ALL"


def _words(spark, sf_dir):
    return bpe.spelled_words(bpe.word_table(read(spark, sf_dir, "documents")))


@query(_of(_PAIRS, _SPELLED))
def pair_counts(spark, sf_dir):
    return bpe.pair_counts(_words(spark, sf_dir))


_BEST = f"SELECT * FROM ({_of(_PAIRS, _SPELLED)}) ORDER BY n DESC, l, r LIMIT 1"


@query(_BEST)
def pair_best(spark, sf_dir):
    return bpe.best_pair(bpe.pair_counts(_words(spark, sf_dir)))


_MERGED = f"SELECT replace(toks, '<' || l || '><' || r || '>', '<' || l || r || '>') AS toks, s.n FROM ({_SPELLED}) s, ({_BEST}) b"


@query(f"SELECT toks, CAST(sum(n) AS BIGINT) AS n FROM ({_MERGED}) GROUP BY toks")
def merge_once(spark, sf_dir):
    words = shared.materialize(_words(spark, sf_dir), "words")  # read twice
    top = bpe.best_pair(bpe.pair_counts(words)).first()
    return bpe.merge_step(words, top.l, top.r)


@query(_of(_PAIRS, _MERGED))
def pair_deltas(spark, sf_dir):
    """Pair counts after the first merge, by deltas of the words that it touches."""
    words = shared.materialize(_words(spark, sf_dir), "words")  # read twice
    counts = bpe.pair_counts(words)
    top = bpe.best_pair(counts).first()
    return bpe.apply_deltas(counts, bpe.merge_deltas(words, top.l, top.r))


MERGES = 200
_trained: dict[tuple[str, str], list[tuple]] = {}  # an application's merges by table: trained once, for all queries


def _merges(spark, sf_dir) -> list[tuple]:
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _trained:
        _trained[at] = sorted(tuple(r) for r in bpe.train(read(spark, sf_dir, "documents"), 256 + 1 + MERGES, [END]).collect())
    return _trained[at]


def _tokenizer(spark, sf_dir) -> bpe.Tokenizer:
    return bpe.Tokenizer.from_merges([(bytes.fromhex(left), bytes.fromhex(right)) for _, left, right, _ in _merges(spark, sf_dir)], [END])


@query()
def bpe_train(spark, sf_dir):
    return spark.createDataFrame(_merges(spark, sf_dir), "rank int, l string, r string, n long")


@query()
def bpe_vocab(spark, sf_dir):
    tokenizer = _tokenizer(spark, sf_dir)
    return bpe.vocab_frame(spark, tokenizer).select("id", F.lower(F.hex("token")).alias("token"))


@query()
def bpe_encode(spark, sf_dir):
    tokenizer = _tokenizer(spark, sf_dir)
    return bpe.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, end=END)


@query(f"SELECT doc_id, text || '{END}' AS text FROM documents")
def bpe_decode(spark, sf_dir):
    """Decoded ids of every document, which are its text and the end token."""
    tokenizer = _tokenizer(spark, sf_dir)
    ids = bpe.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, end=END)
    return bpe.decode_documents(ids, bpe.vocab_frame(spark, tokenizer), "doc_id")


_TALK = f"SELECT conv_id, string_agg(text || '{END}', '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def _conversations(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda t: F.concat(t["text"], F.lit(END))), "").alias("text"))


@query(f"SELECT conv_id, CAST(i - 1 AS INT) AS at, p[i] AS part, p[i] = '{END}' AS special FROM (SELECT conv_id, list_filter(flatten(list_transform(string_split(text, '{END}'), lambda s, k: CASE WHEN k = 1 THEN [s] ELSE ['{END}', s] END)), lambda s: s <> '') AS p FROM ({_TALK})) q, unnest(range(1, len(p) + 1)) AS u(i)")
def special_split(spark, sf_dir):
    parts = _conversations(spark, sf_dir).select("conv_id", F.posexplode(T.split_specials(F.col("text"), [END])).alias("at", "part"))
    return parts.withColumn("special", T.is_special(F.col("part"), [END]))


@query(f"SELECT doc_id, text || '{END}' AS text FROM documents")
def join_docs(spark, sf_dir):
    return stream.join_documents(read(spark, sf_dir, "documents"), END)


# --- the token stream (ids are bytes, 256 ends a document)

_SIZES = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS n FROM documents"
_OFFSETS = f"SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_SIZES})"


def _sizes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n"))


@query(_OFFSETS)
def token_offsets(spark, sf_dir):
    return stream.offsets(_sizes(spark, sf_dir)).select("doc_id", "n", "offset")


def _split(spark, sf_dir, border):
    sizes = _sizes(spark, sf_dir)
    total = sizes.agg(F.sum("n").alias("total"))
    placed = stream.offsets(sizes).crossJoin(F.broadcast(total))  # one row
    return stream.split_sizes(placed, border(F.col("total"))).select("doc_id", "train", "val")


def _split_sql(border: str) -> str:
    return f"SELECT doc_id, CAST(least(n, greatest(0, b - \"offset\")) AS BIGINT) AS train, CAST(n - least(n, greatest(0, b - \"offset\")) AS BIGINT) AS val FROM ({_OFFSETS}), (SELECT {border} AS b FROM (SELECT CAST(sum(n) AS BIGINT) AS t FROM ({_SIZES})))"


@query(_split_sql("t - least(1000000, t // 10)"))
def split_tail(spark, sf_dir):
    return _split(spark, sf_dir, stream.split_tail)


@query(_split_sql("CAST(floor(CAST(0.9 AS DOUBLE) * t) AS BIGINT)"))
def split_share(spark, sf_dir):
    return _split(spark, sf_dir, stream.split_share)


# Each document's ids as four hex digits a token (0100 ends it), cut where chunks begin and end; a chunk's parts joined in order.
_CUTS = (
    f"WITH d AS (SELECT doc_id, n, \"offset\" AS o, regexp_replace(lower(hex(encode(coalesce(text, '')))), '(..)', '00\\1', 'g') || '0100' AS h FROM ({_OFFSETS}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)), "
    f"c AS (SELECT *, unnest(range(greatest(0, (o - 1) // {BLOCK}), (o + n - 1) // {BLOCK} + 1)) AS c FROM d), "
    f"p AS (SELECT c, o, substr(h, 4 * greatest(0, c * {BLOCK} - o) + 1, 4 * (least(n, c * {BLOCK} + {BLOCK + 1} - o) - greatest(0, c * {BLOCK} - o))) AS h FROM c), "
    "w AS (SELECT c, string_agg(h, '' ORDER BY o) AS w FROM p WHERE h <> '' GROUP BY c) "
)


@query(f"{_CUTS}SELECT CAST(c AS BIGINT) AS chunk_id, substr(w, 1, {4 * BLOCK}) AS x, substr(w, 5, {4 * BLOCK}) AS y FROM w WHERE length(w) = {4 * BLOCK + 4}")
def chunks(spark, sf_dir):
    cut = stream.packed_chunks(stream.packed_bytes(read(spark, sf_dir, "documents"), 256), BLOCK)
    return cut.select("chunk_id", F.lower(F.hex("x")).alias("x"), F.lower(F.hex("y")).alias("y"))


@query(
    "WITH t AS (SELECT doc_id, unnest(range(octet_length(encode(text)))) AS i, lower(hex(encode(text))) AS h FROM documents), "
    "p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS token FROM t) "
    "SELECT token, target, count(*) AS n FROM (SELECT token, lead(token) OVER (ORDER BY doc_id, i) AS target FROM p) WHERE target IS NOT NULL GROUP BY ALL"
)
def next_token_pairs(spark, sf_dir):
    """How often a byte follows another in the stream of the documents: each one's own pairs, and those over its border."""
    return stream.next_byte_counts(read(spark, sf_dir, "documents"))


@query("SELECT doc_id, place, place // 32 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents)")
def shuffle_batches(spark, sf_dir):
    return stream.shuffled_batches(read(spark, sf_dir, "documents").select("doc_id"), 32, key="doc_id").select("doc_id", "place", "batch_id")


def _rounds_sql(source: str) -> str:
    """number, n, a, b, y: one pass of the permutation's rounds over x of `source` (number, n, a, b, x)."""
    rows = f"SELECT number, n, a, b, x // b AS l, x % b AS r FROM ({source})"
    for k in range(stream.ROUNDS):
        drawn = f"CAST('0x' || substr(md5('42:{k}:' || {'l' if k % 2 else 'r'}), 1, 8) AS BIGINT)"
        rows = f"SELECT number, n, a, b, {'l' if k % 2 else f'(l + {drawn}) % a AS l'}, {f'(r + {drawn}) % b AS r' if k % 2 else 'r'} FROM ({rows})"
    return f"SELECT number, n, a, b, l * b + r AS y FROM ({rows})"


_COUNTED = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number, count(*) OVER () AS n FROM documents"
_SIDED = f"SELECT number, n, a, CAST(ceil(n / a) AS BIGINT) AS b, number AS x FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM ({_COUNTED}))"


@query(
    f"WITH RECURSIVE w AS ({_rounds_sql(_SIDED)} UNION ALL {_rounds_sql('SELECT number, n, a, b, y AS x FROM w WHERE y >= n')}) "
    f"SELECT doc_id, c.number, y AS place, y // 32 AS batch_id FROM ({_COUNTED}) c JOIN (SELECT * FROM w WHERE y < n) w ON w.number = c.number"
)
def permuted_batches(spark, sf_dir):
    """Documents in a permutation that is computed from their row numbers, in batches of 32."""
    return stream.permuted_batches(read(spark, sf_dir, "documents").select("doc_id"), 32, key="doc_id").select("doc_id", "number", "place", "batch_id")


@query(f"SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST((sum(n) - 1) // {BLOCK} AS BIGINT) AS samples, CAST(ceil(((sum(n) - 1) // {BLOCK}) / 32) AS BIGINT) AS batches FROM ({_SIZES})")
def corpus_counts(spark, sf_dir):
    return metrics.counts(_sizes(spark, sf_dir), BLOCK, 32)


# --- metrics and schedules

_BEST_SO_FAR = "SELECT user_id, event_id, ts, value, coalesce(value < min(value) OVER w, true) AS improved, least(value, coalesce(min(value) OVER w, value)) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _running(spark, sf_dir):
    return metrics.running_best(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"])


@query(f"SELECT user_id, event_id, value, improved, best FROM ({_BEST_SO_FAR})")
def running_best(spark, sf_dir):
    return _running(spark, sf_dir).select("user_id", "event_id", "value", "improved", "best")


@query(
    f"WITH r AS (SELECT *, row_number() OVER w AS rn FROM ({_BEST_SO_FAR}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, rn - coalesce(max(CASE WHEN improved THEN rn END) OVER (PARTITION BY user_id ORDER BY rn), 0) AS stale FROM r), "
    "h AS (SELECT *, coalesce(max(stale) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS worst FROM s) "
    "SELECT user_id, event_id, value, stale FROM h WHERE worst < 5"
)
def early_stop(spark, sf_dir):
    return metrics.early_stop(_running(spark, sf_dir), 5, ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "value", F.col("stale").cast("long").alias("stale"))


@query("SELECT event_type, round(exp(avg(loss)), 6) AS ppl FROM (SELECT event_type, event_id // 32 AS b, avg(value / 100) AS loss FROM events GROUP BY ALL) GROUP BY event_type")
def ppl_unweighted(spark, sf_dir):
    losses = read(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") / 100).alias("value"))
    return metrics.perplexity(metrics.batch_means(losses, "value", F.floor(F.col("event_id") / 32), ["event_type"]), ["event_type"]).select("event_type", F.round("ppl", 6).alias("ppl"))


@query("SELECT user_id, arg_max(value, struct_pack(ts := ts, event_id := event_id)) AS final, min(value) AS best, count(*) AS rows FROM events GROUP BY user_id")
def final_metrics(spark, sf_dir):
    return metrics.final_metrics(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("SELECT event_id AS step, 10000 AS total_steps, round(value / 100, 6) AS loss, round(exp(value / 100), 6) AS train_ppl, round(exp(value / 200), 6) AS val_ppl, 0.5 * event_id AS lr FROM events WHERE event_id % 100 = 0")
def eval_log(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss"), (F.col("value") / 200).alias("val_loss"), (0.5 * F.col("event_id")).alias("lr"))
    rows = metrics.eval_records(log, 100, 10_000)
    return rows.select("step", "total_steps", F.round("loss", 6).alias("loss"), F.round("train_ppl", 6).alias("train_ppl"), F.round("val_ppl", 6).alias("val_ppl"), "lr")


@query("SELECT event_id AS step, round(exp(value / 100), 6) AS ppl FROM events WHERE event_id % 50 = 0")
def ppl_every_k(spark, sf_dir):
    return metrics.every_k(read(spark, sf_dir, "events"), 50, "event_id").select(F.col("event_id").alias("step"), F.round(F.exp(F.col("value") / 100), 6).alias("ppl"))


@query(f"SELECT event_id AS step, event_id * {BUDGET_BATCH * BLOCK} AS seen FROM events WHERE event_id * {BUDGET_BATCH * BLOCK} - {BUDGET_BATCH * BLOCK} < 1000000")
def budget_stop(spark, sf_dir):
    steps = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return metrics.within_budget(steps, 1_000_000, BUDGET_BATCH, BLOCK).withColumn("seen", metrics.tokens_seen(F.col("step"), BUDGET_BATCH, BLOCK))


_RATE = 0.0012


@query(
    f"SELECT CAST(t AS BIGINT) AS step, round(1e6 * CASE WHEN t < 10 THEN {_RATE} * (1e-5 + (1 - 1e-5) * t / 10) ELSE 0.1 * {_RATE} + 0.9 * {_RATE} * (1 + cos(pi() * (t - 10) / 539.0)) / 2 END, 6) AS lr_millionths "
    "FROM (SELECT CAST(unnest(range(1, 550)) AS DOUBLE) AS t)"
)
def lr_schedule(spark, sf_dir):
    steps = metrics.total_steps(18_000_000, 32, 1024, 10**6)
    return metrics.schedule(spark, steps, _RATE).select("step", F.round(F.col("lr") * 1e6, 6).alias("lr_millionths"))


# --- model operations over embeddings: sequences of 16 vectors

_SEQ = "SELECT vec_id // 16 AS seq, vec_id % 16 AS t, embedding AS x FROM embeddings"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _sequences(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("t"), F.col("embedding").alias("x"))


_HEADS = f"SELECT seq, t, CAST(h AS INT) AS head, list_slice(x, 16 * h + 1, 16 * h + 16) AS x FROM ({_SEQ}), unnest(range(4)) AS u(h)"
_SCORES = f"SELECT a.seq, a.head, a.t AS q, b.t AS k, {_DOT.format('a.x', 'b.x')} / sqrt(16) AS score FROM ({_HEADS}) a JOIN ({_HEADS}) b ON a.seq = b.seq AND a.head = b.head AND b.t <= a.t"
_PROBS = f"SELECT *, exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w AS p FROM (SELECT *, max(score) OVER (PARTITION BY seq, head, q) AS m FROM ({_SCORES})) WINDOW w AS (PARTITION BY seq, head, q)"


def _probabilities(spark, sf_dir):
    return model.attention(model.attention_scores(model.heads(_sequences(spark, sf_dir), 4)))


@query(f"SELECT seq, head, q, k, round(score, 6) AS score FROM ({_SCORES})")
def attention_scores(spark, sf_dir):
    return model.attention_scores(model.heads(_sequences(spark, sf_dir), 4)).select("seq", "head", "q", "k", F.round("score", 6).alias("score"))


@query(f"SELECT seq, q, k, round(avg(p), 6) AS p FROM ({_PROBS}) GROUP BY ALL")
def attention_mean(spark, sf_dir):
    return model.mean_over_heads(_probabilities(spark, sf_dir)).select("seq", "q", "k", F.round("p", 6).alias("p"))


@query(f"SELECT p.seq, p.head, p.q AS t, CAST(d - 1 AS INT) AS dim, round(sum(p.p * CAST(v.x[d] AS DOUBLE)), 6) AS o FROM ({_PROBS}) p JOIN ({_HEADS}) v ON p.seq = v.seq AND p.head = v.head AND p.k = v.t, unnest(range(1, 17)) AS u(d) GROUP BY p.seq, p.head, p.q, d")
def causal_attention(spark, sf_dir):
    x = model.heads(_sequences(spark, sf_dir), 4)
    return model.attend(model.attention(model.attention_scores(x)), x).select("seq", "head", "t", "dim", F.round("o", 6).alias("o"))


@query(ORACLES["causal_attention"])
def blockwise_attention(spark, sf_dir):
    """The same by blocks of five positions and an online softmax."""
    o = blocks.blockwise_attention(model.heads(_sequences(spark, sf_dir), 4), 5)
    return o.select("seq", "head", "t", F.posexplode("o").alias("dim", "o")).select("seq", "head", "t", "dim", F.round("o", 6).alias("o"))


_LONG = "SELECT vec_id, CAST(i - 1 AS INT) AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)"


@query(f"SELECT vec_id, dim, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM ({_LONG}))")
def softmax(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(model.softmax(F.col("embedding"))).alias("dim", "p")).select("vec_id", "dim", F.round("p", 6).alias("p"))


@query(f"SELECT vec_id, dim, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 6) AS v FROM ({_LONG}) WINDOW w AS (PARTITION BY vec_id)")
def layer_norm(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(model.layer_norm(F.col("embedding"))).alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("v"))


@query(f"SELECT round(avg(ln(s) + m - z), 6) AS loss FROM (SELECT vec_id, max(m) AS m, sum(exp(v - m)) AS s, max(CASE WHEN dim = label THEN v END) AS z FROM (SELECT l.*, e.label, max(v) OVER (PARTITION BY l.vec_id) AS m FROM ({_LONG}) l JOIN embeddings e USING (vec_id)) GROUP BY vec_id)")
def cross_entropy(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").agg(F.round(F.avg(model.cross_entropy(F.col("embedding"), F.col("label"))), 6).alias("loss"))


@query(ORACLES["cross_entropy"])
def split_cross_entropy(spark, sf_dir):
    """The same with each vector's logits in seven slices, of ten and of four."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", F.col("label").alias("target"))
    cut = vectors.select("key", "embedding", F.explode(F.array(*[F.lit(10 * k) for k in range(7)])).alias("first"))
    slices = cut.select("key", "first", F.slice("embedding", F.col("first") + 1, F.lit(10)).alias("z"))
    return model.split_cross_entropy(slices, vectors.select("key", "target")).agg(F.round(F.avg("loss"), 6).alias("loss"))


_WEIGHTS = [[((3 * i + 5 * j) % 7 - 3) / 4 for j in range(64)] for i in range(3)]
_BIAS = [0.5, -0.25, 0.125]


@query(
    "SELECT vec_id, o AS dim, round(greatest(0, y), 6) AS y FROM ("
    + " UNION ALL ".join(f"SELECT vec_id, {i} AS o, {_DOT.format('embedding', str(w))} + {b} AS y FROM embeddings" for i, (w, b) in enumerate(zip(_WEIGHTS, _BIAS)))
    + ")"
)
def linear_relu(spark, sf_dir):
    y = model.relu(model.linear(F.col("embedding"), _WEIGHTS, _BIAS))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(y).alias("dim", "y")).select("vec_id", "dim", F.round("y", 6).alias("y"))


_DOWN = [[((2 * i + 3 * j) % 5 - 2) / 4 for i in range(3)] for j in range(64)]
_HIDDEN = ", ".join(f"greatest(0, {_DOT.format('embedding', str(w))} + {b}) AS h{i}" for i, (w, b) in enumerate(zip(_WEIGHTS, _BIAS)))
_DOWN_SQL = " + ".join(f"h{i} * ((2 * {i} + 3 * (d - 1)) % 5 - 2) / 4" for i in range(3))


@query(f"SELECT vec_id, CAST(d - 1 AS INT) AS dim, round(CAST(embedding[d] AS DOUBLE) + 0.125 + {_DOWN_SQL}, 6) AS x FROM (SELECT vec_id, embedding, {_HIDDEN} FROM embeddings), unnest(range(1, 65)) AS u(d)")
def feed_forward(spark, sf_dir):
    """The second half of a block: linear, ReLU, linear, and the input added."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    y = model.residual(x, model.feed_forward(F.col("embedding"), _WEIGHTS, _BIAS, _DOWN, [0.125] * 64))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(y).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


_WEIGHT_ROWS = "SELECT vec_id AS o, CAST(i - 1 AS BIGINT) AS i, CAST(embedding[i] AS DOUBLE) AS w FROM embeddings, unnest(range(1, 65)) AS u(i) WHERE vec_id < 200"


@query(f"SELECT e.vec_id, CAST(w.o AS INT) AS dim, round(sum(CAST(e.embedding[w.i + 1] AS DOUBLE) * w.w), 6) AS y FROM embeddings e, ({_WEIGHT_ROWS}) w GROUP BY e.vec_id, w.o")
def tiled_linear(spark, sf_dir):
    """All vectors times the first 200 of them, whose numbers are a table of weights."""
    vectors = read(spark, sf_dir, "embeddings")
    weights = vectors.where("vec_id < 200").select(F.col("vec_id").alias("o"), F.posexplode("embedding").alias("i", "w"))
    y = blocks.tiled_linear(vectors.select(F.col("vec_id").alias("key"), F.col("embedding").alias("x")), weights, 200, tile=32)
    return y.select(F.col("key").alias("vec_id"), F.posexplode("y").alias("dim", "y")).select("vec_id", "dim", F.round("y", 6).alias("y"))


@query("SELECT seq, t, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE)) AS x FROM (SELECT event_id // 16 AS seq, event_id % 16 AS t, user_id AS id FROM events) e JOIN embeddings a ON a.vec_id = e.id JOIN embeddings b ON b.vec_id = e.t + 100")
def embedding_gather(spark, sf_dir):
    """Whole vectors of the token ids and of their places (a table of 16 places)."""
    tokens = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 16).alias("seq"), (F.col("event_id") % 16).alias("t"), F.col("user_id").alias("id"))
    vectors = read(spark, sf_dir, "embeddings")
    by_id = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    by_place = vectors.where("vec_id BETWEEN 100 AND 115").select((F.col("vec_id") - 100).alias("t"), F.col("embedding").alias("v"))
    return model.embed(tokens, by_id, by_place).select("seq", "t", "x")


@query(f"SELECT seq, arg_max(x, t) AS x FROM ({_SEQ}) GROUP BY seq")
def last_position(spark, sf_dir):
    return model.last_position(_sequences(spark, sf_dir))


_U = "(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 6) AS BIGINT) / 16777216.0)"


@query(f"WITH p AS (SELECT vec_id, dim, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM ({_LONG}))), c AS (SELECT vec_id, dim, sum(p) OVER (PARTITION BY vec_id ORDER BY dim) AS c FROM p) SELECT vec_id, CAST(least(63, count(*) FILTER (c < {_U})) AS INT) AS id FROM c GROUP BY vec_id")
def sample_draw(spark, sf_dir):
    u = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    return read(spark, sf_dir, "embeddings").select("vec_id", model.pick(model.softmax(F.col("embedding")), u).alias("id"))


@query("SELECT vec_id, embedding[-16:] AS tail FROM embeddings")
def crop_context(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", stream.crop(F.col("embedding"), 16).alias("tail"))


@query()
def generate(spark, sf_dir):
    """Every benchmark item, its whole text as the prompt, and the operator's own number of steps."""
    prompts = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), T.byte_ids(F.col("text")).alias("ids"))
    return model.generate(prompts, model.random_decoder(256, 32, 32, 2, 64), 4)


# --- sweeps

_CAL = sweeps.values_sql(sweeps.CALIBRATED)
_MEASURED = f"SELECT *, 12 * l * d * d AS n, CAST(tokens_m * 1000000 AS BIGINT) AS tokens, tokens_m * 1000000 / (12 * l * d * d) AS ratio, ln(val_ppl) AS ln_ppl FROM {_CAL}"
_OPT = f"SELECT c, unnest(min_by({{'n': n, 'tokens': tokens, 'ratio': ratio, 'val_ppl': val_ppl, 'ln_ppl': ln_ppl, 'lr': lr}}, val_ppl)) FROM ({_MEASURED}) GROUP BY c"


def _measured(spark):
    return scaling.measures(sweeps.sweep(spark, sweeps.CALIBRATED))


@query(f"SELECT d, l, ff, CAST(12 * l * d * d AS BIGINT) AS n, CAST(l * (4 * (d * d + d) + 2 * d * ff + ff + d + 4 * d) + 4000 * d + 1024 * d + 2 * d + d * 4000 + 4000 AS BIGINT) AS total FROM {_CAL}")
def param_count(spark, sf_dir):
    rows = sweeps.sweep(spark, sweeps.CALIBRATED)
    return rows.select("d", "l", "ff", scaling.block_parameters(F.col("d"), F.col("l")).alias("n"), scaling.total_parameters(F.col("d"), F.col("l"), F.col("ff"), 4000, 1024).alias("total"))


@query(f"SELECT c, d, l, CAST(n AS BIGINT) AS n, round(6.0 * n * tokens / 1e9, 3) AS gflop, round(ratio, 6) AS ratio, round(ln_ppl, 6) AS ln_ppl FROM ({_MEASURED})")
def sweep_measures(spark, sf_dir):
    return _measured(spark).select("c", "d", "l", "n", F.round(F.col("compute") / 1e9, 3).alias("gflop"), F.round("ratio", 6).alias("ratio"), F.round("ln_ppl", 6).alias("ln_ppl"))


@query(f"SELECT c, CAST(n AS BIGINT) AS n, tokens, round(ratio, 6) AS ratio, val_ppl, round(ln_ppl, 6) AS ln_ppl, lr FROM ({_OPT})")
def iso_optimum(spark, sf_dir):
    return scaling.optimum(_measured(spark)).select("c", "n", "tokens", F.round("ratio", 6).alias("ratio"), "val_ppl", F.round("ln_ppl", 6).alias("ln_ppl"), "lr")


@query(f"SELECT c, CAST(n AS BIGINT) AS n, n > lo AND n < hi AS interior FROM ({_OPT}) JOIN (SELECT c, min(n) AS lo, max(n) AS hi FROM ({_MEASURED}) GROUP BY c) USING (c)")
def interior_flag(spark, sf_dir):
    return scaling.interior(_measured(spark))


@query(f"SELECT round(regr_slope(ln(ratio), ln(c)), 6) AS exponent, round(regr_intercept(ln(ratio), ln(c)), 6) AS log_factor FROM ({_OPT})")
def power_fit(spark, sf_dir):
    return scaling.power_fit(scaling.optimum(_measured(spark)), "c", "ratio").select(F.round("exponent", 6).alias("exponent"), F.round("log_factor", 6).alias("log_factor"))


@query(f"SELECT 6e23 AS x, round(exp(regr_intercept(ln(n), ln(c)) + regr_slope(ln(n), ln(c)) * ln(6e23)) / 1e6, 0) AS n_millions FROM ({_OPT})")
def extrapolate(spark, sf_dir):
    fit = scaling.power_fit(scaling.optimum(_measured(spark)), "c", "n")
    return scaling.extrapolate(fit, 6e23).select("x", F.round(F.col("y") / 1e6, 0).alias("n_millions"))


@query(f"SELECT d, min_by(lr, val_ppl) AS lr, min(val_ppl) AS val_ppl FROM {sweeps.values_sql(sweeps.RATES)} GROUP BY d")
def lr_anchor(spark, sf_dir):
    return scaling.best_rates(sweeps.sweep(spark, sweeps.RATES))


# Anchors: parameters and rate of the three calibrated models.
_ANCHORS = [(552960, 0.0045), (3145728, 0.004), (25165824, 0.0016)]


@query(
    f"SELECT c, CAST(n AS BIGINT) AS n, lr, round(1e6 * CASE WHEN n < {_ANCHORS[1][0]} THEN {_ANCHORS[0][1]} + ({_ANCHORS[1][1]} - {_ANCHORS[0][1]}) * (ln(n) - ln({_ANCHORS[0][0]})) / (ln({_ANCHORS[1][0]}) - ln({_ANCHORS[0][0]})) "
    f"ELSE {_ANCHORS[1][1]} + ({_ANCHORS[2][1]} - {_ANCHORS[1][1]}) * (ln(n) - ln({_ANCHORS[1][0]})) / (ln({_ANCHORS[2][0]}) - ln({_ANCHORS[1][0]})) END, 4) AS rate_millionths FROM ({_MEASURED})"
)
def lr_interp(spark, sf_dir):
    anchors = spark.createDataFrame(_ANCHORS, "n long, lr double")
    return scaling.interpolated_rates(_measured(spark).select("c", "n", "lr"), anchors).select("c", "n", "lr", F.round(F.col("rate") * 1e6, 4).alias("rate_millionths"))


_ON = ["d", "l", "h", "ff", "tokens_m"]


@query(f"SELECT d, l, h, ff, tokens_m, a.val_ppl AS ppl_1, a.loss AS loss_1, b.val_ppl AS ppl_2, b.loss AS loss_2, round(b.val_ppl - a.val_ppl, 6) AS ppl_change FROM {sweeps.values_sql(sweeps.FIRST)} a FULL JOIN {_CAL} b USING (d, l, h, ff, tokens_m)")
def exp_compare(spark, sf_dir):
    found = scaling.compare(sweeps.sweep(spark, sweeps.FIRST), sweeps.sweep(spark, sweeps.CALIBRATED), _ON)
    return found.withColumn("ppl_change", F.round("ppl_change", 6))


@query(f"SELECT CAST(row_number() OVER (ORDER BY c, tokens_m) AS INT) AS run, c, d, l, tokens_m, tokens_m * 1000000 <= 180000000 AS valid FROM {_CAL}")
def sweep_runs(spark, sf_dir):
    runs = scaling.numbered(sweeps.sweep(spark, sweeps.CALIBRATED), ["c", "tokens_m"])
    seen = runs.withColumn("token_budget", (F.col("tokens_m") * 1_000_000).cast("long")).withColumn("tokens_seen", F.least("token_budget", F.lit(180_000_000)))
    return scaling.valid(seen).select("run", "c", "d", "l", "tokens_m", "valid")


# --- files of a run, written to the shared folder and read again


def _written(spark, name: str) -> str:
    return shared.temporary(spark, shared.new_dir(spark, name))


@query(f"SELECT CAST(row_number() OVER (ORDER BY n DESC, l, r) - 1 AS INT) AS rank, l, r FROM (SELECT * FROM ({_of(_PAIRS, _SPELLED)}) ORDER BY n DESC, l, r LIMIT 50)")
def tokenizer_file(spark, sf_dir):
    """The 50 most frequent pairs as merges, through a tokenizer's JSON file; the loaded tokenizer is the saved one."""
    top = bpe.pair_counts(_words(spark, sf_dir)).orderBy(F.desc("n"), "l", "r").limit(50).collect()
    tokenizer = bpe.Tokenizer.from_merges([(bytes.fromhex(r.l), bytes.fromhex(r.r)) for r in top], [END])
    path = _written(spark, "tokenizer")
    artifacts.save_tokenizer(spark, tokenizer, path)
    if artifacts.fingerprint(artifacts.load_tokenizer(spark, path)) != artifacts.fingerprint(tokenizer):
        raise ValueError("the loaded tokenizer isn't the saved one")
    return artifacts.merges_frame(spark, path)


@query("SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS INT) AS n FROM documents")
def token_cache(spark, sf_dir):
    """Byte ids of all documents, written by the tokenizer's name and read from there the second time."""
    base = artifacts.token_cache_path(_written(spark, "tokens"), bpe.Tokenizer.from_merges([], [END]), 0)
    made = lambda: stream.byte_tokens(read(spark, sf_dir, "documents"), 256)
    artifacts.cached(spark, base, made)
    return artifacts.cached(spark, base, made).select("doc_id", F.size("ids").alias("n"))


@query("SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS INT) AS n, md5(lower(hex(encode(coalesce(text, ''))))) AS ids FROM documents")
def token_source(spark, sf_dir):
    """Byte ids of all documents through the data source of tokens."""
    formats.register(spark)
    path, name = _written(spark, "token-source"), artifacts.fingerprint(bpe.Tokenizer.from_merges([], [END]))
    stream.byte_tokens(read(spark, sf_dir, "documents"), 256).write.format("corpusmill_tokens").mode("append").option("tokenizer", name).save(path)
    ids = spark.read.format("corpusmill_tokens").option("tokenizer", name).load(path)
    text = F.array_join(F.transform(F.filter("ids", lambda i: i < 256), lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(text).alias("ids"))


@query("SELECT CAST(event_id AS INT) AS step, 10000 AS total_steps, CAST(printf('%.6f', value / 100) AS DOUBLE) AS loss, CAST(printf('%.4f', exp(value / 100)) AS DOUBLE) AS train_ppl, CAST(printf('%.4f', exp(value / 200)) AS DOUBLE) AS val_ppl, CAST(printf('%.6e', 0.5 * event_id) AS DOUBLE) AS lr FROM events WHERE event_id % 100 = 0")
def log_file(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss"), (F.col("value") / 200).alias("val_loss"), (0.5 * F.col("event_id")).alias("lr"))
    path = _written(spark, "log")
    artifacts.write_log(metrics.eval_records(log, 100, 10_000).select("step", "total_steps", "loss", "train_ppl", "val_ppl", "lr"), path)
    return artifacts.read_log(spark, path)


@query(f"SELECT row_number() OVER (ORDER BY c, tokens_m) AS seed, d AS d_model, l AS num_layers, h AS num_heads, ff AS d_ff, CAST(tokens_m * 1000000 AS BIGINT) AS token_budget, val_ppl AS best_val_ppl FROM {_CAL}")
def run_configs(spark, sf_dir):
    """A configuration file for each calibrated run, and all of them scanned by one glob and one schema."""
    base = _written(spark, "runs")
    runs = scaling.numbered(sweeps.sweep(spark, sweeps.CALIBRATED), ["c", "tokens_m"])
    config = runs.select(
        F.col("run").cast("int").alias("seed"),
        F.struct(F.col("d").alias("d_model"), F.col("ff").alias("d_ff"), F.col("h").alias("num_heads"), F.col("l").alias("num_layers")).alias("model"),
        F.struct((F.col("tokens_m") * 1_000_000).cast("long").alias("token_budget"), F.col("val_ppl").alias("best_val_ppl")).alias("training"),
    )
    for variant, part in enumerate((config.where("seed <= 11"), config.where("seed > 11"))):
        artifacts.write_run_config(part, f"{base}/run{variant}")
    rows = spark.read.schema(artifacts.RUN_CONFIG).json(f"{base}/run*")
    return rows.select(F.col("seed").cast("long").alias("seed"), "model.d_model", "model.num_layers", "model.num_heads", "model.d_ff", "training.token_budget", "training.best_val_ppl")


def _sweep_lines(spark, text: str, heading: str, with_results: bool):
    """A sweep as its script writes it: quoted, blank-separated rows below a heading, with remarks."""
    lines = [f"# {heading}", "echo start"]
    for r in sweeps.rows(text):
        c, d, l, h, ff, tokens_m, lr, _, _, loss, ppl = r
        fields = [d, l, h, ff, int(tokens_m * 1_000_000), f"{lr:.1e}", *([loss, ppl] if with_results else [])]
        lines.append('    "' + "   ".join(map(str, fields)) + '"   # run')
    return spark.createDataFrame(list(enumerate(lines)), "pos int, value string")


@query(f"SELECT d, l, h, ff, CAST(tokens_m * 1000000 AS BIGINT) AS tokens, lr FROM {_CAL}")
def sweep_configs(spark, sf_dir):
    return sweeps.parse_configs(_sweep_lines(spark, sweeps.CALIBRATED, "runs", False))


@query(f"SELECT 'Rates' AS section, d, l, h, ff, CAST(tokens_m * 1000000 AS BIGINT) AS tokens, lr, loss, val_ppl FROM {sweeps.values_sql(sweeps.RATES)}")
def sweep_results(spark, sf_dir):
    return sweeps.parse_results(_sweep_lines(spark, sweeps.RATES, "Rates", True))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run FROM events")
def run_names(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", artifacts.run_name(F.col("ts")).alias("run"))


# --- an extra: a corpus filtered by its labels


@query("SELECT d.lang, count(*) AS docs, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0 GROUP BY d.lang")
def quality_corpus(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(good, "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
