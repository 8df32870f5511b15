"""Tokens, samples, packing and batches."""

from trainset.functions.tokens import token_count, token_ids, token_strings
from trainset.operators import encode as E
from trainset.operators import render as R
from trainset.operators.vocabulary import BLOCK_TOKENS, UNKNOWN, build_vocabulary, encode_with_vocabulary
from trainset.plans.samples import build_text_samples, build_turn_samples, sample_report
from trainset.queries.common import SEED_SQL, F, long, query, table
from trainset.queries.profiling import TOKENS_SQL, pct_sql
from trainset.session import materialize
from trainset.queries.rendering import _CUT, _THINK, turns
from trainset.plans import samples as PS

# Packing works on any ids. For the SQL twin a token is coded by its first character and length.
ID_SQL = "CAST(unicode({t}) * 1000 + length({t}) AS BIGINT)"
END_ID = 7


def coded_tokens(text):
    codes = F.transform(token_strings(text), lambda t: (F.ascii(t) * 1000 + F.length(t)).cast("int"))
    return F.concat(codes, F.array(F.lit(END_ID)))


def n_tokens(c: str) -> str:
    return f"len({TOKENS_SQL.format(c=c)})"


def checksum(ids):
    """Order-sensitive sum over a token array: sum of id · (position mod 1000)."""
    weighted = F.transform(ids, lambda t, i: t.cast("long") * (F.pmod(i, F.lit(1000)) + 1))
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x)


@query(
    "token_counts",
    f"SELECT doc_id, {n_tokens('text')} AS tokens FROM documents",
)
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


@query(
    "token_ids",
    f"""WITH t AS (SELECT item_id, unnest({TOKENS_SQL.format(c='text')}) AS tok FROM benchmark)
    SELECT item_id, count(*) AS tokens, count(DISTINCT tok) AS distinct_ids FROM t GROUP BY item_id""",
)
def token_ids_query(spark, sf_dir):
    coded = table(spark, sf_dir, "benchmark").select("item_id", token_ids(F.col("text")).alias("ids"))
    return coded.select("item_id", long(F.size("ids")).alias("tokens"), long(F.size(F.array_distinct("ids"))).alias("distinct_ids"))


@query(
    "vocabulary",
    f"""SELECT tok AS token, count(*) AS n FROM (SELECT unnest({TOKENS_SQL.format(c='text')}) AS tok FROM documents)
        GROUP BY 1""",
)
def vocabulary(spark, sf_dir):
    """All tokens with their counts, which combine on the map side, so hot tokens do not skew."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(token_strings(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_VOCABULARY = f"""WITH t AS (SELECT doc_id, toks, generate_subscripts(toks, 1) AS pos FROM (
  SELECT doc_id, {TOKENS_SQL.format(c='text')} AS toks FROM documents)),
w AS (SELECT doc_id, pos, toks[pos] AS token FROM t), c AS (SELECT token, count(*) AS n FROM w GROUP BY token),
v AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, md5(token), token) AS id FROM c) """


@query("vocabulary_ids", _VOCABULARY + f"SELECT token, n, id FROM v UNION ALL SELECT '{UNKNOWN}', 0, 0")
def vocabulary_ids(spark, sf_dir):
    return build_vocabulary(table(spark, sf_dir, "documents"))


@query(
    "encode_with_vocabulary",
    _VOCABULARY + """SELECT d.doc_id, coalesce(x.tokens, 0) AS tokens, coalesce(x.checksum, 0) AS checksum, coalesce(x.highest, -1) AS highest
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS tokens, CAST(sum(id * (pos - 1)) AS BIGINT) AS checksum, max(id) AS highest
    FROM (SELECT doc_id, pos, CASE WHEN n >= 2 THEN id ELSE 0 END AS id FROM w JOIN v USING (token)) GROUP BY doc_id) x USING (doc_id)""",
)
def encode_documents_with_vocabulary(spark, sf_dir):
    """Tokens seen once stay unknown; blocks are put together by sums that know their places."""
    docs = table(spark, sf_dir, "documents")
    coded = encode_with_vocabulary(docs, materialize(build_vocabulary(docs, min_count=2), "vocabulary"), "doc_id", hot=512)
    start = F.col("block").cast("long") * BLOCK_TOKENS
    placed = F.aggregate(F.transform("ids", lambda t, i: t * (start + i)), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = coded.select("doc_id", F.size("ids").alias("n"), placed.alias("placed"), F.coalesce(F.array_max("ids"), F.lit(-1)).alias("top"))
    return rows.groupBy("doc_id").agg(long(F.sum("n")).alias("tokens"), F.sum("placed").alias("checksum"), long(F.max("top")).alias("highest"))


_SFT = _CUT + f""", n AS (SELECT conv_id, CAST(sum({n_tokens("('<|im_start|>' || role || chr(10))")} + {n_tokens('text')} + 8 +
   CASE WHEN role = 'assistant' AND (lu IS NULL OR turn > lu) THEN {n_tokens("('" + _THINK + "')")} ELSE 0 END) AS BIGINT) AS tokens,
   CAST(sum(CASE WHEN role = 'assistant' THEN {n_tokens('text')} + 7 ELSE 0 END) AS BIGINT) AS trainable_tokens FROM c GROUP BY conv_id)
"""


@query("encode_sft_counts", _SFT + "SELECT conv_id, tokens, trainable_tokens, CASE WHEN tokens > 700 THEN 'skipped_long' WHEN trainable_tokens = 0 THEN 'skipped_untrainable' ELSE 'sample' END AS outcome FROM n")
def encode_sft_counts(spark, sf_dir):
    return E.sample_outcomes(E.turn_token_counts(R.render_turns(turns(spark, sf_dir), R.CHATML)), 700)


@query("encode_sft_samples", _SFT + "SELECT conv_id, tokens, trainable_tokens FROM n WHERE tokens <= 700 AND trainable_tokens > 0")
def encode_sft_samples(spark, sf_dir):
    s = build_turn_samples(turns(spark, sf_dir), R.CHATML, 700)
    return s.select("conv_id", long(F.size("input_ids")).alias("tokens"), E.trainable_tokens(F.col("labels")).alias("trainable_tokens"))


@query("encode_sft_truncated")
def encode_sft_truncated(spark, sf_dir):
    s = build_turn_samples(turns(spark, sf_dir), R.CHATML, 256, "truncate")
    return s.select("conv_id", long(F.size("input_ids")).alias("tokens"), E.trainable_tokens(F.col("labels")).alias("trainable_tokens"))


@query(
    "completion_samples",
    f"""WITH t AS (SELECT item_id, {n_tokens('left(text, 60)')} AS p, {n_tokens('substr(text, 61)')} + 1 AS c FROM benchmark)
        SELECT item_id, p + c AS tokens, c AS trainable_tokens FROM t WHERE p + c <= 200""",
)
def completion_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 60).alias("prompt"), F.expr("substring(text, 61)").alias("completion"))
    s = E.encode_completion(rows, "prompt", "completion", R.CHATML, 200, keep=["item_id"])
    return s.select("item_id", long(F.size("input_ids")).alias("tokens"), E.trainable_tokens(F.col("labels")).alias("trainable_tokens"))


@query(
    "text_chunks",
    f"""WITH t AS (SELECT doc_id, {n_tokens('text')} + 1 AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, n, 512)) AS start FROM t)
        SELECT doc_id, start, least(512, n - start) AS tokens FROM c WHERE start = 0 OR n - start >= 16""",
)
def text_chunks(spark, sf_dir):
    coded = table(spark, sf_dir, "documents").select("doc_id", E.marked_ids(F.col("text"), R.CHATML).alias("ids"))
    return E.chunk_text(coded, "ids", 512, ["doc_id"], min_chunk=E.MIN_CHUNK).select("doc_id", long(F.col("start")).alias("start"), long(F.size("input_ids")).alias("tokens"))


@query("document_markers", f"SELECT doc_id, {n_tokens('text')} + 2 AS tokens, true AS marked FROM documents")
def document_markers(spark, sf_dir):
    """Begin and end tokens; adding them twice changes nothing."""
    once = table(spark, sf_dir, "documents").select("doc_id", E.document_ids(token_ids(F.col("text")), R.TURN_TAG).alias("ids"))
    twice = once.select("doc_id", "ids", E.document_ids(F.col("ids"), R.TURN_TAG).alias("again"))
    return twice.select("doc_id", long(F.size("ids")).alias("tokens"), (F.col("ids") == F.col("again")).alias("marked"))


_STREAM = f"""WITH d AS (SELECT doc_id, list_append(list_transform({TOKENS_SQL.format(c='text')}, lambda x: {ID_SQL.format(t='x')}), {END_ID}) AS ids,
  {SEED_SQL(42, 'doc_id')} AS h FROM documents),
s AS (SELECT ids, coalesce(sum(len(ids)) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
t AS (SELECT unnest(ids) AS id, start + generate_subscripts(ids, 1) - 1 AS p FROM s),
b AS (SELECT CAST(floor(p / 1024) AS BIGINT) AS block, id, p % 1024 AS i FROM t)
"""


@query(
    "packed_blocks",
    _STREAM + "SELECT block, count(*) AS tokens, CAST(sum(id * (i % 1000 + 1)) AS BIGINT) AS checksum FROM b GROUP BY block HAVING count(*) >= 64",
)
def packed_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = E.pack(docs, "doc_id", token_count(F.col("text")) + 1, coded_tokens(F.col("text")), 1024, min_tail=E.MIN_TAIL)
    return blocks.select("block", long(F.size("input_ids")).alias("tokens"), checksum(F.col("input_ids")).alias("checksum"))


@query(
    "preference_samples",
    f"""WITH t AS (SELECT doc_id, {n_tokens("left(text, 80)")} AS p, {n_tokens("substr(text, 81)")} AS c, {n_tokens('source')} AS r FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, p + c AS chosen_tokens, p + r AS rejected_tokens, c AS chosen_trainable, r AS rejected_trainable FROM t
        WHERE p + c <= 600 AND p + r <= 600 AND c > 0 AND r > 0""",
)
def preference_samples(spark, sf_dir):
    s = _pairs(spark, sf_dir)
    return s.select(
        "doc_id", long(F.size("chosen_ids")).alias("chosen_tokens"), long(F.size("rejected_ids")).alias("rejected_tokens"),
        E.trainable_tokens(F.col("chosen_labels")).alias("chosen_trainable"), E.trainable_tokens(F.col("rejected_labels")).alias("rejected_trainable"),
    )


def _pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(
        "doc_id", token_ids(F.substring("text", 1, 80)).alias("p"), token_ids(F.expr("substring(text, 81)")).alias("c"), token_ids(F.col("source")).alias("r")
    )
    return E.pair_samples(rows, "p", "c", "r", 600, ["doc_id"])


@query(
    "preference_batches",
    f"""WITH t AS (SELECT doc_id, {n_tokens("left(text, 80)")} AS p, {n_tokens("substr(text, 81)")} AS c, {n_tokens('source')} AS r FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY {SEED_SQL(42, 'doc_id')}, doc_id) - 1) / 4) AS BIGINT) AS batch FROM t WHERE p + c <= 600 AND p + r <= 600 AND c > 0 AND r > 0)
    SELECT batch, count(*) * 2 AS "rows", CAST(ceil(greatest(max(p + c), max(p + r)) / 8.0) * 8 AS BIGINT) AS padded_len, CAST(sum(2 * p + c + r) AS BIGINT) AS real_tokens FROM k GROUP BY batch""",
)
def preference_batches(spark, sf_dir):
    b = E.pad_preference_batches(_pairs(spark, sf_dir), "doc_id", 4)
    return b.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"), long(F.max(F.size("input_ids"))).alias("padded_len"),
        F.sum(F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)).alias("real_tokens"),
    )


@query(
    "build_sft_samples",
    f"""WITH t AS (SELECT {n_tokens('text')} + 1 AS n, 1 + doc_id % 3 AS copies FROM documents), c AS (SELECT n, copies, unnest(range(0, n, 512)) AS start FROM t)
        SELECT CAST(sum(copies) AS BIGINT) AS samples, CAST(sum(copies * least(512, n - start)) AS BIGINT) AS tokens, CAST(sum(copies * least(512, n - start)) AS BIGINT) AS trainable_tokens
        FROM c WHERE start = 0 OR n - start >= 16""",
)
def build_sft_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("repeat", F.pmod("doc_id", F.lit(3)) + 1)
    return sample_report(build_text_samples(docs, R.CHATML, 512, "sft", "doc_id", min_chunk=E.MIN_CHUNK))


@query(
    "build_cpt_samples",
    f"""WITH t AS (SELECT CAST(sum(({n_tokens('text')} + 1) * (1 + doc_id % 3)) AS BIGINT) AS n FROM documents)
        SELECT CAST(n // 512 + (CASE WHEN n % 512 >= 64 THEN 1 ELSE 0 END) AS BIGINT) AS samples,
          CAST(n - (CASE WHEN n % 512 >= 64 THEN 0 ELSE n % 512 END) AS BIGINT) AS tokens,
          CAST(n - (CASE WHEN n % 512 >= 64 THEN 0 ELSE n % 512 END) AS BIGINT) AS trainable_tokens FROM t""",
)
def build_cpt_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("repeat", F.pmod("doc_id", F.lit(3)) + 1)
    return sample_report(build_text_samples(docs, R.CHATML, 512, "cpt", "doc_id", min_tail=E.MIN_TAIL))


_BATCH = f"""WITH t AS (SELECT item_id, {n_tokens('text')} AS n FROM benchmark)"""


@query(
    "padded_batches",
    _BATCH + f""", b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY {SEED_SQL(42, 'item_id')}, item_id) - 1) / 4) AS BIGINT) AS batch FROM t)
    SELECT item_id, batch, CAST(ceil(max(n) OVER (PARTITION BY batch) / 8.0) * 8 AS BIGINT) AS padded_len, n AS real_tokens FROM b""",
)
def padded_batches(spark, sf_dir):
    coded = table(spark, sf_dir, "benchmark").select("item_id", token_ids(F.col("text")).alias("input_ids")).withColumn("labels", F.col("input_ids"))
    padded = E.pad_batches(E.assign_batches(coded, "item_id", 4))
    return padded.select(
        "item_id", "batch", long(F.size("labels")).alias("padded_len"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("real_tokens"),
    )


@query(
    "length_batches",
    f"""WITH t AS (SELECT doc_id, {n_tokens('text')} AS n FROM documents)
    SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY n, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) / 16) AS BIGINT) AS batch FROM t""",
)
def length_batches(spark, sf_dir):
    # The lengths are needed in three passes: measure once, go on with the narrow table.
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n")), "lengths")
    return E.length_batches(docs, "n", "doc_id", 16).select("doc_id", "batch")


def _records(spark, sf_dir):
    """A question and an answer for each document; some with a tool, with a source text, or learned whole."""
    from trainset.schema import DOC, MESSAGE, TOOL

    def struct(kind, **given):
        values = {f.name: F.lit(None).cast(f.dataType) for f in kind.fields} | given
        return F.struct(*[values[f.name].alias(f.name) for f in kind.fields])

    k = F.col("doc_id")
    said = lambda role, c, calls=None: struct(MESSAGE, role=F.lit(role), content=c, **({"tool_calls": calls} if calls is not None else {}))
    call = F.struct(F.lit(None).cast("string").alias("id"), F.lit("f").alias("name"), F.lit("x").alias("arguments"), F.lit(False).alias("args_is_object"), F.lit(None).cast("string").alias("type"))
    broken = F.when(F.pmod(k, F.lit(7)) == 0, F.array(call))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        k.alias("seq"), F.lit("trace").alias("kind"),
        F.array(said("user", F.concat(F.lit("Which source? "), F.col("lang"))), said("assistant", F.col("source"), broken)).alias("messages"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.array(struct(TOOL, name=F.col("lang"), parameters=F.lit("{}")))).alias("tools"),
        F.when(F.pmod(k, F.lit(3)) == 1, F.array(struct(DOC, text=F.col("n_chars").cast("string")))).alias("documents"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit("all")).when(F.pmod(k, F.lit(5)) == 1, F.lit("last")).alias("train_on"),
        F.array(said("assistant", F.col("source"))).alias("chosen"), F.array(said("assistant", F.lit("none"))).alias("rejected"),
    )


_TOOL_HEAD = " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in R.TOOLS_PREAMBLE.split("\n"))
_RECORD_TEXT = f"""WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '<|im_start|>system' || chr(10) || {_TOOL_HEAD} || '{{"name":"' || lang || '","parameters":{{}}}}' || '<|im_end|>' || chr(10)
    WHEN doc_id % 3 = 1 THEN '<|im_start|>system' || chr(10) || 'Use the following documents to answer:' || chr(10) || chr(10) || '[1]' || chr(10) || n_chars || '<|im_end|>' || chr(10) ELSE '' END
    || '<|im_start|>user' || chr(10) || 'Which source? ' || lang || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS head FROM documents) """


@query(
    "record_sample_texts",
    _RECORD_TEXT + """SELECT doc_id AS seq, md5(head || source || '<|im_end|>' || chr(10)) AS text,
    md5(CASE WHEN doc_id % 5 = 0 THEN head || source || '<|im_end|>' || chr(10) ELSE source || '<|im_end|>' END) AS learned FROM d WHERE doc_id % 7 <> 0""",
)
def record_sample_texts(spark, sf_dir):
    """Text and learned text of canonical records with tools, documents and their own train_on; broken calls are left out."""
    rendered = PS.render_records(PS.turns_of_records(_records(spark, sf_dir).drop("chosen", "rejected")), R.CHATML)
    return PS.sample_texts(rendered).select("seq", F.md5("text").alias("text"), F.md5("learned").alias("learned"))


@query(
    "record_samples",
    _RECORD_TEXT + f"""SELECT doc_id AS seq, {n_tokens("(head || source || '<|im_end|>' || chr(10))")} AS tokens FROM d WHERE doc_id % 7 <> 0""",
)
def record_samples(spark, sf_dir):
    made = PS.build_samples(_records(spark, sf_dir).drop("chosen", "rejected"), R.CHATML, "sft", 4096)
    return made.select("seq", long(F.size("input_ids")).alias("tokens"))


@query(
    "record_outcomes",
    "SELECT CASE WHEN doc_id % 7 = 0 THEN 'unrenderable' ELSE 'sample' END AS outcome, CASE WHEN doc_id % 7 = 0 THEN 'tool call has non-object arguments' END AS reason, count(*) AS n FROM documents GROUP BY ALL",
)
def record_outcomes(spark, sf_dir):
    return PS.build_report(_records(spark, sf_dir).drop("chosen", "rejected"), R.CHATML, 4096)


@query(
    "record_preferences",
    f"""WITH d AS (SELECT doc_id, {n_tokens("(source || '<|im_end|>')")} AS c, {n_tokens("'none<|im_end|>'")} AS r FROM documents)
    SELECT doc_id AS seq, c AS chosen_learned, r AS rejected_learned, c - r AS longer FROM d""",
)
def record_preferences(spark, sf_dir):
    """Pairs of canonical preference records: only the answers carry labels."""
    pairs = PS.build_samples(_records(spark, sf_dir).withColumn("messages", F.slice("messages", 1, 1)), R.CHATML, "dpo", 4096)
    return pairs.select(
        "seq", E.trainable_tokens(F.col("chosen_labels")).alias("chosen_learned"), E.trainable_tokens(F.col("rejected_labels")).alias("rejected_learned"),
        long(F.size("chosen_ids") - F.size("rejected_ids")).alias("longer"),
    )


_MIXED = f"""WITH d AS (SELECT *, 1 + doc_id % 2 AS copies, {n_tokens('text')} + 1 AS n, {n_tokens('left(text, 60)')} AS p, {n_tokens('substr(text, 61)')} + 1 AS c,
    '<|im_start|>user' || chr(10) || lang || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)
      || text || '<|im_end|>' || chr(10) AS shown FROM documents),
  s AS (SELECT doc_id AS seq, copies, start, least(512, n - start) AS tokens, least(512, n - start) AS trainable_tokens FROM (SELECT *, unnest(range(0, n, 512)) AS start FROM d WHERE doc_id % 3 = 0)
    UNION ALL SELECT doc_id, copies, 0, p + c, c FROM d WHERE doc_id % 3 = 1 AND p + c <= 512
    UNION ALL SELECT doc_id, copies, 0, {n_tokens('shown')}, {n_tokens("(text || '<|im_end|>')")} FROM d WHERE doc_id % 3 = 2 AND {n_tokens('shown')} <= 512)
"""


def _mixed_records(spark, sf_dir):
    """Every document as a record: a text, a prompt with its completion, or a conversation; every other one twice."""
    from trainset.schema import MESSAGE

    kind = F.pmod("doc_id", F.lit(3))
    said = lambda role, c: F.struct(*[{"role": F.lit(role), "content": c}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in MESSAGE.fields])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.when(kind == 0, F.lit("text")).when(kind == 1, F.lit("completion")).otherwise(F.lit("trace")).alias("kind"),
        F.when(kind == 0, F.col("text")).alias("text"), F.when(kind == 1, F.substring("text", 1, 60)).alias("prompt"), F.when(kind == 1, F.expr("substring(text, 61)")).alias("completion"),
        F.when(kind == 2, F.array(said("user", F.col("lang")), said("assistant", F.col("text")))).alias("messages"),
        (F.pmod("doc_id", F.lit(2)) + 1).cast("int").alias("repeat"),
    )


@query(
    "mixed_record_samples",
    _MIXED + "SELECT seq, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy, CAST(start AS INTEGER) AS start, CAST(tokens AS BIGINT) AS tokens, CAST(trainable_tokens AS BIGINT) AS trainable_tokens FROM s",
)
def mixed_record_samples(spark, sf_dir):
    """Samples of records of three kinds, made of whole documents, in as many copies as each asks for."""
    made = PS.build_samples(_mixed_records(spark, sf_dir), R.CHATML, "sft", 512)
    return made.select("seq", "copy", "start", long(F.size("input_ids")).alias("tokens"), E.trainable_tokens(F.col("labels")).alias("trainable_tokens"))


@query(
    "mixed_record_outcomes",
    _MIXED + """SELECT CASE WHEN seq IS NULL THEN 'skipped_long' ELSE 'sample' END AS outcome, CAST(NULL AS VARCHAR) AS reason, CAST(sum(d.copies) AS BIGINT) AS n
    FROM d LEFT JOIN (SELECT DISTINCT seq FROM s) ON seq = doc_id GROUP BY ALL""",
)
def mixed_record_outcomes(spark, sf_dir):
    return PS.build_report(_mixed_records(spark, sf_dir), R.CHATML, 512)


_LENGTHS = f"""SELECT unnest(range(0, copies)) AS copy, * FROM (SELECT copies, doc_id % 3 AS kind, doc_id % 7 AS rest, CASE doc_id % 3 WHEN 0 THEN n WHEN 1 THEN p + c ELSE {n_tokens('shown')} END AS tokens,
    CASE doc_id % 3 WHEN 0 THEN n WHEN 1 THEN c ELSE {n_tokens("(text || '<|im_end|>')")} END AS learned FROM d) WHERE kind <> 2 OR rest <> 0"""


@query(
    "mixed_token_report",
    _MIXED + f""", l AS ({_LENGTHS}), q AS ({pct_sql('tokens', 'SELECT tokens FROM l')})
    SELECT 'tokens' AS part, 'samples' AS name, CAST(count(*) AS DOUBLE) AS value FROM l UNION ALL SELECT 'tokens', 'trainable_mean', round_even(avg(learned), 0) FROM l
    UNION ALL SELECT 'tokens', 'mean', round_even(total / n, 0) FROM q UNION ALL SELECT 'tokens', 'over_max_len', count(*) FILTER (tokens > 512) FROM l
    UNION ALL SELECT 'tokens', 'share_over_max_len', round(count(*) FILTER (tokens > 512) / count(*), 4) FROM l"""
    + "".join(f" UNION ALL SELECT 'tokens', '{c}', {c} FROM q" for c in ("total", "min", "p50", "p90", "p99", "max"))
    + "".join(f" UNION ALL SELECT 'coverage', '{n}', round(count(*) FILTER (tokens <= {n}) / count(*), 4) FROM l" for n in (512, 1024, 2048, 4096, 8192, 16384))
    + " UNION ALL SELECT 'failure', 'user turn without text', sum(copies) FROM d WHERE doc_id % 3 = 2 AND doc_id % 7 = 0 HAVING count(*) > 0",
)
def mixed_token_report(spark, sf_dir):
    """Token lengths of samples of three kinds, made of whole documents; some conversations ask nothing and cannot be shown."""
    silent = F.transform("messages", lambda m: m.withField("content", F.when(m["role"] == "user", F.lit(" ")).otherwise(m["content"])))
    records = _mixed_records(spark, sf_dir)
    records = records.withColumn("messages", F.when(F.pmod("seq", F.lit(7)) == 0, silent).otherwise(F.col("messages")))
    return PS.token_report(records, R.CHATML, 512)


_TURN_SQL = """'<|im_start|>' || c.role || chr(10) || CASE WHEN c.role = 'assistant' AND (a.u IS NULL OR c.turn > a.u)
    THEN '<think>' || chr(10) || left(c.text, 12) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || c.text || '<|im_end|>' || chr(10)"""


@query(
    "reasoning_samples",
    _CUT + f""", k AS (SELECT conv_id, turn, text, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) > 1 AS expands, la,
        max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS u, role FROM c),
    a AS (SELECT * FROM k WHERE role = 'assistant' AND (expands OR turn = la)),
    t AS (SELECT a.conv_id, CASE WHEN a.expands THEN a.turn END AS answer_turn, any_value('<think>' || chr(10) || left(a.text, 12) || chr(10) || '</think>' || chr(10) || chr(10) || a.text || '<|im_end|>') AS learned,
        string_agg({_TURN_SQL}, '' ORDER BY c.turn) AS text FROM a JOIN c ON c.conv_id = a.conv_id AND c.turn <= a.turn GROUP BY a.conv_id, a.turn, a.expands)
    SELECT conv_id, CAST(answer_turn AS INTEGER) AS answer_turn, md5(text) AS text, md5(learned) AS learned, CAST({n_tokens('text')} AS BIGINT) AS tokens, CAST({n_tokens('learned')} AS BIGINT) AS trainable_tokens
    FROM t WHERE {n_tokens('text')} <= 700""",
)
def reasoning_samples(spark, sf_dir):
    """A sample for each answer of conversations with reasoning: its history as it was seen then, and the answer with its reasoning."""
    thought = F.when(F.col("role") == "assistant", F.substring("content", 1, 12))
    calls = F.lit(None).cast("array<struct<id:string,name:string,arguments:string,args_is_object:boolean,type:string>>")
    said = turns(spark, sf_dir).withColumns({"reasoning": thought, "tool_calls": calls, "train": F.lit(True), "train_on": F.lit("assistant"), "repeat": F.lit(1)})
    rows = materialize(PS.conversation_rows(said, R.CHATML, 700, "drop", "conv_id"), "reasoning-rows")
    texts = PS.sample_texts(rows, "sample")
    coded = E.encode_sft(rows, 700, "drop", "sample", "turn")
    return coded.join(texts, "sample").select(
        F.col("sample.key").alias("conv_id"), "sample.answer_turn", F.md5("text").alias("text"), F.md5("learned").alias("learned"),
        long(F.size("input_ids")).alias("tokens"), E.trainable_tokens(F.col("labels")).alias("trainable_tokens"),
    )
