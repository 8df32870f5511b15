"""Dataset statistics, percentiles, token estimates, lineage and preference metrics."""

from trainset.functions.tokens import token_count
from trainset.operators import lineage as G
from trainset.operators import stats as S
from trainset.operators.traces import turn_fingerprints, turn_summary
from trainset.queries.common import WS, F, long, query, table, text_records

TOKENS_SQL = r"regexp_extract_all({c}, '\p{{L}}+|\p{{N}}+|[ \t]+|(?s:.)')"


def _pct(col, alias, p, n="n"):
    return f"max(CASE WHEN rk = round_even({p} * ({n} - 1), 0) THEN {col} END) AS {alias}"


def pct_sql(col: str, source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = (by + ", ") if by else ""
    picks = ", ".join(f"CAST({_pct(col, a, p).rsplit(' AS ', 1)[0]} AS BIGINT) AS {a}" for a, p in S.RANKS.items())
    return (
        f"SELECT {cols}max(n) AS n, CAST(sum({col}) AS BIGINT) AS total, {picks} FROM (SELECT *, count(*) OVER ({part}) AS n, "
        f"row_number() OVER ({part} ORDER BY {col}) - 1 AS rk FROM ({source})) {'GROUP BY ' + by if by else ''}"
    )


@query("char_percentiles", pct_sql("chars", "SELECT source, length(text) AS chars FROM documents", "source"))
def char_percentiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.length("text").alias("chars"))
    return S.rank_percentiles(docs, "chars", ["source"])


@query("char_percentiles_all", pct_sql("chars", "SELECT length(text) AS chars FROM documents"))
def char_percentiles_all(spark, sf_dir):
    return S.rank_percentiles(table(spark, sf_dir, "documents").select(F.length("text").alias("chars")), "chars")


def metrics_sql(pairs: dict[str, str], rest: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM {rest}" for k, v in pairs.items())


DOC_STATS = {
    "records": "count(*)", "kind_trace": "0", "kind_text": "count(*)", "kind_completion": "0", "kind_image": "0", "answer_chars_mean": "0",
    "share_with_reasoning": "0", "share_with_tool_calls": "0", "share_with_system_prompt": "0", "synthetic": "0",
    "duplicates": f"count(*) - count(DISTINCT trim(text, {WS}))",
}


def text_summary(records, *more):
    """Flat text records as ``dataset_stats`` reads them, with ``more`` of their columns."""
    none = F.lit(None)
    return records.select(
        "kind", "fp", "chars", none.cast("long").alias("assistant_turns"), none.cast("long").alias("answer_chars"),
        *[F.lit(False).alias(c) for c in ("has_reasoning", "has_tool_calls", "has_system", "meta_synthetic")], *more,
    )


@query(
    "dataset_stats_documents",
    "WITH p AS (" + pct_sql("chars", "SELECT length(text) AS chars FROM documents") + ") "
    + " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST(max(v) AS DOUBLE) AS value FROM (SELECT {v} AS v FROM documents)" for k, v in DOC_STATS.items())
    + "".join(f" UNION ALL SELECT 'chars_{a}', CAST({a} AS DOUBLE) FROM p" for a in S.RANKS),
)
def dataset_stats_documents(spark, sf_dir):
    return S.dataset_stats(text_summary(text_records(spark, sf_dir)))


_CONV = f"""WITH t AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (role = 'assistant') AS a,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS ac, arg_min(role, turn) = 'system' AS s,
  string_agg(role || chr(30) || trim(text, {WS}), chr(31) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
c AS ({pct_sql('chars', 'SELECT chars FROM t')}), u AS ({pct_sql('a', 'SELECT a FROM t')}) """
_CONV_STATS = {
    "records": "count(*)", "kind_trace": "count(*)", "kind_text": "0", "kind_completion": "0", "kind_image": "0",
    "answer_chars_mean": "round_even(sum(ac) / sum(a), 0)", "share_with_reasoning": "0", "share_with_tool_calls": "0",
    "share_with_system_prompt": "round(count(*) FILTER (s) / count(*), 3)", "synthetic": "0", "duplicates": "count(*) - count(DISTINCT body)",
}


@query(
    "dataset_stats_conversations",
    _CONV + " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST(max(v) AS DOUBLE) AS value FROM (SELECT {v} AS v FROM t)" for k, v in _CONV_STATS.items())
    + "".join(f" UNION ALL SELECT 'chars_{a}', CAST({a} AS DOUBLE) FROM c UNION ALL SELECT 'assistant_turns_{a}', CAST({a} AS DOUBLE) FROM u" for a in S.RANKS),
)
def dataset_stats_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = turn_summary(turns).join(turn_fingerprints(turns), "conv_id").select(
        F.lit("trace").alias("kind"), "fp", "chars", "assistant_turns", "answer_chars", "has_system",
        *[F.lit(False).alias(c) for c in ("has_reasoning", "has_tool_calls", "meta_synthetic")],
    )
    return S.dataset_stats(rows)


_TOK = f"SELECT lang, length(text) AS chars, len({TOKENS_SQL.format(c='text')}) AS tokens FROM documents"


@query("token_estimates", "SELECT doc_id, CAST(greatest(1, floor(length(text) / 3.6)) AS BIGINT) + 32 AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"))
    return S.with_token_estimate(docs).select("doc_id", "tokens")


@query(
    "token_statistics",
    f"""WITH p AS ({pct_sql('tokens', _TOK, 'lang')}), o AS (SELECT lang, count(*) FILTER (tokens > 1024) AS over_max_len FROM ({_TOK}) GROUP BY lang)
    SELECT p.*, CAST(round_even(total / n, 0) AS BIGINT) AS mean, over_max_len, round(over_max_len / n, 4) AS share_over_max_len FROM p JOIN o USING (lang)""",
)
def token_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", token_count(F.col("text")).alias("tokens"))
    return S.token_stats(docs, max_len=1024, by=["lang"])


@query(
    "token_coverage",
    f"""SELECT lang, samples, max_len, fit, round(fit / samples, 4) AS share FROM (
      SELECT lang, max_len, count(*) AS samples, count(*) FILTER (tokens <= max_len) AS fit
      FROM ({_TOK}) AS t, (VALUES (512), (1024), (2048), (4096), (8192), (16384)) AS v(max_len) GROUP BY 1, 2)""",
)
def token_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", token_count(F.col("text")).alias("tokens"))
    return S.coverage(docs, by=["lang"])


@query(
    "suggest_sequence_length",
    f"""WITH p AS ({pct_sql('tokens', _TOK, 'lang')}), m AS (SELECT *, CAST(round_even(total / n, 0) AS BIGINT) AS mean,
      CAST(least(8192, greatest(512, least(32768, pow(2, ceil(log2(greatest(p90, 1))))))) AS BIGINT) AS max_seq_len FROM p)
    SELECT lang, p90, max_seq_len, greatest(1, CAST(ceil(n * mean / max_seq_len) AS BIGINT)) AS blocks FROM m""",
)
def suggest_sequence_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", token_count(F.col("text")).alias("tokens"))
    stats = S.suggest_seq_len(S.token_stats(docs, by=["lang"]), context=8192)
    return S.packed_block_estimate(stats, F.col("max_seq_len")).select("lang", "p90", "max_seq_len", "blocks")


@query(
    "lineage_report",
    """WITH parts AS (SELECT CAST(o_custkey % 7 AS BIGINT) AS training_set, o_custkey AS dataset_key, o_orderkey AS pos FROM orders),
    f AS (SELECT training_set, dataset_key, min(pos) AS pos FROM parts GROUP BY 1, 2)
    SELECT training_set, c_mktsegment AS source, coalesce(n_name, 'unknown') AS license, count(*) AS datasets,
      bool_or(c_acctbal < 0) AS synthetic FROM f JOIN customer ON c_custkey = dataset_key
      LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 GROUP BY 1, 2, 3""",
)
def lineage_report(spark, sf_dir):
    """Orders stand in for set parts, customers for datasets, nations for their manifests."""
    parts = table(spark, sf_dir, "orders").select(
        F.pmod("o_custkey", F.lit(7)).alias("training_set"), F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("pos")
    )
    datasets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("source"), (F.col("c_acctbal") < 0).alias("synthetic"), "c_nationkey"
    )
    manifests = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("license"))
    lineage = G.lineage(parts, datasets.join(manifests, "c_nationkey", "left"))
    return G.lineage_report(lineage)


@query(
    "preference_metrics",
    """WITH x AS (SELECT l_returnflag AS run, -l_quantity AS pc, -l_tax * 300 AS pr, -l_quantity * 1.1 AS rc, -l_discount * 400 AS rr FROM lineitem),
    y AS (SELECT *, 0.1 * ((pc - rc) - (pr - rr)) AS z, 0.1 * (pc - rc) AS wc, 0.1 * (pr - rr) AS wr FROM x)
    SELECT run, count(*) AS pairs, round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 5) AS loss, round(avg(wc), 5) AS rewards_chosen,
      round(avg(wr), 5) AS rewards_rejected, round(avg(CASE WHEN wc > wr THEN 1.0 ELSE 0.0 END), 5) AS rewards_accuracy, round(avg(wc - wr), 5) AS rewards_margin
    FROM y GROUP BY run""",
)
def preference_metrics(spark, sf_dir):
    logps = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"), (-F.col("l_quantity")).alias("policy_chosen"), (-F.col("l_tax") * 300).alias("policy_rejected"),
        (-F.col("l_quantity") * 1.1).alias("ref_chosen"), (-F.col("l_discount") * 400).alias("ref_rejected"),
    )
    return G.preference_metrics(logps, beta=0.1, by=["run"])


@query(
    "top_values",
    """WITH v AS (SELECT 'source' AS field, source AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents),
    c AS (SELECT field, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 3""",
)
def top_values(spark, sf_dir):
    return S.top_values(table(spark, sf_dir, "documents"), ["source", "lang"], 3)
