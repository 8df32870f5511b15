"""Sampling, mixing, upsampling, splits and their reports."""

from trainset.operators import sampling as S
from trainset.operators.sampling import Part
from trainset.operators.traces import scan_groups, suitable_objectives
from trainset.plans.training_set import build_training_set, set_kind, training_set_report
from trainset.queries.common import SEED_SQL, F, long, query, table

PARTS = (Part("documents", max_records=300), Part("benchmark", repeat=3), Part("conversations", max_records=0))

_ALL = """SELECT 'documents' AS dataset, doc_id AS seq, 'text' AS kind, length(text) AS chars FROM documents
  UNION ALL SELECT 'benchmark', item_id, 'text', length(text) FROM benchmark
  UNION ALL SELECT 'conversations', conv_id, 'trace', CAST(sum(length(text)) AS BIGINT) FROM conversations GROUP BY conv_id"""
_HASH = SEED_SQL(42, "dataset", "seq")
_MIXED = f"""WITH a AS ({_ALL}), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_HASH}, dataset, seq) AS rk FROM a),
capped AS (SELECT dataset, seq, kind, chars, CASE dataset WHEN 'benchmark' THEN 3 ELSE 1 END AS copies FROM r WHERE dataset <> 'documents' OR rk <= 300)"""


def all_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("dataset"), F.col("doc_id").alias("seq"), F.lit("text").alias("kind"), long(F.length("text")).alias("chars")
    )
    bench = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("dataset"), F.col("item_id").alias("seq"), F.lit("text").alias("kind"), long(F.length("text")).alias("chars")
    )
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars")).select(
        F.lit("conversations").alias("dataset"), F.col("conv_id").alias("seq"), F.lit("trace").alias("kind"), "chars"
    )
    return docs.unionByName(bench).unionByName(convs)


@query("mix_capped", _MIXED + "SELECT dataset, seq, chars FROM capped")
def mix_capped(spark, sf_dir):
    return S.mix(all_records(spark, sf_dir), PARTS, expand=False).select("dataset", "seq", "chars")


@query("upsample_parts", _MIXED + "SELECT dataset, seq, unnest(range(1, copies + 1)) AS copy FROM capped")
def upsample_parts(spark, sf_dir):
    return S.mix(all_records(spark, sf_dir), PARTS).select("dataset", "seq", long(F.col("copy")).alias("copy"))


_SPLIT = _MIXED + f""", n AS (SELECT sum(copies) AS n FROM capped),
held AS (SELECT dataset, seq FROM (SELECT *, row_number() OVER (ORDER BY {SEED_SQL('split-42', 'dataset', 'seq')}, dataset, seq) AS rk FROM capped)
  WHERE rk <= (SELECT CASE WHEN n < 40 THEN 0 ELSE least(300, greatest(1, CAST(floor(n * 0.05) AS INTEGER))) END FROM n)),
done AS (SELECT c.*, CASE WHEN h.seq IS NULL THEN 'train' ELSE 'eval' END AS split FROM capped c LEFT JOIN held h USING (dataset, seq))
"""


@query("train_eval_split", _SPLIT + "SELECT dataset, seq, split, count(*) AS copies FROM (SELECT *, unnest(range(copies)) FROM done) GROUP BY 1, 2, 3")
def train_eval_split(spark, sf_dir):
    mixed = build_training_set(all_records(spark, sf_dir), PARTS)
    return mixed.groupBy("dataset", "seq", "split").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "training_set_report",
    _SPLIT + "SELECT split, dataset, CAST(sum(copies) AS BIGINT) AS \"rows\", count(*) AS records, CAST(sum(copies * chars) AS BIGINT) AS chars FROM done GROUP BY 1, 2",
)
def training_set_report_query(spark, sf_dir):
    return training_set_report(build_training_set(all_records(spark, sf_dir), PARTS))


@query("training_set_kind", _MIXED + "SELECT CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind FROM capped")
def training_set_kind(spark, sf_dir):
    return set_kind(S.mix(all_records(spark, sf_dir), PARTS))


@query(
    "train_eval_split_compat",
    _MIXED + f""", x AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM capped),
    h AS (SELECT *, row_number() OVER (ORDER BY {SEED_SQL('split-42', 'dataset', 'seq', 'copy')}, dataset, seq, copy) AS rk, count(*) OVER () AS n FROM x)
    SELECT dataset, CASE WHEN n >= 40 AND rk <= least(300, greatest(1, CAST(floor(n * 0.05) AS INTEGER))) THEN 'eval' ELSE 'train' END AS split, count(*) AS n
    FROM h GROUP BY 1, 2""",
)
def train_eval_split_compat(spark, sf_dir):
    mixed = build_training_set(all_records(spark, sf_dir), PARTS, compat=True)
    return mixed.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "repeat_records",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM (SELECT *, unnest(range(CAST(least(greatest(l_quantity, 1), 100) AS BIGINT))) FROM lineitem) GROUP BY 1, 2",
)
def repeat_records(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.col("l_quantity"), F.lit(100)).cast("int").alias("repeat"))
    return S.upsample(rows, F.col("repeat")).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))


@query("seeded_sample_large", f"SELECT event_id, user_id FROM events ORDER BY {SEED_SQL(3, 'event_id')}, event_id LIMIT 5000")
def seeded_sample_large(spark, sf_dir):
    """A sample too large for a top-k in one task: the histogram cut."""
    rows = table(spark, sf_dir, "events").withColumn("all", F.lit("all"))
    return S.cap_groups(rows, {"all": 5000}, "all", 3, ["event_id"]).select("event_id", "user_id")


_POOL = """WITH l AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS lu FROM conversations),
p AS (SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(text, turn) AS ask FROM l WHERE turn <= lu GROUP BY conv_id)"""


def prompt_pool_turns(spark, sf_dir):
    """Turns up to the last user turn of every conversation."""
    turns = scan_groups(
        table(spark, sf_dir, "conversations"), ["conv_id"], "turn",
        totals={"last_user": ("max", F.when(F.col("role") == "user", F.col("turn")))},
    )
    return turns.where((F.col("turn") <= F.col("last_user")) & F.col("role").isin("system", "user", "assistant"))


@query("prompt_pool", _POOL + f" SELECT conv_id, messages, chars, ask FROM p ORDER BY {SEED_SQL(7, 'conv_id')}, conv_id LIMIT 50")
def prompt_pool(spark, sf_dir):
    pool = prompt_pool_turns(spark, sf_dir).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"), F.max_by("text", "turn").alias("ask")
    )
    return S.sample_rows(pool, 50, 7, ["conv_id"])


@query("most_common_sources", "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def most_common_sources(spark, sf_dir):
    return S.most_common(table(spark, sf_dir, "documents"), "source", 10)


@query("most_common_languages", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def most_common_languages(spark, sf_dir):
    return S.most_common(table(spark, sf_dir, "documents"), "lang", 10)


@query("suitable_objectives", "SELECT 'cpt,sft,dpo' AS objectives")
def suitable_objectives_query(spark, sf_dir):
    """Text, traces and preference pairs: documents, and labelled documents as alternatives."""
    said = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), c.alias("content")))
    none = F.lit(None).cast("array<struct<role:string,content:string>>")
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.lit("text").alias("kind"), none.alias("chosen"), none.alias("rejected"))
    pairs = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.lit("trace").alias("kind"), F.when(F.col("quality") == 1, said(F.col("text"))).alias("chosen"),
        F.when(F.col("quality") == 1, said(F.col("lang"))).alias("rejected"),
    )
    return suitable_objectives(texts.unionByName(pairs))
